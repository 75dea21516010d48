"""URL filters: a temporal join of captures with dated list entries, in DataFrame operations only.

An entry (key, action, listed_on) puts a domain ('example.org', with all its subdomains) or a path ('example.org/a/b', with all below)
on the list from a day on; a later entry of the same key replaces it. Entries become validity intervals. A capture is looked up under
all its keys as of the day of its fetch, and the most specific key with an entry then decides: a longer path before a shorter one, any
path before the host, the host before its parents.

The join runs on distinct (key, day) pairs, so that a host with a third of all captures costs no more than its days, and the verdict of
each distinct (url, day) goes back to the captures.

Defined results: a null, empty or host-less URL, or a null day, matches nothing and is not blocked; of entries of one key on one day
'block' counts; entries with a null key, action or day are void; repeated captures are judged each; an empty list blocks nothing. Other
columns of the captures pass through, but one that is named like a result gives way to it; other columns of the entries are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def host(url: Column) -> Column:
    """The lower-cased host without user, port or a final dot; '' if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:\d*)?$", ""))


def path_parts(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda p: p != "")


def keys(url: Column) -> Column:
    """(key, rank) of every list key that covers the URL; a higher rank is more specific."""
    name, parts = host(url), path_parts(url)
    labels = F.split(name, r"\.")
    n = F.size(labels)
    # parents down to two labels; a host of one label stands for itself
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.struct(F.array_join(F.slice(labels, i, n - i + 1), ".").alias("key"), (n - i + 1).alias("rank")))
    below = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    paths = F.transform(below, lambda i: F.struct(F.concat(name, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("key"), (i + 1_000_000).alias("rank")))
    return F.when(name != "", F.concat(domains, paths)).otherwise(F.array().cast("array<struct<key:string,rank:int>>"))


def validity(entries: DataFrame) -> DataFrame:
    """(key, action, listed_on, until): each entry's interval, open at its end where no later one replaces it."""
    day = entries.select("key", "action", "listed_on").where("key IS NOT NULL AND action IS NOT NULL AND listed_on IS NOT NULL").groupBy("key", "listed_on").agg(F.max(F.struct(F.col("action") == "block", "action"))["action"].alias("action"))
    return day.withColumn("until", F.lead("listed_on").over(Window.partitionBy("key").orderBy("listed_on")))


def verdicts(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched_on") -> DataFrame:
    """captures with matched_key, action, listed_on of the deciding entry (null without one) and blocked."""
    looked_up = captures.select(F.col(url).alias("_url"), F.col(day).alias("_day")).where("_url IS NOT NULL AND _day IS NOT NULL").distinct()
    asked = looked_up.select("_url", "_day", F.inline(keys(F.col("_url"))))
    spans = validity(entries)
    as_of = asked.select("key", "_day").distinct().join(spans, "key")
    as_of = as_of.where((F.col("listed_on") <= F.col("_day")) & (F.col("until").isNull() | (F.col("_day") < F.col("until")))).drop("until")
    best = F.max(F.struct("rank", "key", "action", "listed_on")).alias("_best")
    found = asked.join(as_of, ["key", "_day"]).groupBy("_url", "_day").agg(best)
    # the captures' columns stay in one, so that no name clashes in the join
    rows = captures.select(F.struct("*").alias("_row"), F.col(url).alias("_url"), F.col(day).alias("_day"))
    out = rows.join(found, ["_url", "_day"], "left")
    best = {"matched_key": F.col("_best.key"), "action": F.col("_best.action"), "listed_on": F.col("_best.listed_on"), "blocked": F.coalesce(F.col("_best.action") == "block", F.lit(False))}
    return out.select(*(F.col(f"_row.`{c}`") for c in captures.columns if c not in best), *(c.alias(name) for name, c in best.items()))


def derived_captures(pages: DataFrame) -> DataFrame:
    """pages(page_id, url) with a day of fetch that follows from the id: the table has none."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 500).cast("int")).alias("fetched_on"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated entries on hosts, first path parts and single paths of pages, which grow with them: actions and days follow from md5 of the key."""
    name, parts = host(F.col("url")), path_parts(F.col("url"))
    whole = F.when(F.col("page_id") % 20 == 0, F.concat(name, F.lit("/"), F.array_join(parts, "/")))
    first = F.concat(name, F.lit("/"), F.get(parts, F.lit(0)))
    listed = pages.select(F.explode(F.array(name, first, whole)).alias("key")).where("key <> ''").distinct()
    listed = listed.withColumn("x", F.conv(F.substring(F.md5("key"), 1, 4), 16, 10).cast("int"))
    on = lambda days: F.date_add(F.lit("2024-01-01").cast("date"), days)
    entry = lambda action, days: F.struct(F.lit(action).alias("action"), on(F.col("x") % 365 + days).alias("listed_on"))
    dated = F.array(F.when(F.col("x") % 4 != 3, entry("block", 0)), F.when(F.col("x") % 2 == 0, entry("allow", 60)), F.when(F.col("x") % 5 == 0, entry("block", 120)))
    return listed.select("key", F.inline(F.array_compact(dated)))
