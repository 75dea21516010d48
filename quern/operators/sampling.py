"""Samples and question sets. Draws follow a seeded hash, so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions.text import strip, text_sha1
from quern.sources.tables import materialize

#: The quota of question types of an evaluation set of 50.
QUESTION_TYPES = {"factual": 10, "entity": 7, "comparison": 7, "normative": 7, "temporal": 6, "negative": 5, "multi_hop": 5, "unanswerable": 3}
NOT_MADE = "NO GENERADA"


def draw(seed: str, *columns: str) -> Column:
    """A hash by which rows are drawn; md5, so that any engine can draw the same."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in columns)).cast("binary"))


def balanced_sample(df: DataFrame, n: int, seed: str, key: str = "source", id: str = "pos", text: str = "page_content") -> DataFrame:
    """n rows with text, in turn from each key: first one of every key, then a second, and so on. ids are drawn, at most n of a key from each task, and then meet their rows."""
    rows = df.where(F.coalesce(strip(F.col(text)), F.lit("")) != "")
    if (have := rows.limit(n).count()) < n:
        raise ValueError(f"{n} rows asked for, {have} there")
    turn = F.row_number().over(Window.partitionBy(key).orderBy("_draw", id))
    drawn = rows.select(id, key, draw(seed, id).alias("_draw")).withColumn("round", turn).where(F.col("round") <= n)
    drawn = drawn.orderBy("round", draw(seed, key), key, id).limit(n).select(id, "round")
    return rows.join(drawn, id).select(*df.columns, "round").orderBy("round", draw(seed, key), key)


def with_question_types(sample: DataFrame, seed: str, id: str = "pos", quota: dict[str, int] = QUESTION_TYPES) -> DataFrame:
    """A question type for each row of the sample; the quota's counts must add up to its rows."""
    kinds = [(kind, i) for kind, count in quota.items() for i in range(count)]
    if (n := sample.count()) != len(kinds):
        raise ValueError(f"{len(kinds)} types for {n} rows")
    slots = sample.sparkSession.createDataFrame(kinds, "question_type string, nth int")
    slots = slots.withColumn("_place", F.row_number().over(Window.orderBy(draw(seed, "question_type", "nth"))))
    rows = sample.withColumn("_place", F.row_number().over(Window.orderBy(draw(seed, id), id)))
    return rows.join(slots.drop("nth"), "_place").drop("_place")


def coverage_sample(df: DataFrame, n: int, seed: str, key: str = "file_hash", id: str = "pos") -> DataFrame:
    """At least one row of every key, then rows at random up to n; all rows if n is that many."""
    rows = df.select(id, key, draw(seed, id).alias("_draw"))
    # a key's first row by an aggregate, of which each task passes on one row a key
    first = materialize(rows.groupBy(key).agg(F.min(F.struct("_draw", id)).alias("f")).select(f"f.{id}", F.lit(1).alias("_first")), "first-rows")
    n = max(n, first.count())
    drawn = rows.join(first, id, "left").orderBy(F.coalesce("_first", F.lit(0)).desc(), "_draw", id).limit(n).select(id)
    return df.join(drawn, id, "left_semi")


def exclude_sources(df: DataFrame, tokens: list[str], column: str = "file_hash") -> DataFrame:
    """Rows whose column contains none of the tokens."""
    for token in tokens:
        df = df.where(~F.coalesce(F.contains(column, F.lit(token)), F.lit(False)))
    return df


def head_after_exclude(df: DataFrame, tokens: list[str], most: int, column: str = "file_hash") -> DataFrame:
    return exclude_sources(df, tokens, column).orderBy("pos").limit(most)


def pending_texts(texts: DataFrame, done: DataFrame) -> DataFrame:
    """Texts whose SHA-1 isn't in done(text_sha); all of them if an earlier row lacks it."""
    keyed = texts.withColumn("text_sha", text_sha1(F.col("page_content")))
    stale = done.where("text_sha IS NULL").limit(1).select(F.lit(True).alias("stale"))
    known = done.select("text_sha").distinct().withColumn("known", F.lit(True))
    return keyed.join(known, "text_sha", "left").join(stale, how="left").where("stale OR known IS NULL").drop("known", "stale")


def parse_question_array(raw: Column, limit: int) -> Column:
    """The (question, answer) pairs of an answer that holds a JSON array; null without one, as for an object that is in none; one blank pair of an empty array."""
    clean = lambda c: F.when(F.coalesce(strip(c), F.lit("")) == NOT_MADE, "").otherwise(F.coalesce(strip(c), F.lit("")))
    array = F.nullif(F.regexp_extract(raw, r"(?s)\[.*\]", 0), F.lit(""))
    items = F.filter(F.from_json(array, "array<string>"), lambda s: F.startswith(strip(s), F.lit("{")))
    pairs = F.transform(items, lambda s: F.from_json(s, "pregunta STRING, respuesta_posible STRING"))
    pairs = F.slice(F.transform(pairs, lambda p: F.struct(clean(p["pregunta"]).alias("question"), clean(p["respuesta_posible"]).alias("answer"))), 1, limit)
    blank = F.array(F.struct(F.lit("").alias("question"), F.lit("").alias("answer")))
    return F.when(items.isNotNull(), F.when(F.size(pairs) > 0, pairs).otherwise(blank))


def question_records(texts: DataFrame, limit: int) -> DataFrame:
    """A row for each pair of texts(page_content, source, file_hash, doc_category, raw)."""
    pairs = F.explode(parse_question_array(F.col("raw"), limit)).alias("p")
    return texts.select("source", "file_hash", F.col("doc_category").alias("category"), text_sha1(F.col("page_content")).alias("text_sha"), pairs).select("source", "file_hash", "category", "text_sha", "p.*")
