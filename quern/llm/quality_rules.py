"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Base counts of a text come first: words, characters in words, symbols, repeated lines, and words in repeated windows of eight. Then
rules decide whether a row is kept. On a sample of rows each rule's cost, the characters and counts that it reads, and its rejections
are summed up; the cascade puts first the rule that rejects most per cost, then the one that rejects most of what is left, and so on. A row leaves
the cascade at the first rule that rejects it, so later rules cost nothing there. The verdict does not depend on the order, and the order
is the same in every run over the same rows.

Defined results: a null or empty text has no words, fails the base rule and is not kept; repeated rows are judged each; other columns
of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES, SYMBOLS, WINDOW = " \t\n\x0b\x0c\r", "#*$%&|<>", 8
SENTENCE = "[.!?。।]"
#: Rows of the sample on which costs and rejections are estimated (about so many, chosen by a hash of their places in the table).
SAMPLE = 2000


@dataclass(frozen=True)
class Rule:
    """A row is rejected where the expression, over text and the base counts, is true; to decide it reads so many characters, or counts."""

    name: str
    rejects: str
    reads: str = "2"


def _without(characters: str) -> str:
    """SQL for the number of characters of text among these."""
    quoted = "".join(f"\\u{ord(c):04x}" for c in characters)
    return f"(length(text) - length(translate(text, '{quoted}', '')))"


RULES = (
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 16 * n_words"),
    Rule("repeated_lines", "n_lines > 3 AND 2 * n_dup_lines > n_lines"),
    Rule("shouting", f"2 * {_without('ABCDEFGHIJKLMNOPQRSTUVWXYZ')} > word_chars", "length(text)"),
    Rule("digits", f"10 * {_without('0123456789')} > 3 * word_chars", "length(text)"),
    Rule("exclaims", f"2 * {_without('!')} > n_words", "length(text)"),
    Rule("no_sentence", f"NOT regexp_like(text, r'{SENTENCE}')", f"coalesce(nullif(regexp_instr(text, r'{SENTENCE}'), 0), length(text))"),
    Rule("few_distinct", "20 * size(array_distinct(words)) < n_words", "n_words + word_chars"),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns that later expressions read, not compute anew: the optimiser doesn't merge projections over inline."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def _windows(words: Column) -> Column:
    """A hash of every window of eight words."""
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>"))
    window = lambda hashes: F.transform(starts, lambda k: F.xxhash64(*(F.get(hashes, k + j) for j in range(WINDOW))))
    return _let(F.transform(words, lambda w: F.xxhash64(w)), window)


def _covered(windows: Column) -> Column:
    """How many words the windows found twice or more cover. Repeated windows are neighbours in hash order; in the order of their places, each covers the words up to the next."""

    def places(ordered: Column) -> Column:
        is_twin = lambda s, k: F.coalesce(s["w"] == F.get(ordered, k - 1)["w"], F.lit(False)) | F.coalesce(s["w"] == F.get(ordered, k + 1)["w"], F.lit(False))
        return F.array_sort(F.transform(F.filter(ordered, is_twin), lambda s: s["i"]))

    def cover(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    twice = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(twice, _let(_let(ordered, places), cover)).otherwise(0).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with words, n_lines and COUNTS."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))
    out = _once(out, words=F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lines=lines)
    out = _once(out, windows=_windows(F.col("words")))
    return _once(
        out.withColumn("n_lines", F.size("lines")),
        n_words=F.size("words").cast("long"),
        word_chars=F.length(F.translate("text", SPACES, "")).cast("long"),
        n_symbols=(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_repeat_words=_covered(F.col("windows")),
    ).drop("lines", "windows")


BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], sample: int = SAMPLE) -> list[Rule]:
    """The rules by rejections per cost on a sample, each time among the rows that the rules before it leave. The driver sees a row for each set of verdicts."""
    total = docs.count()
    bound = int(2**62 * min(1.0, sample / max(total, 1)))
    place = F.xxhash64(F.monotonically_increasing_id())
    drawn = docs.withColumn("place", place).where(F.shiftrightunsigned("place", 2) <= bound)
    rows = measured(drawn).where(f"NOT ({BASE_FAILED})")
    cost = [F.sum(F.expr(r.reads)).alias(f"cost_{r.name}") for r in rules]
    verdicts = rows.groupBy(*(F.expr(r.rejects).alias(r.name) for r in rules)).agg(F.count("*").alias("n"), *cost).collect()
    out, left = [], list(rules)
    while left:
        rejected = {r.name: sum(v["n"] for v in verdicts if v[r.name]) for r in left}
        spent = {r.name: sum(v[f"cost_{r.name}"] for v in verdicts) for r in left}
        best = max(left, key=lambda r: (rejected[r.name] / max(spent[r.name], 1), -spent[r.name]))
        out.append(best)
        left.remove(best)
        verdicts = [v for v in verdicts if not v[best.name]]
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kept = F.when(F.col("base_failed"), False)
    for rule in order_rules(docs, rules, sample):
        kept = kept.when(F.expr(rule.rejects), False)
    rows = measured(docs).withColumn("base_failed", F.expr(BASE_FAILED))
    return rows.select("doc_id", *COUNTS, "base_failed", kept.otherwise(True).alias("kept"))
