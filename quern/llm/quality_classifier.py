"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of a text are counts and shares (below), transformed by log or arcsine root. Spark sums the first and second moments of each
class over all labelled training rows; from these come means, covariances shrunk towards the pooled one and its diagonal, and
their Cholesky factors, made once and cached in the model. A score is the logistic of the Mahalanobis log-density difference plus the
class frequencies' log ratio.

Defined results: a null or empty text has all statistics at zero; rows without doc_id are scored and not held out; repeated rows are scored
each, and train each; a label other than 0 and 1 is none; with fewer than two classes in the training rows all scores are the share of
class 1 (0.5 without any). Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm.lm_score import held_out
from quern.llm.shared import materialize
from quern.llm.textops import text_slices, word_bounds, word_hashes

THRESHOLD = 0.7
#: Parts of a class covariance that come from the pooled covariance and from its diagonal.
POOLED, DIAGONAL = 0.2, 0.05
SCORED = "doc_id long, held_out boolean, score double, predicted int"

_KINDS = {
    "upper": (65, 90), "lower": (97, 122), "digit": (48, 57), "high": (128, 255),
}
_MARKS = {"exclaim": b"!", "symbol": b"#*$%&|<>@^~=+_{}[]\\", "stop": b".", "pause": b",;:", "line": b"\n"}
STATISTICS = ("words", "bytes_per_word", "long_words", "distinct_words", "repeated_next", "repeated_pairs", "top_word", "words_per_line", "repeated_lines", "marked_ends", *_KINDS, *_MARKS)


def _tables() -> np.ndarray:
    out = np.zeros((len(_KINDS) + len(_MARKS), 256), bool)
    for row, (a, b) in zip(out, _KINDS.values(), strict=False):
        row[a : b + 1] = True
    for row, marks in zip(out[len(_KINDS) :], _MARKS.values(), strict=True):
        row[list(marks)] = True
    return out


_CLASS = _tables()
_END_MARK = _CLASS[len(_KINDS) + 1] | _CLASS[len(_KINDS)]


def _distinct(groups: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per group the number of distinct values and the count of the most frequent."""
    order = np.lexsort((values, groups))
    g, v = groups[order], values[order]
    lead = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])) if len(g) else np.zeros(0, np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, g[lead], np.diff(np.append(lead, len(g))))
    return np.bincount(g[lead], minlength=n), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed STATISTICS for every text."""
    n = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets)
    hashes, count = word_hashes(data, starts, ends), np.diff(first)
    doc = np.repeat(np.arange(n), count)
    some, size = np.maximum(count, 1), np.maximum(np.diff(offsets), 1)
    share = lambda x, of: np.arcsin(np.sqrt(np.clip(x / of, 0, 1)))
    sums = lambda mask, bounds: np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds])
    distinct, top = _distinct(doc, hashes, n)
    same = doc[1:] == doc[:-1]
    pairs, _ = _distinct(doc[1:][same], (hashes[:-1] * np.uint64(3) + hashes[1:])[same], n)
    n_pairs = np.maximum(count - 1, 1)
    line_word = np.concatenate([[0], np.cumsum(data == 10)])
    # a line is its words' sum of hashes; lines without words do not count
    line = line_word[starts] + doc if len(starts) else np.zeros(0, np.int64)
    lead = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    text_of_line = doc[lead]
    lines = np.maximum(np.bincount(text_of_line, minlength=n), 1)
    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(lead, np.diff(np.append(lead, len(hashes)))).astype(np.uint64)
    line_hash = np.add.reduceat(hashes * (place * np.uint64(2) + np.uint64(1)), lead) if len(lead) else hashes
    own_lines, _ = _distinct(text_of_line, line_hash, n)
    columns = [
        np.log1p(count), np.log1p(sums(np.ones(len(data)), offsets) / some), share(sums(ends - starts > 15, first), some), share(distinct, some),
        share(sums(np.concatenate([[0], (hashes[1:] == hashes[:-1]) & same]) if len(hashes) else np.zeros(0), first), some), share(n_pairs - pairs, n_pairs), share(top, some),
        np.log1p(count / lines), share(lines - own_lines, lines), share(sums(_END_MARK[data[ends - 1]] if len(ends) else np.zeros(0), first), some),
    ]
    columns += [share(sums(mask[data], offsets), size) for mask in _CLASS]
    return np.where(np.diff(offsets)[:, None] > 0, np.stack(columns, axis=1), 0.0)


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column("text")):
            x = statistics(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), lists], ["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with the transformed statistics of each text."""
    return docs.select("doc_id", "text").mapInArrow(_featurize, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Model:
    """Log ratio of class frequencies, and each class's mean, inverse Cholesky factor and half log determinant."""

    prior: float
    classes: tuple[tuple[np.ndarray, np.ndarray, float], ...] = ()

    def scores(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.prior)
        for sign, (mean, whiten, half_log_det) in zip((-1, 1), self.classes, strict=False):
            logit += sign * (-0.5 * np.square((x - mean) @ whiten.T).sum(axis=1) - half_log_det)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class and task: the count and the sums of x and of its products."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            y = np.array(batch.column("label"))
            x = np.array(batch.column("x").flatten()).reshape(len(y), -1)
            for c in (0, 1):
                own = np.concatenate([np.ones((int((y == c).sum()), 1)), x[y == c]], axis=1)
                sums[c] = sums.get(c, 0) + own.T @ own
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.ravel().tolist() for s in sums.values()], pa.list_(pa.float64()))], ["label", "sums"])


def train(labelled: DataFrame) -> Model:
    """Fit on labelled(label, x) rows; the driver sees one row of sums per class."""
    parts = labelled.where("label IN (0, 1)").select("label", "x").mapInArrow(_moments, "label int, sums array<double>")
    parts = parts.select("label", F.posexplode("sums").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v"))
    rows = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("s")).collect()
    sums = {r.label: np.array([e.v for e in r.s]) for r in rows}
    sums = {c: s.reshape(int(len(s) ** 0.5), -1) for c, s in sums.items()}
    n = {c: sums[c][0, 0] if c in sums else 0.0 for c in (0, 1)}
    if not n[0] or not n[1]:
        share = n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
        return Model(float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    mean = {c: sums[c][0, 1:] / n[c] for c in n}
    scatter = {c: sums[c][1:, 1:] - n[c] * np.outer(mean[c], mean[c]) for c in n}
    pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
    floor = np.diag(np.maximum(np.diag(pooled), 1e-4))
    classes = []
    for c in n:
        own = min(1.0, n[c] / (n[c] + 2 * len(pooled))) * (1 - POOLED - DIAGONAL)
        cov = own * scatter[c] / n[c] + (1 - DIAGONAL - own) * pooled + DIAGONAL * floor
        chol = np.linalg.cholesky(cov)
        classes.append((mean[c], np.linalg.inv(chol), float(np.log(np.diag(chol)).sum())))
    return Model(float(np.log(n[1] / n[0])), tuple(classes))


def _scorer(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").flatten()).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """SCORED's columns for docs(doc_id, text), learned from labels(doc_id, quality) of the rows whose crc32(doc_id) mod 4 is not 2. Only the text's statistics enter a score."""
    x = materialize(features(docs), "statistics")
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(~held_out(F.col("doc_id"), 4, 2))
    model = train(x.join(given, "doc_id"))
    scored = x.mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
