"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays that workers memory-map.

Tokens of a text: its words, A-Z lower-cased, then one end token; the first word's context is a begin marker. A word's id is 3 plus the
place of its hash in the sorted vocabulary; a bigram's key is context id << 32 | word id.

Counting: tasks sum what they read into sorted (key, count) blobs per bucket; Spark shuffles the blobs; one task merges a bucket and
writes a sorted shard into the shared folder. Vocabulary buckets are ranges of the word's hash, and bigram buckets are drawn from the
context's hash, those of frequent contexts from the whole bigram's, so that no bucket grows with a single word. The driver sees one
row of sums per bucket.

Defined results: a null or empty text is one end token; a row without doc_id is trained on, scored and not held out; repeated rows
count again; an empty training set gives the uniform distribution. Other columns of the input are not read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.shared import mounted_dir
from quern.llm.textops import mix, text_slices, word_bounds, word_hashes

BEGIN, END, UNKNOWN, FIRST = 0, 1, 2, 3
#: Distinct keys that a task holds before it passes its sums on.
FLUSH = 3_000_000
SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_BLOB = "bucket int, keys binary, sums binary"
_U32 = np.uint64(32)


def held_out(doc_id: Column, parts: int = 10, part: int = 0) -> Column:
    """True where crc32(doc_id as text) leaves this remainder; false without a doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


# ---- sums per key, through Spark's shuffle ------------------------------------------------------------------------------------


def _summed(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their rows; sums has one row per key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    lead = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[lead], np.add.reduceat(sums[order], lead, axis=0) if len(lead) else sums[:0]


def _blobs(buckets: np.ndarray, keys: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows dealt to their buckets, one blob each; keys are sorted within a bucket if they come sorted."""
    order = np.argsort(buckets, kind="stable")
    buckets, keys, sums = buckets[order], keys[order], sums[order].astype(np.uint32 if sums.max(initial=0) < 2**32 else np.uint64)
    cut = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(keys))
    if len(cut):
        yield pa.RecordBatch.from_arrays(
            [pa.array(buckets[cut].astype(np.int32)), pa.array([keys[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array([sums[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())],
            ["bucket", "keys", "sums"],
        )


def _merged(table: pa.Table, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")])
    # sums have four bytes, or eight where a blob's largest needs them
    sums = np.concatenate([np.frombuffer(s.as_buffer(), np.uint32 if s.as_buffer().size == width * k.as_buffer().size // 2 else np.uint64).astype(np.int64).reshape(-1, width) for k, s in zip(table.column("keys"), table.column("sums"), strict=True)])
    return table.column("bucket")[0].as_py(), *_summed(keys, sums)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Whole or not at all, and the same again if the task is run again."""
    part = f"{folder}/.{name}-{uuid.uuid4().hex}.npy"
    np.save(part, array)
    os.replace(part, f"{folder}/{name}.npy")


class _Sums:
    """Running sums of uint64 keys; at FLUSH distinct keys it asks to be emptied."""

    def __init__(self) -> None:
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray) -> bool:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > FLUSH:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])
        return self.size > FLUSH // 2 and len(self.parts) == 1

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys, sums = _summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts])) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return keys, sums


# ---- the model ----------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """What workers need besides the mapped files: sums over the corpus, the first id of each vocabulary shard, and discounts."""

    folder: str
    buckets: int
    starts: tuple[int, ...]
    words: int
    tokens: int
    texts: int
    pairs: int = 0
    discounts: tuple[tuple[float, ...], ...] = ((0.0,) * 4, (0.0,) * 4)
    #: Words with one, two and more contexts before them.
    spread: tuple[int, ...] = (0, 0, 0)

    @property
    def shift(self) -> np.uint64:
        return np.uint64(64 - (self.buckets.bit_length() - 1))


@lru_cache(65536)
def _mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r") if os.path.getsize(path) > 128 else np.load(path)


def _at(model: Model, name: str, bucket: int) -> np.ndarray | None:
    path = f"{model.folder}/{name}{bucket}.npy"
    return _mapped(path) if os.path.exists(path) else None


def _runs(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    if len(buckets):
        cut = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
        for a, b in zip(cut, np.append(cut[1:], len(buckets)), strict=True):
            yield int(buckets[a]), slice(int(a), int(b))


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return place, sorted_keys[place] == wanted


def word_ids(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of sorted distinct word hashes."""
    ids, counts = np.full(len(hashes), UNKNOWN, np.uint64), np.zeros(len(hashes), np.int64)
    for bucket, run in _runs(hashes >> model.shift):
        if (keys := _at(model, "words", bucket)) is not None:
            place, hit = _find(keys, hashes[run])
            ids[run] = np.where(hit, place + model.starts[bucket] + FIRST, UNKNOWN)
            counts[run] = np.where(hit, _at(model, "counts", bucket)[place], 0)
    return ids, counts


def _pair_buckets(model: Model, keys: np.ndarray, context_counts: np.ndarray) -> np.ndarray:
    """The bucket follows from the context, or from the whole bigram where the context is frequent."""
    hot = context_counts > model.tokens / (4 * model.buckets)
    return mix(np.where(hot, keys, keys >> _U32)) >> model.shift


def _id_bucket(model: Model, ids: np.ndarray) -> np.ndarray:
    return ids * np.uint64(model.buckets) // np.uint64(model.words + FIRST)


def _dense(model: Model, name: str, ids: np.ndarray, width: int) -> np.ndarray:
    """Rows of a table by id; ids must be sorted; a missing row is 0."""
    out = np.zeros((len(ids), width), np.int64)
    for bucket, run in _runs(_id_bucket(model, ids)):
        if (keys := _at(model, f"{name}-ids", bucket)) is not None:
            place, hit = _find(keys, ids[run])
            out[run] = np.where(hit[:, None], _at(model, f"{name}-sums", bucket)[place], 0)
    return out


def _tokens(model: Model, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and counts of all tokens, ends included, and of their contexts, and where each text's tokens begin."""
    distinct, back = np.unique(hashes, return_inverse=True)
    ids, counts = word_ids(model, distinct)
    texts = len(first) - 1
    begins = first[:-1] + np.arange(texts)
    n = len(hashes) + texts
    is_end = np.zeros(n, bool)
    is_end[first[1:] + np.arange(texts)] = True
    token, seen, context, context_seen = np.full(n, END, np.uint64), np.full(n, model.texts), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    token[~is_end], seen[~is_end] = ids[back], counts[back]
    context[1:], context_seen[1:] = token[:-1], seen[:-1]
    context[begins], context_seen[begins] = BEGIN, model.texts
    return token, seen, context, context_seen, begins


def _word_counter(buckets: int) -> Callable:
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, texts = _Sums(), 0
        for batch in batches:
            texts += batch.num_rows
            for _, _, data, offsets in text_slices(batch.column("text")):
                starts, ends, _ = word_bounds(data, offsets)
                if sums.add(word_hashes(data, starts, ends)):
                    keys, counts = sums.total()
                    yield from _blobs(keys >> shift, keys, counts[:, None])
        keys, counts = sums.total()
        yield from _blobs(keys >> shift, keys, counts[:, None])
        yield from _blobs(np.array([-1]), np.zeros(1, np.uint64), np.array([[texts]]))

    return run


def _word_merger(folder: str) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        bucket, keys, sums = _merged(table, 1)
        if bucket >= 0:
            _save(folder, f"words{bucket}", keys)
            _save(folder, f"counts{bucket}", sums[:, 0])
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": [len(keys)], "total": [int(sums.sum())]})

    return run


def _pair_counter(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()

        def dealt() -> Iterator[pa.RecordBatch]:
            keys, counts = sums.total()
            contexts, back = np.unique(keys >> _U32, return_inverse=True)
            frequent = _context_counts(model, contexts)[back]
            yield from _blobs(_pair_buckets(model, keys, frequent), keys, counts[:, None])

        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                starts, ends, first = word_bounds(data, offsets)
                token, _, context, _, _ = _tokens(model, word_hashes(data, starts, ends), first)
                if sums.add(context << _U32 | token):
                    yield from dealt()
        yield from dealt()

    return run


def _context_counts(model: Model, ids: np.ndarray) -> np.ndarray:
    """How often each context of sorted ids was seen: the begin marker once a text, a word as often as it occurs."""
    out = np.zeros(len(ids), np.int64)
    out[ids == BEGIN] = model.texts
    word = ids >= FIRST
    starts = np.array(model.starts)
    place = ids[word].astype(np.int64) - FIRST
    bucket = np.searchsorted(starts, place, "right") - 1
    found = np.zeros(len(place), np.int64)
    for b, run in _runs(bucket):
        found[run] = _at(model, "counts", b)[place[run] - starts[b]]
    out[word] = found
    return out


def _by_count(counts: np.ndarray) -> np.ndarray:
    """One row per count: itself, and whether it is 1, 2, more."""
    return np.stack([counts, counts == 1, counts == 2, counts > 2], axis=1).astype(np.int64)


def _histogram(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _pair_merger(model: Model) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        bucket, keys, sums = _merged(table, 1)
        counts = sums[:, 0]
        _save(model.folder, f"pairs{bucket}", keys)
        _save(model.folder, f"pair-counts{bucket}", counts.astype(np.uint32) if counts.max(initial=0) < 2**32 else counts)
        contexts, stats = _summed(keys >> _U32, _by_count(counts))
        words, before = np.unique(keys & np.uint64(2**32 - 1), return_counts=True)
        out = [*_blobs(_id_bucket(model, contexts).astype(np.int64) * 2, contexts, stats), *_blobs(_id_bucket(model, words).astype(np.int64) * 2 + 1, words, before[:, None])]
        out += _blobs(np.array([-1]), np.zeros(1, np.uint64), np.array([_histogram(counts)]))
        return pa.Table.from_batches(out)

    return run


def _id_merger(model: Model) -> Callable:
    """Tables by id: even buckets hold contexts (total, followers seen once, twice, more), odd ones words (contexts before them)."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("bucket")[0].as_py()
        bucket, ids, sums = _merged(table, 1 if kind >= 0 and kind % 2 else 4)
        histogram, spread = [0] * 4, [0] * 3
        if kind >= 0:
            name = "before" if kind % 2 else "after"
            _save(model.folder, f"{name}-ids{kind // 2}", ids)
            _save(model.folder, f"{name}-sums{kind // 2}", sums)
            if kind % 2:
                histogram, spread = _histogram(sums[:, 0]), _by_count(sums[:, 0])[:, 1:].sum(0).tolist()
        else:
            histogram = [int(x) for x in sums[0]]
        total = int(sums.sum()) if kind >= 0 and kind % 2 else 0
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "total": [total], "histogram": pa.array([histogram], pa.list_(pa.int64())), "spread": pa.array([spread], pa.list_(pa.int64()))})

    return run


def discounts(n: list[int]) -> tuple[float, ...]:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and more from the numbers of items counted 1 to 4 times; where the formula has no value in (0, count], half, one and one and a half."""
    plain = (0.5, 1.0, 1.5)
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0 for k in (1, 2, 3)]
    return (0.0, *(d if 0 < d <= k else p for k, (d, p) in enumerate(zip(found, plain, strict=True), 1)))


def train(docs: DataFrame, buckets: int | None = None) -> Model:
    """Count the texts of docs and write the model to a new folder under the shared one. buckets: a power of two, by default from the session's shuffle partitions, which a user sets by the size of the data."""
    spark = docs.sparkSession
    buckets = buckets or 1 << (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    folder = mounted_dir(spark, "bigrams")
    texts = docs.select("text")
    words = texts.mapInArrow(_word_counter(buckets), _BLOB).groupBy("bucket").applyInArrow(_word_merger(folder), "bucket int, n long, total long").collect()
    sizes, total = np.zeros(buckets, np.int64), 0
    for row in words:
        if row.bucket >= 0:
            sizes[row.bucket] = row.n
            total += row.total
    n_texts = sum(row.total for row in words if row.bucket < 0)
    if (n_words := int(sizes.sum())) + FIRST >= 2**32:
        raise ValueError(f"{n_words} distinct words; ids have 32 bits")
    starts = tuple(int(x) for x in np.cumsum(sizes) - sizes)
    model = Model(folder, buckets, starts, n_words, total + n_texts, n_texts)
    rows = texts.mapInArrow(_pair_counter(model), _BLOB).groupBy("bucket").applyInArrow(_pair_merger(model), _BLOB)
    rows = rows.groupBy("bucket").applyInArrow(_id_merger(model), "bucket int, total long, histogram array<long>, spread array<long>").collect()
    low = [sum(r.histogram[k] for r in rows if r.bucket >= 0) for k in range(4)]
    high = [sum(r.histogram[k] for r in rows if r.bucket < 0) for k in range(4)]
    return Model(folder, buckets, starts, n_words, total + n_texts, n_texts, sum(r.total for r in rows), (discounts(low), discounts(high)), tuple(sum(r.spread[k] for r in rows) for k in range(3)))


def _discounted(counts: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return counts - np.array(d)[np.minimum(counts, 3)]


def probabilities(model: Model, context: np.ndarray, token: np.ndarray, context_seen: np.ndarray) -> np.ndarray:
    """P(token | context) of every pair; a word outside the vocabulary shares in the uniform part only."""
    low, high = model.discounts
    ids, back = np.unique(token, return_inverse=True)
    before = _dense(model, "before", ids, 1)[:, 0]
    spread = sum(d * n for d, n in zip(low[1:], model.spread, strict=True)) / max(model.pairs, 1) if model.pairs else 1.0
    unigram = (_discounted(before, low) / max(model.pairs, 1) + spread / (model.words + 2))[back]
    pairs, where = np.unique(context << _U32 | token, return_inverse=True)
    seen = np.zeros(len(pairs), np.int64)
    seen[where] = context_seen
    buckets = _pair_buckets(model, pairs, seen)
    order = np.argsort(buckets, kind="stable")
    counts = np.zeros(len(pairs), np.int64)
    for bucket, run in _runs(buckets[order]):
        if (keys := _at(model, "pairs", bucket)) is not None:
            place, hit = _find(keys, pairs[order[run]])
            counts[order[run]] = np.where(hit, _at(model, "pair-counts", bucket)[place], 0)
    contexts, of = np.unique(context, return_inverse=True)
    after = _dense(model, "after", contexts, 4)
    total = np.maximum(after[:, 0], 1)
    left = np.where(after[:, 0] > 0, after[:, 1:] @ np.array(high[1:]) / total, 1.0)
    return _discounted(counts, high)[where] / total[of] + left[of] * unigram


def _scorer(model: Model) -> Callable:
    types = model.words + (model.texts > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                starts, ends, first = word_bounds(data, offsets)
                token, seen, context, context_seen, begins = _tokens(model, word_hashes(data, starts, ends), first)
                base = np.log10((seen + 0.1) / (model.tokens + 0.1 * (types + 1)))
                p = probabilities(model, context, token, context_seen)
                sums = [np.add.reduceat(x, begins) for x in ((seen > 0).astype(np.int64), base, np.log10(p))]
                n = hi - lo
                columns = [batch.column("doc_id").slice(lo, n).cast(pa.int64()), batch.column("held_out").slice(lo, n), pa.array(np.diff(np.append(begins, len(token)))), pa.array(sums[0]), pa.array(np.full(n, model.tokens)), pa.array(sums[1]), pa.array(sums[2])]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORE.split(", ")])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """SCORE's columns for docs(doc_id, held_out, text): counts, the add-0.1 unigram score and the model's log10 probability of each text."""
    return docs.select("doc_id", "held_out", "text").mapInArrow(_scorer(model), SCORE)


def train_and_score(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, score all."""
    docs = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return score(docs, train(docs.where(~F.col("held_out"))))
