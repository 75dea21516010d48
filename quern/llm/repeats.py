"""Removal of byte strings of `least` bytes that start at two places or more of a corpus, through suffix arrays of bounded pieces.

1. Every window of `least` bytes is owned by the least hash among its substrings of ANCHOR bytes. Consecutive windows with one owner make a
   piece; equal windows have equal owners, so they lie in pieces of one bucket. Buckets of one piece that can't repeat itself end here.
2. The pieces of a bucket are collapsed by content and counted. A bucket with more than LARGE
   bytes of different contents is cut anew by longer substrings around the least one, by half of what is missing to the whole window in
   each turn; a window's own bytes are the last of them, so every bucket gets small.
3. Whole buckets are gathered into texts of about TEXT bytes. Each gets a suffix array sorted to depth `least` and its Burrows-Wheeler
   transform. From the interval of the empty string, intervals are extended backward breadth first; a right end that is met first in turn n
   has a common prefix of n with its neighbour. After `least` turns the places without a value start strings that are repeated.
4. Found runs go back to all places of their piece, and the bytes that they cover go.

A task holds about TEXT bytes and one bucket more; hot contents are counted before they are shuffled.

Defined results: a null text is empty; texts shorter than `least` stay as they are; rows that repeat a doc_id, or have none, are documents of
their own, so that equal ones repeat each other; other columns pass through `without_repeats`, but for `spans` and `kept`, which are replaced.
Bytes need not be valid UTF-8. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quern.llm.shared import materialize
from quern.llm.textops import mix, power_tables, text_slices

LEAST, ANCHOR = 200, 64
#: Bytes of a task's text, of a bucket's different contents before it is cut anew, of a slice of a long document, and windows of a piece.
TEXT, LARGE, SLICE, MOST = 1 << 19, 1 << 21, 1 << 20, 2048
_TABLE = np.random.default_rng(20251103).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_PIECE = "key long, h long, n int"


class Hashes:
    """Hashes of any substrings of some bytes."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = power_tables(len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=self.prefix[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts])

    def each(self, size: int) -> np.ndarray:
        """Hashes of all substrings of one size, mixed more briefly."""
        out = self.prefix[size:] - self.prefix[:-size]
        out *= self.down[: len(out)]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w values in a row."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def pieces(data: np.ndarray, offsets: np.ndarray, least: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, owner's hash, content's hash, whether windows of the piece may repeat each other) of the texts data[offsets[i]:offsets[i+1]]."""
    w = least - anchor + 1
    if len(data) < least:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    hashes = Hashes(data)
    subs = hashes.each(anchor)
    owner = sliding_min(subs, w)
    # windows that reach beyond their text have no owner; runs of one owner end there and where it changes
    last = np.maximum(offsets[1:] - least + 1, offsets[:-1])
    valid = np.zeros(len(data) + 1, np.int8)
    np.add.at(valid, offsets[:-1], 1)
    np.add.at(valid, last, -1)
    valid = np.cumsum(valid[: len(owner)], dtype=np.int8).astype(bool)
    new = np.ones(len(owner), bool)
    np.not_equal(owner[1:], owner[:-1], out=new[1:])
    new[offsets[:-1][offsets[:-1] < len(owner)]] = True
    starts = np.flatnonzero(new & valid)
    if not len(starts):
        return pieces(data[:0], offsets, least, anchor)
    # a run ends where the next one starts or its text has no more windows; long ones are cut
    edge = np.flatnonzero(new | ~valid)
    ends = np.append(edge, len(owner))[np.searchsorted(edge, starts, "right")]
    cut = -(-(ends - starts) // MOST)
    turn = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
    lo = np.repeat(starts, cut) + turn * MOST
    hi = np.minimum(lo + MOST, np.repeat(ends, cut))
    # windows with the owner at one place differ in where it lies; another place of it before the last window's start tells of a second
    place = np.flatnonzero(subs[: len(owner)] == owner)
    twice = np.searchsorted(place, hi - 1) > np.searchsorted(place, lo)
    text = np.searchsorted(offsets, lo, "right") - 1
    return text, lo - offsets[text], hi - lo, owner[lo], hashes.of(lo, hi - 1 + least), twice


def _slices(column: pa.Array, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place in the row, bytes, offsets) of runs of rows; long rows come in slices that overlap by what a window needs."""
    for lo, hi, data, offsets in text_slices(column, SLICE):
        for a in range(0, max(1, len(data) - least + 1), SLICE) if hi == lo + 1 else (0,):
            part = data[a : a + SLICE + least - 1] if hi == lo + 1 else data
            yield np.arange(lo, hi), a, part, np.array([0, len(part)]) if hi == lo + 1 else offsets


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _scanned(least: int, anchor: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key = batch.column("doc"), batch.column("t")
            for rows, at, data, offsets in _slices(batch.column("text"), least):
                text, place, n, owner, h, twice = pieces(data, offsets, least, anchor)
                row = pa.array(rows[text])
                yield pa.RecordBatch.from_arrays(
                    [_signed(owner), _signed(h), pa.array(n.astype(np.int32)), doc.take(row), key.take(row), pa.array(place + at), pa.array(twice)], ["key", "h", "n", "doc", "t", "start", "twice"]
                )

    return run


def _fetched(least: int) -> Callable:
    """The contents of the pieces that a text is asked for; a text that comes again right after itself is asked once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for i in range(batch.num_rows):
                this = batch.column("doc")[i].as_py(), batch.column("t")[i].as_py()
                if this == last:
                    continue
                last = this
                data, asked = batch.column("text")[i].as_buffer(), pa.RecordBatch.from_struct_array(batch.column("asked")[i].values)
                starts, n = asked.column("start").to_pylist(), asked.column("n").to_pylist()
                content = pa.array([data[s : s + k + least - 1].to_pybytes() for s, k in zip(starts, n, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(asked.column(c) for c in ("key", "h", "n", "many")), content], ["key", "h", "n", "many", "content"])

    return run


def recut(content: np.ndarray, least: int, anchor: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, key, content's hash) of a piece's runs of windows that agree in the substring which lies around the least one and lacks a 2**turn-th of what that lacks of the window."""
    hashes = Hashes(content)
    subs = hashes.each(anchor)
    windows, w = len(content) - least + 1, least - anchor + 1
    owner = sliding_min(subs, w)
    # the first place of the owner in each window: the next place, from the right, where a substring is the owner of a window that begins there or before
    s = np.array([i + int(np.argmax(subs[i : i + w] == owner[i])) for i in range(windows)]) - np.arange(windows)
    e = s + anchor
    for _ in range(turn):
        half = (least - (e - s) + 1) // 2
        left = s >= half
        s, e = np.where(left, s - half, s), np.where(left, e, e + half)
    place = np.arange(windows)
    key = hashes.of(place + s, place + e) ^ np.uint64(turn)
    lo = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    hi = np.append(lo[1:], windows)
    return lo, hi - lo, key[lo], hashes.of(lo, hi - 1 + least)


def _recut(least: int, anchor: int, turn: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lo, n, key, h = recut(np.frombuffer(row["content"], np.uint8), least, anchor, turn)
                one = lambda x, t: pa.array([x] * len(lo), t)
                yield pa.RecordBatch.from_arrays(
                    [_signed(key), _signed(h), pa.array(n.astype(np.int32)), one(row["many"], pa.bool_()), pa.array([row["content"][a : a + k + least - 1] for a, k in zip(lo, n, strict=True)], pa.binary()), one(row["key"], pa.int64()), one(row["h"], pa.int64()), one(row["n"], pa.int32()), pa.array(lo.astype(np.int32))],
                    ["key", "h", "n", "many", "content", "of_key", "of_h", "of_n", "at"],
                )

    return run


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of text (numbers of 0 to 256) in the order of what begins there, to the given depth at least; what lies beyond the end is less than all. The places that agree so far are sorted anew by what follows, three times as deep in each turn."""
    n = len(text)
    symbols = np.zeros(257, np.int64)
    symbols[text] = 1
    base = int(symbols.sum()) + 1
    code = np.cumsum(symbols)[text]
    held = max(1, min(depth, int(62 / np.log2(base))))
    word = np.zeros(n + held, np.int64)
    word[:n] = code
    key = code.copy()
    for k in range(1, held):
        key *= base
        key += word[k : n + k]
    order = np.argsort(key)
    key, slots = key[order], np.arange(n)
    rank = np.zeros(n + 2 * depth, np.int64)
    while True:
        first = np.ones(len(slots), bool)
        first[1:] = key[1:] != key[:-1]
        # a place's rank is the slot of the first that agrees with it, from 1
        rank[order[slots]] = np.maximum.accumulate(np.where(first, slots, 0)) + 1
        alone = first.copy()
        alone[:-1] &= first[1:]
        slots = slots[~alone]
        if held >= depth or not len(slots):
            return order
        at, near, bits = order[slots], min(held, depth - held), n.bit_length()
        key, far = (rank[at] << bits) | rank[at + near], near
        if 3 * bits < 64 and near == held:
            far = min(2 * held, depth - held)
            key = (key << bits) | rank[at + far]
        by = np.argsort(key)
        order[slots], key, held = at[by], key[by], held + far


def repeated_starts(text: np.ndarray, least: int) -> np.ndarray:
    """Whether the `least` numbers from each place on also start elsewhere. 0 separates texts: strings with it don't count, the caller leaves them out."""
    n = len(text)
    order = suffix_array(text, least)
    before = text[order - 1].astype(np.uint16)  # the transform; the first place is preceded by the last, a separator
    by_symbol = np.argsort(before, kind="stable").astype(np.int32)
    lf = np.empty(n, np.int32)
    lf[by_symbol] = np.arange(n, dtype=np.int32)
    # the next and the previous row with the same symbol
    same = before[by_symbol][1:] == before[by_symbol][:-1]
    after, prior = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    after[by_symbol[:-1][same]], prior[by_symbol[1:][same]] = by_symbol[1:][same], by_symbol[:-1][same]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    lo, hi = np.array([0], np.int32), np.array([n], np.int32)
    for turn in range(least):
        if not len(lo):
            break
        size = hi - lo
        begin, end = np.repeat(lo, size), np.repeat(hi, size)
        rows = np.arange(len(begin), dtype=np.int32) + np.repeat(lo - (np.cumsum(size) - size).astype(np.int32), size)
        if turn:  # a separator only ends a string
            keep = before[rows] != 0
            rows, begin, end = rows[keep], begin[keep], end[keep]
        # an interval and a symbol before it make an interval: from the first such row to the last; those of one turn don't overlap, so in order they pair
        new_lo, new_hi = np.sort(lf[rows[prior[rows] < begin]]), np.sort(lf[rows[after[rows] >= end]]) + 1
        fresh = ~known[new_hi]
        known[new_hi] = True
        lo, hi = new_lo[fresh], new_hi[fresh]
    out = np.zeros(n, bool)
    pair = np.flatnonzero(~known[1:n]) + 1
    out[order[pair]] = out[order[pair - 1]] = True
    return out


def _marked(rows: list[dict], least: int) -> pa.RecordBatch:
    """(key, h, n, runs) of pieces of whole buckets: runs of windows that are repeated."""
    sizes, windows = np.array([len(r["content"]) for r in rows]), np.array([r["n"] for r in rows])
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(rows), np.int64)
    text[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(rows)), sizes)] = np.frombuffer(b"".join(r["content"] for r in rows), np.uint8).astype(np.int64) + 1
    found = repeated_starts(text, least)
    # of a content with copies every window is; what follows a piece's windows is no window
    piece, place = np.repeat(np.arange(len(rows)), sizes + 1), np.arange(len(text)) - np.repeat(starts, sizes + 1)
    found = (found | np.array([r["many"] for r in rows])[piece]) & (place < windows[piece])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])))
    out: dict[int, list[dict]] = {}
    for p, x, y in zip(piece[edges[::2]].tolist(), place[edges[::2]].tolist(), (edges[1::2] - starts[piece[edges[::2]]]).tolist(), strict=True):
        out.setdefault(p, []).append({"lo": x, "hi": y})
    out = [(rows[p]["key"], rows[p]["h"], rows[p]["n"], runs) for p, runs in out.items()]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["key", "h", "n", "runs"])


def _expanded(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["key"], row["h"], row["n"]) == tuple(held[-1][c] for c in ("key", "h", "n")):
                    held[-1]["many"] |= row["many"]
                    continue
                if size >= TEXT and row["key"] != held[-1]["key"]:
                    yield _marked(held, least)
                    held, size = [], 0
                held.append(row)
                size += len(row["content"])
        if held:
            yield _marked(held, least)

    return run


_ID = ["key", "h", "n"]
_RUNS = f"{_PIECE}, runs array<struct<lo:int,hi:int>>"


def _fetch(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """(key, h, n, many, content): the content of wanted pieces, each from one of its places."""
    asked = wanted.groupBy("doc", "t").agg(F.collect_list(F.struct("start", "key", "h", "n", "many")).alias("asked"))
    both = docs.join(asked.hint("merge"), ["doc", "t"]).select("doc", "t", "text", "asked")
    return both.mapInArrow(_fetched(least), f"{_PIECE}, many boolean, content binary")


def repeated_pieces(docs: DataFrame, scanned: DataFrame, least: int, anchor: int, large: int) -> DataFrame:
    """(key, h, n, runs) of the pieces that hold repeated windows, over docs(doc, t, text) and their pieces that may repeat.

    A content at several places is one text with that many copies, so that each of its intervals is at least as wide. A bucket of one
    content that can't repeat itself has no other intervals: there is nothing to sort.
    """
    one = scanned.groupBy(*_ID).agg(F.count("*").alias("c"), F.max("twice").alias("twice"), F.min(F.struct("doc", "t", "start")).alias("at"))
    one = materialize(one.select(*_ID, (F.col("c") > 1).alias("many"), "twice", "at.*"), "piece-contents")
    lone = one.groupBy("key").agg(F.count("*").alias("c"), F.max("twice").alias("twice"), F.min("h").alias("h"), F.min("n").alias("n")).where("c = 1 AND NOT twice")
    lone = materialize(lone.select(*_ID), "lone-pieces")
    left = materialize(_fetch(docs, one.join(lone.select("key").hint("merge"), "key", "left_anti"), least), "contents")
    links, small, turn, missing = [], [], 0, least - anchor
    while True:
        sizes = left.groupBy("key").agg(F.sum(F.octet_length("content")).alias("bytes"), F.min("h").alias("a"), F.max("h").alias("b"), F.min("n").alias("c"), F.max("n").alias("d"))
        # a bucket of one content can't be cut and needs no cutting
        hot = materialize(sizes.where((F.col("bytes") > large) & ((F.col("a") != F.col("b")) | (F.col("c") != F.col("d")))).select("key"), "large-buckets")
        # where the substring is the whole window, contents of a bucket differ in their number of windows only, of which there are at most MOST
        if missing == 0 or hot.isEmpty():
            small.append(left)
            break
        small.append(left.join(hot.hint("merge"), "key", "left_anti"))
        turn, missing = turn + 1, missing - (missing + 1) // 2
        cut = materialize(left.join(hot.hint("merge"), "key", "left_semi").mapInArrow(_recut(least, anchor, turn), f"{_PIECE}, many boolean, content binary, of_key long, of_h long, of_n int, at int"), "cut-pieces")
        links.append(cut.select(*_ID, "of_key", "of_h", "of_n", "at"))
        left = materialize(cut.groupBy(*_ID).agg((F.max("many") | (F.count("*") > 1)).alias("many"), F.first("content").alias("content")), "contents")
    found = []
    for part in small:
        found.append(materialize(part.repartition("key").sortWithinPartitions(*_ID).mapInArrow(_expanded(least), _RUNS), "runs"))
    out = found.pop()
    while links:
        back = out.join(links.pop().hint("merge"), _ID)
        back = back.select(F.col("of_key").alias("key"), F.col("of_h").alias("h"), F.col("of_n").alias("n"), F.transform("runs", lambda r: F.struct((r["lo"] + F.col("at")).alias("lo"), (r["hi"] + F.col("at")).alias("hi"))).alias("runs"))
        out = found.pop().unionByName(back.groupBy(*_ID).agg(F.flatten(F.collect_list("runs")).alias("runs")))
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi")))
    return out.unionByName(lone.select(*_ID, whole.alias("runs")))


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that [start, end) cover."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]]) if len(starts) else np.zeros(0, bool)
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)] if len(ends) else ends


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the spans that were found in each row and cuts them out of its text."""
    for batch in batches:
        spans, kept, rows = [], [], pa.RecordBatch.from_struct_array(batch.column("row"))
        for text, found in zip(rows.column("text"), batch.column("found").to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            at = np.array([(x["lo"], x["hi"]) for x in found or ()], np.int64).reshape(-1, 2)
            a, b = (x.tolist() for x in merged_spans(at[:, 0], at[:, 1]))
            spans.append([{"start": x, "end": y} for x, y in zip(a, b, strict=True)])
            kept.append(b"".join(data[x:y] for x, y in zip([0, *b], [*a, len(data)], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(spans, kind), pa.array(kept, pa.binary())], [*rows.schema.names, "spans", "kept"])


def without_repeats(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, large: int = LARGE) -> DataFrame:
    """docs(doc_id, text, ...) with spans array<struct<start,end>>, the maximal runs of bytes covered by a string of `least` bytes that starts elsewhere too, and kept, the other bytes."""
    docs = docs.drop("spans", "kept")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("t"), F.struct(*docs.columns).alias("row"))
    texts = keyed.select("doc", "t", "row.text").where(F.octet_length("text") >= least)
    scanned = materialize(texts.mapInArrow(_scanned(least, anchor), f"{_PIECE}, doc long, t long, start long, twice boolean"), "pieces")
    buckets = scanned.groupBy("key").agg(F.sum(F.col("twice").cast("long") + 1).alias("c")).where("c > 1").select("key")
    shared = materialize(scanned.join(buckets.hint("merge"), "key", "left_semi"), "shared-pieces")
    runs = repeated_pieces(texts, shared, least, anchor, large)
    spans = shared.join(runs.hint("merge"), _ID).select("doc", "t", "start", F.explode("runs").alias("r"))
    span = F.struct((F.col("start") + F.col("r.lo")).alias("lo"), (F.col("start") + F.col("r.hi") + (least - 1)).alias("hi"))
    found = spans.groupBy("doc", "t").agg(F.collect_set(span).alias("found"))
    schema = T.StructType([*docs.schema.fields, T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])
    return keyed.join(found.hint("merge"), ["doc", "t"], "left").select("row", "found").mapInArrow(_kept, schema)
