"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges, and an exact
join of what the stars leave: every two texts that share a bucket are compared, filtered out by a bound, or in one component.

A document's set: its distinct shingles of five lower-cased words; with fewer words the whole sequence is one shingle. Documents with
100 * |intersection| >= 85 * |union| are linked; a component's id is its smallest doc_id.

Defined results: a null or empty text has an empty set, is linked with nothing and is kept; rows that repeat a doc_id are one
document (the row with the largest set stands for it); rows without a doc_id come back unlinked, with a null component, kept. Other
columns of the input are not read.

Joins of tables that grow with the corpus are merge joins at every size, so that a small run's figures tell of a large one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.llm.shared import materialize
from quern.llm.textops import mix, text_slices, word_bounds, word_hashes

#: Bands of four rows find links of 0.85 all but surely; bands of eight gather only what is nearer, so that their centres suit.
SHINGLE, BINS, NARROW, WIDE = 5, 128, 4, 8
PERCENT = 85
#: Stars per bucket: each round compares what a bucket has unlinked with a centre not used so far, in the first half of
#: the rounds the best, then one drawn by hash, which differs from bucket to bucket.
STARS = 4
#: Longs of a set's odd sketch, by which pairs are left out before their sets are fetched.
SKETCH = 16
_MULT = np.uint64(0xD6E8FEB86659FD93)
_MARKS = [f"mark_{k}" for k in range(SKETCH)]
_SETS = ", ".join(["doc_id long", "shingles array<long>", *(f"{m} long" for m in _MARKS)])
_FEATURES = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, end to end, and where each text's begin."""
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    rolled = np.zeros(len(words), np.uint64)
    for k in range(SHINGLE):
        rolled[: len(words) - k] = rolled[: len(words) - k] * _MULT + words[k:]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            value = np.array([b - a], np.uint64)
            for k in range(a, b):
                value = mix(value * _MULT + words[k : k + 1])
            out.append(value)
        else:
            out.append(np.zeros(0, np.uint64))
    sizes = np.array([len(x) for x in out])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


@lru_cache(1)
def _donors() -> np.ndarray:
    """For every bin the bins that it tries in turn when empty: the same for all documents, as optimal densification asks."""
    with np.errstate(over="ignore"):
        code = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(1, 4097, dtype=np.uint64)[None, :]
        return (mix(code * _MULT) >> np.uint64(57)).astype(np.int64)


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of every non-empty set: the least hash in each of 128 ranges; empty ranges borrow from a donor."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    cell = doc * BINS + (values >> np.uint64(57)).astype(np.int64)
    lead = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
    sig, filled = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    sig[cell[lead]], filled[cell[lead]] = values[lead], True
    open_doc, open_bin = np.nonzero(~filled.reshape(n, BINS) & (np.diff(bounds) > 0)[:, None])
    donors, own = _donors(), sig.copy()
    for t in range(donors.shape[1]):
        if not len(open_doc):
            break
        source = open_doc * BINS + donors[open_bin, t]
        hit = filled[source]
        sig[open_doc[hit] * BINS + open_bin[hit]] = own[source[hit]]
        open_doc, open_bin = open_doc[~hit], open_bin[~hit]
    return sig.reshape(n, BINS)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One hash for every band of a signature, narrow bands first; the band's number is part of it."""
    out = []
    for rows in (NARROW, WIDE):
        part = sig.reshape(len(sig), BINS // rows, rows)
        key = np.broadcast_to(np.arange(1, BINS // rows + 1, dtype=np.uint64) + np.uint64(rows << 32), part.shape[:2]).copy()
        for k in range(rows):
            key = mix(key * _MULT + part[:, :, k])
        out.append(key)
    return np.concatenate(out, axis=1)


def sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Odd sketches: a bit tells whether an odd number of the set's hashes falls on it. What two sets share cancels out, so they differ in at least as many shingles as their sketches do in bits, however large they are."""
    out = np.zeros((len(bounds) - 1) * SKETCH, np.uint64)
    word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * SKETCH + ((values >> np.uint64(6)) % np.uint64(SKETCH)).astype(np.int64)
    np.bitwise_xor.at(out, word, np.uint64(1) << (values & np.uint64(63)))
    return out.view(np.int64).reshape(-1, SKETCH)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, data, offsets in text_slices(batch.column("text")):
            values, bounds = shingle_sets(data, offsets)
            sizes = np.diff(bounds)
            sums = [np.add.reduceat(np.concatenate([f(values), [np.uint64(0)]]), bounds[:-1]) for f in (mix, lambda v: mix(v * _MULT))]
            keys = np.stack([*sums, sizes.astype(np.uint64)], axis=1)
            keys[sizes == 0] = 0
            bands = band_keys(signatures(values, bounds))
            rows = np.where(sizes > 0, bands.shape[1], 0)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(sizes.astype(np.int64)), pa.array([k.tobytes() for k in keys], pa.binary()), _lists(bands[sizes > 0].ravel(), np.concatenate([[0], np.cumsum(rows)]))],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column("text")):
            values, bounds = shingle_sets(data, offsets)
            marks = sketches(values, bounds)
            columns = [pa.array(np.ascontiguousarray(marks[:, k])) for k in range(SKETCH)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), _lists(values, bounds), *columns], ["doc_id", "shingles", *_MARKS])


def _members(classes: DataFrame) -> DataFrame:
    """(bucket, degree, minus_rep, n_shingles, open) for buckets of two or more. The degree is how many bucket mates a class has in all its buckets of that width: the text that a group was copied from is nearer to all than they are to each other, so it has the highest."""
    members = classes.select(F.posexplode("bands").alias("band", "bucket"), "rep", "n_shingles").withColumn("wide", F.col("band") >= BINS // NARROW)
    sizes = members.groupBy("bucket").agg(F.count("*").alias("in_bucket")).where("in_bucket > 1")
    shared = members.join(sizes.hint("merge"), "bucket")
    degree = shared.groupBy("rep", "wide").agg(F.sum(F.col("in_bucket") - 1).alias("degree"))
    return shared.join(degree.hint("merge"), ["rep", "wide"]).select("bucket", "degree", (-F.col("rep")).alias("minus_rep"), "n_shingles", F.lit(True).alias("open"))


def _stars(members: DataFrame) -> DataFrame:
    """Each member with its bucket's centre, the member of the highest degree (the smallest id of those), itself left out; buckets with no open member end here."""
    centres = members.groupBy("bucket").agg(F.max(F.struct("degree", "minus_rep", "n_shingles")).alias("c"), F.max(F.struct("open", F.lit(1))).alias("o"))
    centres = centres.where("o.open").select("bucket", F.col("c.minus_rep").alias("minus_centre"), F.col("c.n_shingles").alias("centre_n"))
    return members.join(centres.hint("merge"), "bucket").where("minus_rep != minus_centre").withColumns({"rep": -F.col("minus_rep"), "centre": -F.col("minus_centre")})


def _confirmed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (rep, centre) whose full shingle sets are similar enough."""
    both = pairs.join(sets.toDF("rep", "rep_set").hint("merge"), "rep").join(sets.toDF("centre", "centre_set").hint("merge"), "centre")
    both = both.withColumn("common", F.size(F.array_intersect("rep_set", "centre_set")))
    union = F.size("rep_set") + F.size("centre_set") - F.col("common")
    return both.where(100 * F.col("common") >= PERCENT * union).select("rep", "centre").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b). Alternates two star contractions, each linear in the edges, until nothing moves; every round is written to the shared folder."""
    graph = materialize(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct(), "edges")
    seen = None
    while True:
        # large star: larger neighbours go to the least neighbour; small star: smaller neighbours and the node itself do
        both = graph.unionByName(graph.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("m", "hi").alias("m"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = large.where("hi != lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array("lo", "hi")).alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        graph = materialize(small, "edges")
        now = graph.agg(F.count("*"), F.sum("lo"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")), F.count_distinct("hi")).first()
        if now == seen or now[0] == now[3] and graph.join(graph.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty():
            return graph.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        seen = now


def _unsettled(members: DataFrame, joined: DataFrame, stars: int) -> DataFrame:
    """(doc_id, component) of the classes in a bucket that may hold a pair which is neither compared nor in one component. A bucket whose members are all apart has had every member compared with every centre, so small ones of these are settled."""
    of = members.select("bucket", (-F.col("minus_rep")).alias("doc_id")).join(joined.toDF("doc_id", "component").hint("merge"), "doc_id", "left")
    of = of.withColumn("component", F.coalesce("component", "doc_id"))
    parts = of.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("parts"))
    open_ = parts.where((F.col("parts") > 1) & ((F.col("n") > stars + 1) | (F.col("parts") < F.col("n"))))
    return of.join(open_.select("bucket").hint("merge"), "bucket", "left_semi").select("doc_id", "component").distinct()


def other_sides(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, component, ...) of keys with two components or more, repeated with (level, group, side): rows of a key whose level and group agree and whose sides differ are of different components. Two components of a key meet once, at the highest bit in which their numbers differ."""
    of = Window.partitionBy(key)
    ranks = rows.select(key, "component").distinct().withColumn("rank", F.row_number().over(of.orderBy("component")) - 1).withColumn("parts", F.count("*").over(of)).where("parts > 1")
    at = rows.join(ranks.hint("merge"), [key, "component"]).withColumn("level", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("parts") - 1)) - 1)))
    return at.withColumns({"group": F.expr("shiftright(rank, level + 1)"), "side": F.expr("shiftright(rank, level) & 1")}).drop("rank", "parts")


def _prefix_pairs(held: DataFrame) -> DataFrame:
    """All pairs (rep, centre) of different components in held(doc_id, component, shingles, marks of the sketch) that may be near: exact prefix filter, then the bound of the sketches. Shingles are ordered with those of one component first, which no such pair shares, then the rarer first; a near pair's first common shingle is in the prefix of both, and what follows it suffices in both."""
    one = held.select("doc_id", "component", F.xxhash64("shingles").alias("set"), F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"), *_MARKS)
    shared = one.groupBy("shingle").agg(F.count("*").alias("held"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("shingle", "held")
    own = Window.partitionBy("doc_id", "set")
    at = one.join(shared.hint("merge"), "shingle").withColumn("place", F.row_number().over(own.orderBy("held", "shingle"))).withColumn("rest", F.col("n") - (F.col("n") - F.count("*").over(own) + F.col("place") - 1))
    prefix = materialize(at.where(100 * F.col("rest") >= PERCENT * F.col("n")).select("shingle", "doc_id", "component", "n", "rest", *_MARKS), "prefixes")
    sided = other_sides(prefix, "shingle")
    # a shingle that many prefixes hold is split by adaptive execution, as any skewed key of a merge join: no row is copied for it here
    # a pair's smaller text has its first common shingle in a shorter prefix: its own half of the common ones is more of it
    short = (100 + PERCENT) * F.col("rest") >= 2 * PERCENT * F.col("n")
    sided = sided.select("shingle", "level", "group", "side", "doc_id", "n", "rest", *_MARKS)
    a = sided.where(short).select("shingle", "level", "group", "side", F.col("doc_id").alias("rep"), F.col("n").alias("rep_n"), F.col("rest").alias("rep_rest"), *(F.col(m).alias(f"rep_{m}") for m in _MARKS))
    b = sided.select("shingle", "level", "group", (1 - F.col("side")).alias("side"), F.col("doc_id").alias("centre"), "n", "rest", *_MARKS)
    both = a.join(b.hint("merge"), ["shingle", "level", "group", "side"])
    both = both.where((F.col("rep_n") < F.col("n")) | (F.col("rep_n") == F.col("n")) & (F.col("rep") < F.col("centre"))).where(100 * F.col("rep_n") >= PERCENT * F.col("n"))
    # of n + rep_n shingles so many must be common, and no more than what is left of either from here on can be
    both = both.where((100 + PERCENT) * F.least("rest", "rep_rest") >= PERCENT * (F.col("n") + F.col("rep_n")))
    # near sets of n + rep_n shingles differ in at most 15 of 185 parts of them, and in no fewer than their sketches do in bits
    differ = reduce(Column.__add__, (F.bit_count(F.col(m).bitwiseXOR(F.col(f"rep_{m}"))) for m in _MARKS))
    both = both.where((100 + PERCENT) * differ <= (100 - PERCENT) * (F.col("n") + F.col("rep_n")))
    return both.select("rep", "centre").distinct()


def near_duplicates(docs: DataFrame, stars: int = STARS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; kept is one document of each component, that with the smallest id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = materialize(docs.mapInArrow(_features, _FEATURES), "features")
    known = features.where("doc_id IS NOT NULL")
    one = known.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "set_key")).alias("s")).select("doc_id", "s.*")
    of_rep = known.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    of_rep = materialize(of_rep, "classes")
    members = mates = materialize(_members(of_rep), "members")
    # full sets of the classes that have a bucket mate, made once for all rounds
    wanted = members.select((-F.col("minus_rep")).alias("doc_id")).distinct()
    sets = docs.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets, _SETS)
    sketched = materialize(sets, "shingle-sets")
    sets = sketched.select("doc_id", "shingles")
    links = None
    for turn in range(1, stars + 1):
        star = materialize(_stars(members), "stars")
        alike = F.col("open") & (100 * F.least("n_shingles", "centre_n") >= PERCENT * F.greatest("n_shingles", "centre_n"))
        found = materialize(_confirmed(sets, star.where(alike).select("rep", "centre").distinct()), "links")
        links = found if links is None else links.unionByName(found)
        members = star.join(found.withColumn("linked", F.lit(True)).hint("merge"), ["rep", "centre"], "left")
        rank = F.col("degree") if turn < stars // 2 else F.xxhash64("bucket", "rep", F.lit(turn))
        members = members.select("bucket", rank.alias("degree"), "minus_rep", "n_shingles", (F.col("open") & F.col("linked").isNull()).alias("open"))
    joined = materialize(components(links.toDF("a", "b")), "star-components")
    # what the stars left: pairs of a bucket that are in different components, compared exactly
    rest = materialize(_unsettled(mates, joined, stars), "unsettled")
    pairs = _prefix_pairs(materialize(sketched.join(rest.hint("merge"), "doc_id"), "unsettled-sets"))
    late = materialize(_confirmed(sets, materialize(pairs, "prefix-pairs")), "links")
    if not late.isEmpty():
        joined = components(joined.toDF("a", "b").unionByName(late.toDF("a", "b")))
    classes = of_rep.select("set_key", "rep").join(joined, F.col("rep") == F.col("node"), "left")
    classes = classes.select("set_key", F.coalesce("component", "rep").alias("component"))
    out = one.join(classes, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    rest = features.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
