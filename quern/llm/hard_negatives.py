"""Hard negatives by exact search: clusters of anchors share lists of candidates sorted by an angular upper bound.

Anchors and candidates are put in the order of a coarse direction, so that a cluster (a run of at most GROUP anchors) and a block (a run
of at most BLOCK candidates) span small angles. A cluster has an axis and the largest angle of a member to it. With that a candidate
of length n at the angle p from the axis can have a product of at most |anchor| * n * cos(max(0, p - angle)) with any member. In each block
the candidates are sorted by this bound once for the whole cluster; every member walks the list, a chunk at a time, until the bound
certifies that nothing further on can enter its result. Results don't depend on the clusters, only the length of the walks does.

1. Each block gives, for the anchors that lie in it, the score that their last positive has at least.
2. Anchors meet all blocks: rows of the same label that reach this score; the first by score and id are the positives.
3. They meet all blocks again: rows of another label within the window of each positive; the first of these are the negatives.

A task holds one block and one pack of anchors. At most `positives`, or positives * negatives, rows of an anchor leave a task.

Defined results: rows without an id, a label or a vector, or with a component that is null or not finite, take no part; of rows that
share an id only the one with the smallest label and vector does; vectors of different widths count as if the shorter ones went on in
zeros; an anchor without positives, and a positive without negatives, gives no row; products that a long can't hold are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.llm.centroids import integer_vector
from quern.llm.shared import materialize

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A negative's score is at least LOW/100 and at most HIGH/100 of the positive's.
LOW, HIGH = 80, 100
#: Candidates of a block, anchors of a pack and of a cluster, and the first chunk of a walk.
BLOCK, PACK, GROUP, CHUNK = 5000, 2000, 64, 128
#: Coarse directions: axes fitted on a sample of at most SAMPLE vectors, the only rows that come to the driver.
AXES, SAMPLE = 32, 2048
_PACKED = "number long, ids binary, labels binary, vectors binary, extras binary"
#: Below every score that a product of two vectors can have.
NONE = -(2**62)


@dataclass(frozen=True)
class Mined:
    """positives(anchor_id, positive_id, place, positive_score); negatives with (rank, negative_id, negative_score) as well."""

    positives: DataFrame
    negatives: DataFrame


def prepared(df: DataFrame, id: str, label: Column, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, label, v) of the rows that take part, one for each id."""
    rows = df.select(F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), integer_vector(F.col(vector), scale).alias("v"))
    one = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
    return materialize(one.select("id", "r.*"), "vectors")


def units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


class Rows:
    """A pack of anchors or a block of candidates: ids, labels, vectors of longs (also as doubles, with their lengths), and `extras`, what else is known of each row."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, extras: np.ndarray) -> None:
        self.ids, self.labels, self.v, self.extras = ids, labels, v, extras
        self.f = v.astype(float)
        self.sizes = np.linalg.norm(self.f, axis=1)

    @classmethod
    def unpack(cls, row: dict, width: int) -> Rows:
        ids, labels, v, extras = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "vectors", "extras"))
        return cls(ids, labels, v.reshape(len(ids), width), extras.reshape(len(ids), -1))

    def at(self, places: np.ndarray) -> Rows:
        return Rows(self.ids[places], self.labels[places], self.v[places], self.extras[places])


def products(a: Rows, b: Rows, places: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Inner products of a's rows at places with b's at others, exact: in doubles where no sum can leave their 53 bits."""
    most = a.sizes.max(initial=0) * b.sizes.max(initial=0)
    if most < 2**52:
        return a.f[places] @ b.f[others].T
    if most >= 2**61:
        raise OverflowError("a product of two vectors needs more than a long")
    return a.v[places] @ b.v[others].T


def walk(anchors: Rows, candidates: Rows, certified: np.ndarray, seen: Callable) -> int:
    """Shows seen(members, places, scores), a chunk at a time, the candidates that may have a score of certified[member] or more for a member; seen raises certified as it learns. Returns how many scores were computed."""
    own = units(anchors.f)
    axis = units(own.sum(axis=0, keepdims=True))[0]
    spread = np.arccos(np.clip((own @ axis).min(), -1, 1))
    angle = np.arccos(np.clip((candidates.f @ axis) / np.where(candidates.sizes > 0, candidates.sizes, 1), -1, 1))
    # a little more than the bound, for the rounding of angles
    bound = candidates.sizes * np.minimum(1, np.cos(np.maximum(0, angle - spread)) + 1e-7)
    order = np.argsort(-bound, kind="stable")
    bound, at, size, done = bound[order], 0, CHUNK, 0
    while at < len(order):
        open_ = np.flatnonzero(anchors.sizes * bound[at] + 0.5 >= certified)
        if not len(open_):
            break
        places = order[at : at + size]
        seen(open_, places, products(anchors, candidates, open_, places))
        done += len(open_) * len(places)
        at, size = at + size, min(2 * size, 2048)
    return done


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, of equals the smaller ids."""
    near = np.arange(len(scores))
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


class Found:
    """The first k rows, by score and id, of those with a score of low to high."""

    def __init__(self, key: int, low: int, high: int, k: int) -> None:
        self.key, self.low, self.high, self.k = key, low, high, k
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        fit = (scores >= self.low) & (scores <= self.high)
        if fit.any():
            ids, scores = np.concatenate([self.ids, ids[fit]]), np.concatenate([self.scores, scores[fit].astype(np.int64)])
            first = _first(scores, ids, self.k)
            self.ids, self.scores = ids[first], scores[first]
            if len(first) == self.k:
                self.low = max(self.low, int(self.scores[-1]))


def collected(pack: Rows, block: Rows, wanted: Callable, same: bool) -> list[tuple[int, Found]]:
    """(anchor, Found) of every anchor of the pack and every one of the empty Founds that wanted(extras of the anchor) asks for, over the block's other rows of the anchor's label (same) or those of other labels."""
    out = []
    for lo in range(0, len(pack.ids), GROUP):
        asked = [(m, w) for m in range(lo, min(lo + GROUP, len(pack.ids))) if (w := wanted(pack.extras[m]))]
        if not asked:
            continue
        group = pack.at(np.array([m for m, _ in asked]))
        certified = np.array([min(f.low for f in w) for _, w in asked], float)

        def seen(open_: np.ndarray, places: np.ndarray, scores: np.ndarray, asked=asked, group=group, certified=certified) -> None:
            ids, labels = block.ids[places], block.labels[places]
            for row in np.flatnonzero(scores.max(axis=1) >= certified[open_]):
                m = open_[row]
                fit = np.flatnonzero((scores[row] >= certified[m]) & ((labels == group.labels[m]) == same) & (ids != group.ids[m]))
                if len(fit):
                    for f in asked[m][1]:
                        f.add(ids[fit], scores[row][fit])
                    certified[m] = min(f.low for f in asked[m][1])

        walk(group, block, certified, seen)
        out += [(int(group.ids[n]), f) for n, (_, w) in enumerate(asked) for f in w if len(f.ids)]
    return out


def _axes(rows: DataFrame, width: int) -> np.ndarray:
    """Unit axes from a few rounds of spherical means over a bounded sample, the ids of the smallest hashes; results don't depend on them."""
    held = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).collect()
    x = np.zeros((max(1, len(held)), width))
    for i, r in enumerate(held):
        x[i, : len(r.v)] = r.v
    x = units(x)
    axes = x[:AXES]
    for _ in range(4):
        at = (x @ axes.T).argmax(axis=1)
        axes = np.stack([units(x[at == n].sum(axis=0, keepdims=True))[0] if (at == n).any() else axes[n] for n in range(len(axes))])
    return axes


def _dense(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as longs, the shorter ones filled up with zeros."""
    sizes, flat = np.asarray(column.value_lengths()), np.asarray(column.flatten(), np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _directed(axes: np.ndarray, width: int) -> Callable:
    """Adds the number of the nearest axis and the cosine to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = units(_dense(batch.column("v"), width).astype(float)) @ axes.T
            at = cos.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(cos[np.arange(len(at)), at])], [*batch.schema.names, "axis", "cos"])

    return run


def _in_runs(df: DataFrame, rows: int, width: int, name: str) -> tuple[DataFrame, int]:
    """df(id, label, v, extras, axis, cos) in the order of directions, packed into numbered runs of at most `rows`, and how many runs there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                held = (*(np.asarray(part.column(c), np.int64) for c in ("id", "label")), _dense(part.column("v"), width), np.asarray(part.column("extras").flatten(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([base + n]), *(pa.array([x.tobytes()], pa.binary()) for x in held)], ["number", "ids", "labels", "vectors", "extras"])
                n += 1

    order = ("axis", "cos", "id")
    packs = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _PACKED), name)
    # a number stands for thousands of rows
    places = packs.select("number").withColumn("place", F.row_number().over(Window.orderBy("number")) - 1)
    return packs.join(places, "number"), packs.count()


def _met(packs: tuple[DataFrame, int], blocks: tuple[DataFrame, int], width: int, wanted: Callable, same: bool) -> DataFrame:
    """(anchor, key, id, score) of collected() over every pack and block. A pack is sent once for each block and a block once for each pack: both are of bounded size, and packs are a stated set of queries."""
    (a, n), (b, m) = packs, blocks
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(max(count - 1, 0))))
    of = ("ids", "labels", "vectors", "extras")
    both = a.select(F.col("place").alias("i"), every(m).alias("j"), F.lit(0).alias("side"), *of).unionByName(b.select(every(n).alias("i"), F.col("place").alias("j"), F.lit(1).alias("side"), *of))

    def run(table: pa.Table) -> pa.Table:
        sides = {r["side"]: Rows.unpack(r, width) for r in table.to_pylist()}
        found = collected(sides[0], sides[1], wanted, same) if len(sides) == 2 else []
        per = [len(f.ids) for _, f in found]
        none = [np.zeros(0, np.int64)]
        return pa.table({
            "anchor": np.repeat(np.array([a for a, _ in found], np.int64), per), "key": np.repeat(np.array([f.key for _, f in found], np.int64), per),
            "id": np.concatenate([f.ids for _, f in found] or none), "score": np.concatenate([f.scores for _, f in found] or none),
        })

    return both.groupBy("i", "j").applyInArrow(run, "anchor long, key long, id long, score long")


def _ranked(found: DataFrame, by: tuple[str, ...], k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> Mined:
    """Positives and hard negatives of the anchors among rows(id, label, v), as prepared() gives them."""
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    axes = _axes(rows, width)
    flagged = rows.withColumn("extras", F.array(is_anchor.cast("long")))
    near = flagged.mapInArrow(_directed(axes, width), "id long, label long, v array<long>, extras array<long>, axis int, cos double")
    blocks = _in_runs(near, BLOCK, width, "blocks")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The anchors of a block, each with the score of its last positive there."""
        for batch in batches:
            for row in batch.to_pylist():
                block = Rows.unpack(row, width)
                own = block.at(np.flatnonzero(block.extras[:, 0]))
                found = {a: f.low for a, f in collected(own, block, lambda _: [Found(0, NONE, -NONE, positives)], True)}
                columns = [pa.array(own.ids), pa.array(own.labels), pa.array(list(own.v), pa.list_(pa.int64())), pa.array([[found.get(a, NONE)] for a in own.ids.tolist()], pa.list_(pa.int64()))]
                yield from _directed(axes, width)(iter([pa.RecordBatch.from_arrays(columns, ["id", "label", "v", "extras"])]))

    anchors = materialize(blocks[0].select("ids", "labels", "vectors", "extras").mapInArrow(seeds, near.schema), "anchors")
    packs = _in_runs(anchors, PACK, width, "packs")
    top = _met(packs, blocks, width, lambda x: [Found(0, int(x[0]), -NONE, positives)], True)
    top = materialize(_ranked(top, ("anchor",), positives), "positives")
    scores = top.groupBy(F.col("anchor").alias("id")).agg(F.collect_set("score").alias("scores"))
    filled = F.concat("scores", F.array_repeat(F.lit(NONE), positives - F.size("scores")))
    asked = _in_runs(anchors.drop("extras").join(scores, "id").select("id", "label", "v", filled.alias("extras"), "axis", "cos"), PACK, width, "asked")

    def windows(scores: np.ndarray) -> list[Found]:
        """None where the window is empty, as it is for negative scores."""
        bounds = ((s, -(-low * s // 100), high * s // 100) for s in scores.tolist() if s != NONE)
        return [Found(s, a, b, negatives) for s, a, b in bounds if a <= b]

    found = materialize(_ranked(_met(asked, blocks, width, windows, False), ("anchor", "key"), negatives), "negatives")
    pos = top.select(F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("rank").alias("place"), F.col("score").alias("positive_score"))
    neg = found.select(F.col("anchor").alias("anchor_id"), F.col("key").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return Mined(pos, pos.join(neg, ["anchor_id", "positive_score"]))
