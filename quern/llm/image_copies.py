"""Local image descriptors: corners at several scales, orientation-normalised binary tests, Hamming tables, geometric consensus.

Images are grey, given as (image_id, height, width, pixels) with one byte per pixel. Within a task every corner that is the strongest
in its neighbourhood, at each scale of a pyramid, gets a descriptor: 128 comparisons of smoothed pixels around it, turned to its
orientation, in four words of 32 bits. Each of four Hamming tables holds two words of every descriptor, so that descriptors of a copy
that differ in few bits meet in some bucket.

Pairs of images that share buckets at two corners or more are candidates. First every bucket's members meet its centre, the smallest
image; then members of different classes meet, members of one never, so that the copies of one picture don't make all their pairs.
A candidate is checked on all descriptors of both images: matches, the nearest of each other, may differ in few bits, and enough of them
must agree on one rotation, scale and shift. A copy's class is the smallest image_id reachable.

Defined results: a null, empty or mis-sized image, and one too small for a patch, has no corners and is alone in its class; exact
copies of an image's bytes share a class without matching; rows that repeat an image_id are one image, and rows without one are left
out; other columns are not read. An image whose longer side exceeds LONGEST is described from its reduction to that side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm.near_dedup import components, other_sides
from quern.llm.shared import materialize
from quern.llm.textops import mix

#: Ratio of a pyramid's scales, pixels that a corner is the strongest of on either side, reach of a patch, and longest side.
RATIO, APART, RADIUS, TESTS, LONGEST = 0.7, 4, 11, 128, 640
#: Words of a descriptor that each Hamming table is keyed by.
TABLES = ((0, 1), (1, 2), (2, 3), (3, 0))
#: Bits of 128 in which two descriptors of a match may differ.
HAMMING = 24
#: Matches that must agree on rotation, scale and shift, and how near they must be to agree.
VOTES, TURN, STEP, SHIFT = 4, np.pi / 12, 0.2, 5.0
IMAGE = "image_id long, height int, width int, pixels binary"
_DESCRIBED = "image_id long, sha string, corners binary"
_CORNER = np.dtype([("place", "<f4", 4), ("bits", "<u4", 4)])
_rng = np.random.default_rng(11)
_POINTS = np.clip(_rng.normal(0, RADIUS / 2, (TESTS, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7)


def _smooth(image: np.ndarray, k: int) -> np.ndarray:
    """Mean over (2k+1) x (2k+1) pixels, edges repeated."""
    sums = np.pad(np.pad(image, k, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = 2 * k + 1
    return (sums[n:, n:] - sums[:-n, n:] - sums[n:, :-n] + sums[:-n, :-n]) / n**2


def _scaled(image: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return image
    ys, xs = (np.minimum((np.arange(int(n * scale)) + 0.5) / scale - 0.5, n - 1.001) for n in image.shape)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    at = lambda a, b: image[np.ix_(y0 + a, x0 + b)]
    return (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy


def corners(image: np.ndarray) -> np.ndarray:
    """The corners of an image, of all scales: place is x, y, turn and scale in the image's own pixels, bits the descriptor."""
    out, edge = [np.zeros(0, _CORNER)], RADIUS + 1
    scale = min(1.0, LONGEST / max(image.shape))
    while min(image.shape) * scale >= 2 * edge + 2:
        small = _scaled(image.astype(float), scale)
        h, w = small.shape
        gy, gx = np.gradient(_smooth(small, 1))
        a, b, c = _smooth(gx * gx, 2), _smooth(gy * gy, 2), _smooth(gx * gy, 2)
        strength = a * b - c * c - 0.05 * (a + b) ** 2
        side = 2 * APART + 1
        around = np.lib.stride_tricks.sliding_window_view(np.pad(strength, APART, constant_values=-np.inf), (side, side)).max((2, 3))
        ys, xs = np.nonzero((strength == around)[edge : h - edge, edge : w - edge] & (strength[edge : h - edge, edge : w - edge] > 1e-3))
        ys, xs = ys + edge, xs + edge
        dy, dx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
        disc = dy**2 + dx**2 <= RADIUS**2
        patch = small[ys[:, None] + dy[disc], xs[:, None] + dx[disc]]
        turn = np.arctan2((patch * dy[disc]).sum(1), (patch * dx[disc]).sum(1))
        soft, cos, sin = _smooth(small, 2), np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
        px = xs[:, None, None] + _POINTS[..., 0] * cos - _POINTS[..., 1] * sin
        py = ys[:, None, None] + _POINTS[..., 0] * sin + _POINTS[..., 1] * cos
        value = soft[np.clip(np.rint(py), 0, h - 1).astype(int), np.clip(np.rint(px), 0, w - 1).astype(int)]
        found = np.zeros(len(xs), _CORNER)
        found["place"] = np.stack([(xs + 0.5) / scale, (ys + 0.5) / scale, turn, np.full(len(xs), 1 / scale)], axis=1)
        found["bits"] = np.packbits(value[..., 0] < value[..., 1], axis=1).view("<u4")
        out.append(found)
        scale *= RATIO
    return np.concatenate(out)


def votes(one: np.ndarray, other: np.ndarray, hamming: int = HAMMING) -> int:
    """The most corners whose matches agree on the rotation, scale and shift that take the other image to this one. A match is nearest to each other from either side."""
    if not len(one) or not len(other):
        return 0
    differ = np.concatenate([np.bitwise_count(one["bits"][lo : lo + 256, None] ^ other["bits"][None]).sum(2, dtype=np.uint8) for lo in range(0, len(one), 256)])
    fits = (differ == differ.min(1, keepdims=True)) & (differ == differ.min(0, keepdims=True)) & (differ <= hamming)
    i, j = np.nonzero(fits)
    if len(i) < VOTES:
        return 0
    m, c = one["place"][i].astype(float), other["place"][j].astype(float)
    turn, s = m[:, 2] - c[:, 2], m[:, 3] / c[:, 3]
    dx = m[:, 0] - s * (np.cos(turn) * c[:, 0] - np.sin(turn) * c[:, 1])
    dy = m[:, 1] - s * (np.sin(turn) * c[:, 0] + np.cos(turn) * c[:, 1])
    by_j = np.argsort(j, kind="stable")
    runs = [np.flatnonzero(np.diff(x, prepend=-1)) for x in (i, j[by_j])]
    best = 0
    for lo in range(0, len(i), 256):
        of = slice(lo, lo + 256)
        apart = lambda x: np.abs(x[of, None] - x[None])
        agree = (apart(dx) <= SHIFT) & (apart(dy) <= SHIFT) & (apart(np.log(s)) <= STEP) & (np.abs((apart(turn) + np.pi) % (2 * np.pi) - np.pi) <= TURN)
        distinct = [np.logical_or.reduceat(x, run, axis=1).sum(1) for x, run in ((agree, runs[0]), (agree[:, by_j], runs[1]))]
        best = max(best, int(np.minimum(*distinct).max()))
    return best


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for h, w, pixels in zip(*(batch.column(c).to_pylist() for c in ("height", "width", "pixels")), strict=True):
            good = pixels and h and w and h > 0 and w > 0 and h * w == len(pixels)
            found.append(corners(np.frombuffer(pixels, np.uint8).reshape(h, w)).tobytes() if good else b"")
        yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("sha"), pa.array(found, pa.binary())], ["image_id", "sha", "corners"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = batch.column("corners").to_pylist()
        n = np.array([len(b) // _CORNER.itemsize for b in blobs], np.int64)
        bits = np.frombuffer(b"".join(blobs), _CORNER)["bits"].astype(np.uint64)
        image, corner = np.repeat(np.array(batch.column("image_id")), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for table, (a, b) in enumerate(TABLES):
            key = mix(mix(bits[:, a] << np.uint64(32) | bits[:, b]) + np.uint64(table + 1))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(image), pa.array(corner.astype(np.int32))], ["key", "image_id", "corner"])


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("a_corners"), batch.column("b_corners"), strict=True)
        found = [votes(*(np.frombuffer(x.as_buffer(), _CORNER) for x in pair)) for pair in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.int32())], ["a", "b", "votes"])


def _at_two_corners(meetings: DataFrame) -> DataFrame:
    """(a, b) of meetings(a, a_corner, b, b_corner) that name two corners of either image or more."""
    ends = [f(c).alias(f"{f.__name__}_{c[0]}") for c in ("a_corner", "b_corner") for f in (F.min, F.max)]
    return meetings.groupBy("a", "b").agg(*ends).where("min_a < max_a AND min_b < max_b").select("a", "b")


def checked(pairs: DataFrame, described: DataFrame, least: int = VOTES) -> DataFrame:
    """(a, b, votes) of those pairs of which enough matches agree."""
    of = described.select("image_id", "corners")
    both = pairs.join(of.toDF("a", "a_corners").hint("merge"), "a").join(of.toDF("b", "b_corners").hint("merge"), "b")
    return both.mapInArrow(_check, "a long, b long, votes int").where(F.col("votes") >= least)


def buckets(described: DataFrame) -> DataFrame:
    """(key, image_id, corner, c_image, c_corner) of the buckets with two images or more: every member with its bucket's centre, the smallest image."""
    members = described.select("image_id", "corners").mapInArrow(_keys, "key long, image_id long, corner int")
    centre = members.groupBy("key").agg(F.min(F.struct("image_id", "corner")).alias("c"), F.max("image_id").alias("last")).where("last > c.image_id")
    return members.join(centre.select("key", F.col("c.image_id").alias("c_image"), F.col("c.corner").alias("c_corner")).hint("merge"), "key")


def image_copies(images: DataFrame, least: int = VOTES) -> DataFrame:
    """(image_id, n_corners, n_links, component_id) of every image: its corners, its links with other images that were found on the way to the classes, and its class."""
    keyed = images.where("image_id IS NOT NULL").select(F.col("image_id").cast("long").alias("image_id"), "height", "width", "pixels")
    one = F.sha2(F.coalesce(F.concat(F.encode(F.concat_ws("x", "height", "width"), "utf-8"), F.col("pixels")), F.col("image_id").cast("string").cast("binary")), 256)
    same = materialize(keyed.select("image_id", one.alias("sha")).groupBy("image_id").agg(F.min("sha").alias("sha")), "image-classes")
    rep = same.groupBy("sha").agg(F.min("image_id").alias("rep"))
    described = keyed.withColumn("sha", one).mapInArrow(_describe, _DESCRIBED)
    described = described.join(rep.select(F.col("rep").alias("image_id"), "sha"), ["image_id", "sha"], "left_semi").dropDuplicates(["image_id"])
    described = materialize(described, "corners")
    met = materialize(buckets(described), "buckets")
    stars = met.where("image_id != c_image").select(F.col("c_image").alias("a"), F.col("c_corner").alias("a_corner"), F.col("image_id").alias("b"), F.col("corner").alias("b_corner"))
    stars = materialize(_at_two_corners(stars), "image-pairs")
    links = materialize(checked(stars, described, least), "image-links")
    # members of different classes meet in every bucket that holds them
    of = components(links.select("a", "b")).toDF("image_id", "component")
    held = met.select("key", "image_id", "corner").join(of.hint("merge"), "image_id", "left").withColumn("component", F.coalesce("component", "image_id"))
    sides = other_sides(held, "key").select("key", "level", "group", "side", "image_id", "corner")
    left = sides.where("side = 0").drop("side").withColumnsRenamed({"image_id": "a", "corner": "a_corner"})
    right = sides.where("side = 1").drop("side").withColumnsRenamed({"image_id": "b", "corner": "b_corner"})
    meetings = left.join(right.hint("merge"), ["key", "level", "group"])
    ordered = F.col("a") < F.col("b")
    meetings = meetings.select(
        F.least("a", "b").alias("a"), F.when(ordered, F.col("a_corner")).otherwise(F.col("b_corner")).alias("a_corner"),
        F.greatest("a", "b").alias("b"), F.when(ordered, F.col("b_corner")).otherwise(F.col("a_corner")).alias("b_corner"),
    )
    late = materialize(_at_two_corners(meetings).join(stars.hint("merge"), ["a", "b"], "left_anti"), "image-pairs")
    links = links.unionByName(materialize(checked(late, described, least), "image-links"))
    joined = components(links.select("a", "b"))
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    n = described.select(F.col("image_id").alias("rep"), F.expr(f"length(corners) div {_CORNER.itemsize}").alias("n_corners"))
    of_rep = rep.join(joined, F.col("rep") == F.col("node"), "left").join(n, "rep", "left").join(ends, "rep", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    of_rep = of_rep.select("sha", zero("n_corners"), zero("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return same.join(of_rep, "sha").select("image_id", "n_corners", "n_links", "component_id")


# ---- images of the embeddings table -------------------------------------------------------------------------------------------

SIDE = 72


def _waves() -> np.ndarray:
    """64 plane waves over the square, of growing frequency."""
    y, x = np.mgrid[0:SIDE, 0:SIDE] / SIDE
    rng = np.random.default_rng(5)
    turn, phase, speed = rng.uniform(0, np.pi, 64), rng.uniform(0, 2 * np.pi, 64), np.linspace(2, 9, 64)
    return np.stack([np.cos(2 * np.pi * s * (np.cos(t) * x + np.sin(t) * y) + p).ravel() for t, p, s in zip(turn, phase, speed, strict=True)])


def _edit(image: np.ndarray, kind: int) -> np.ndarray:
    """0: as it is; 1: cropped; 2: darker, with a mark; 3: turned and cropped."""
    if kind == 1:
        return image[9 : SIDE - 4, 12:]
    if kind == 2:
        out = (image * 0.8).astype(np.uint8)
        out[:12, :12] = 255
        return out
    return np.rot90(image)[5:, : SIDE - 6] if kind == 3 else image


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waves = _waves()
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            x = np.array(part.column("embedding").flatten(), float).reshape(part.num_rows, 64) @ waves
            grey = (127.5 + 110 * np.tanh(1.5 * x / np.maximum(x.std(axis=1, keepdims=True), 1e-9))).astype(np.uint8).reshape(-1, SIDE, SIDE)
            out = [np.ascontiguousarray(_edit(g, k)) for g, k in zip(grey, part.column("kind").to_pylist(), strict=True)]
            columns = [part.column("image_id"), pa.array([o.shape[0] for o in out], pa.int32()), pa.array([o.shape[1] for o in out], pa.int32()), pa.array([o.tobytes() for o in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in IMAGE.split(", ")])


def rendered(embeddings: DataFrame) -> DataFrame:
    """An image for each row of embeddings(vec_id, embedding): ids that end in 1, 2, 3 are edited copies of the image whose id ends in 0; the tables hold no images."""
    ids = embeddings.select("vec_id", F.when(F.col("vec_id") % 10 < 4, F.col("vec_id") % 10).otherwise(0).cast("int").alias("kind"))
    source = embeddings.where(F.size("embedding") == 64).select(F.col("vec_id").alias("source"), "embedding")
    rows = ids.join(source, F.col("vec_id") - F.col("kind") == F.col("source"))
    return rows.select(F.col("vec_id").cast("long").alias("image_id"), "kind", "embedding").mapInArrow(_render, IMAGE)
