"""Centroid clustering and hard negatives against plain versions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import centroids, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, v string"


def vector_rows(n=240, width=64, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, width)) * 0.7
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n // 2 : n // 2 + 40] = x[0]  # one vector many times
    rows = [(i, [float(c) for c in x[i]], int(rng.integers(0, 4)), 7, "clash") for i in range(n)]
    return rows


ODD = [
    (None, [0.5] * 64, 1, None, None), (1000, None, 1, 1, "a"), (1001, [], 1, 1, "a"), (1002, [0.1] * 63, 1, 1, "a"), (1003, [0.1] * 65, 2, 1, "a"), (1004, [0.1] * 63 + [None], 1, 1, "a"),
    (1005, [0.1] * 63 + [float("nan")], 1, 1, "a"), (1006, [0.1] * 63 + [float("-inf")], 1, 1, "a"), (1007, [0.0] * 64, 1, 1, "a"), (1100, [0.25] * 64, None, 1, "a"), (1200, [0.0] * 64, 2, 1, "a"),
]


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in start]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((d(v, c), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for n in range(len(cents)):
            own = [v for a, (_, v) in zip(at, kept) if a == n]
            if own:
                cents[n] = [sum(c) // len(own) for c in zip(*own)]
    final = [(i, *near(v)) for i, v in kept]
    of = {n: sum(x[1] for x in final if x[2] == n) for n in range(len(cents))}
    return sorted(((i, n, s, of[n], sum(of.values()), cents[n]) for i, s, n in final), key=str)


@pytest.mark.parametrize("rows", [vector_rows() + ODD + vector_rows()[:5], vector_rows(7), ODD[:1]])
def test_clusters_equal_a_plain_version(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in centroids.cluster_vectors(df, "vec_id", "embedding").collect()]
    expected = plain_clusters(rows) if rows != ODD[:1] else []
    assert sorted(((*r[:5], list(r[5])) for r in got if r[1] is not None), key=str) == expected


def test_clusters_of_an_empty_table_and_of_unit_rounds(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster_vectors(empty, "vec_id", "embedding").collect() == []
    two = spark.createDataFrame([(1, [-0.51, 0.0], 0, 0, ""), (2, [1.0, 1.0], 0, 0, "")], SCHEMA)
    got = {r.id: r for r in centroids.cluster_vectors(two, "vec_id", "embedding", width=2, scale=2, k=1, rounds=1).collect()}
    # (-2, 0) and (2, 2): the floor of the mean is (0, 1)
    assert (list(got[1].centroid), got[1].distance, got[2].distance, got[1].inertia) == ([0, 1], 5, 5, 10)
    with pytest.raises(Exception, match="(?i)overflow"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e18, 0.0], 0, 0, ""), (2, [-1e18, 1.0], 0, 0, "")], SCHEMA), "vec_id", "embedding", width=2).collect()


def plain_negatives(rows, positives=5, negatives=5):
    kept = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        value = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        kept[i] = min(kept.get(i, value), value)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in (i for i in kept if i % 10 == 0):
        score = {i: dot(kept[a][1], v) for i, (_, v) in kept.items() if i != a}
        first = sorted((-s, i) for i, s in score.items() if kept[i][0] == kept[a][0])[:positives]
        for ps, p in ((-s, i) for s, i in first):
            fit = sorted((-s, i) for i, s in score.items() if kept[i][0] != kept[a][0] and 80 * ps <= 100 * s <= 100 * ps)[:negatives]
            out += [(a, p, rank, i, ps, -s) for rank, (s, i) in enumerate(fit, 1)]
    return sorted(out)


@pytest.fixture
def small_runs(monkeypatch):
    for name, value in {"BLOCK": 37, "PACK": 9, "GROUP": 4, "CHUNK": 5}.items():
        monkeypatch.setattr(hard_negatives, name, value)


@pytest.mark.parametrize("parts", [1, 6])
def test_negatives_equal_a_plain_version(spark, small_runs, parts):
    rows = vector_rows() + ODD + vector_rows(20, seed=9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    found = hard_negatives.mine(hard_negatives.prepared(df, "vec_id", F.col("label"), "embedding"), F.col("id") % 10 == 0).negatives
    got = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found.collect())
    assert got == plain_negatives(rows) and len(got) > 300


def test_negatives_of_few_rows(spark):
    for rows in ([], ODD[:2], [(0, [1.0], 1, 0, "")], [(0, [-1.0, 0.5], 1, 0, ""), (3, [1.0], 1, 0, ""), (5, [1.0], 2, 0, "")]):
        df = spark.createDataFrame(rows, SCHEMA)
        found = hard_negatives.mine(hard_negatives.prepared(df, "vec_id", F.col("label"), "embedding"), F.col("id") % 10 == 0)
        assert found.negatives.collect() == []
    assert [tuple(r) for r in found.positives.collect()] == [(0, 3, 1, -65536)]


def test_walks_end_early_and_large_products_are_exact():
    rng = np.random.default_rng(1)
    make = lambda v: hard_negatives.Rows(np.arange(len(v)), np.zeros(len(v), int), v, np.zeros((len(v), 1), int))
    near, far = rng.normal(size=(1, 32)), rng.normal(size=(40, 32))
    x = np.concatenate([near + rng.normal(size=(200, 32)) * 0.05, *(c + rng.normal(size=(100, 32)) * 0.05 for c in far)])
    rows = make((256 * x).astype(np.int64))
    anchors = rows.at(np.arange(20))
    found = [hard_negatives.Found(0, hard_negatives.NONE, 2**62, 5) for _ in range(20)]
    certified = np.full(20, float(hard_negatives.NONE))

    def seen(open_, places, scores):
        for row, m in enumerate(open_):
            found[m].add(places, scores[row])
            certified[m] = found[m].low

    done = hard_negatives.walk(anchors, rows, certified, seen)
    whole = anchors.v @ rows.v.T
    assert all(f.scores.tolist() == sorted(w.tolist(), reverse=True)[:5] for f, w in zip(found, whole, strict=True))
    assert done < 0.5 * whole.size
    big = make(rng.integers(-(2**28), 2**28, (6, 8)))
    exact = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in big.v] for x in big.v]
    assert hard_negatives.products(big, big, np.arange(6), np.arange(6)).tolist() == exact
    with pytest.raises(OverflowError):
        huge = make(np.full((2, 4), 2**31))
        hard_negatives.products(huge, huge, np.arange(2), np.arange(2))
