import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators.blocks import nearest, packed, similarity_edges, top_k
from quern.operators.dedup import deduplicate, emptied_sources, greedy_semantic_dedup
from quern.operators.evaluation import chunk_coherence, nearest_neighbor
from quern.operators.metrics import chunk_length_stats, quantiles, redundancy_by_policy
from quern.operators.retrieval import retrieve


def clones(seed, n=300, dim=16):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[200:230] = v[50:80]
    v[100:103] = v[10]
    v[299] = 0
    return v, np.round(rng.uniform(size=n), 2)


def frame(spark, v, score=None):
    rows = [(i, [float(x) for x in r], None if score is None else float(score[i])) for i, r in enumerate(v)]
    return spark.createDataFrame(rows, "pos long, embedding array<double>, semantic_score double")


def sequential(v, score, threshold):
    kept, winners = [], {}
    for i in sorted(range(len(v)), key=lambda i: (-score[i], i)):
        sims = [(float(v[i] @ v[k]), -j, k) for j, k in enumerate(kept)]
        best = max(sims, default=None)
        if best and best[0] >= threshold:
            winners[i] = best[2]
        else:
            kept.append(i)
    return set(kept), winners


@pytest.mark.parametrize(("seed", "threshold", "parts"), [(7, 0.93, 1), (11, 0.6, 16), (3, 0.45, 4)])
def test_greedy_is_the_sequential_loop(spark, seed, threshold, parts):
    v, score = clones(seed)
    kept, winners = sequential(v, score, threshold)
    out = greedy_semantic_dedup(frame(spark, v, score).repartition(parts), threshold)
    assert {r.pos for r in out.kept.collect()} == kept
    got = {r.pos: r for r in out.dropped.collect()}
    assert set(got) == set(winners)
    for i, r in got.items():
        assert r.sim == pytest.approx(float(v[i] @ v[winners[i]]), abs=1e-9)


def test_kernels_match_brute_force(spark):
    v, _ = clones(5)
    sims = v @ v.T
    np.fill_diagonal(sims, -np.inf)
    blocks = packed(frame(spark, v).repartition(5), "pos", "embedding", 40)
    assert blocks[1] >= 5
    got = {r.id: r for r in nearest(blocks).collect()}
    for i in range(len(v)):
        assert got[i].sim == pytest.approx(sims[i].max(), abs=1e-12)
    edges = {(min(r.a, r.b), max(r.a, r.b)) for r in similarity_edges(blocks, 0.5).collect()}
    assert edges == {(i, j) for i in range(300) for j in range(i + 1, 300) if sims[i, j] >= 0.5}
    asked = packed(frame(spark, v[:20]), "pos", "embedding", 7)
    top = {}
    for r in top_k(asked, blocks, 5).collect():
        top.setdefault(r.query, []).append((r.rank, r.sim))
    for q, hits in top.items():
        assert [s for _, s in sorted(hits)] == pytest.approx(sorted(v[q] @ v.T, reverse=True)[:5])


def test_single_and_empty(spark):
    one = frame(spark, np.ones((1, 4)))
    row = nearest_neighbor(one, 0.9).first()
    assert (row.sim, row.neighbor, row.is_duplicate) == (0.0, None, False)
    none = greedy_semantic_dedup(one.limit(0), 0.9)
    assert none.kept.count() == 0 and none.dropped.count() == 0


def test_cut_and_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0, 1.0, 1.0, 0.5],), ([0.0, 0.0, 0.0, 1.0, 0.0],), ([1.0, 2.0],)], "v array<double>")
    cut = [r.c for r in df.select(V.cut_dim(F.col("v"), 3).alias("c")).collect()]
    assert np.linalg.norm(cut[0]) == pytest.approx(1) and cut[1] == [0, 0, 0] and cut[2] == [1, 2]
    assert df.limit(1).select(V.cosine(F.col("v"), F.transform("v", lambda x: x * 0)).alias("c")).first().c == 0


def policy_rows(spark):
    rows = [
        (0, "s", 0, "exact_key", "E1", None, [1.0, 0.0], 0.5), (1, "s", 1, "exact_key", "E2", None, [1.0, 0.001], 0.5), (2, "s", 2, "exact_key", "E1", None, [0.0, 1.0], 0.5),
        (3, "t", 0, None, None, None, [1.0, 0.0], 0.4), (4, "t", 1, None, None, None, [1.0, 0.0], 0.9), (5, "u", 0, "semantic_optional", None, None, [1.0, 0.01], 0.3),
        (6, "v", 0, "group_only", None, "g", [0.0, 1.0], 0.1), (7, "v", 1, "group_only", None, "g", [0.0, 1.0], 0.1), (8, "w", 0, "exact_only", None, None, [0.0, 1.0], None),
    ]
    names = "pos long, source string, doc_id int, dedup_policy string, entity_key string, group_key string, embedding array<double>, semantic_score double"
    return spark.createDataFrame(rows, names).withColumns({"chunk_index": F.lit(0), "row": F.col("doc_id"), "page_content": F.concat(F.lit("text\n"), "source")})


def test_policies_and_events(spark):
    rows = policy_rows(spark)
    out = deduplicate(rows, 0.93)
    assert {r.pos for r in out.kept.collect()} == {0, 1, 4, 6, 8}
    events = {r.global_id: r for r in out.events.collect()}
    assert set(events) == {2, 3, 5, 7}
    assert events[2].motivo == "dedup_clave" and events[2].claves.entity_key == "E1" and events[2].pareja is None
    assert events[3].motivo == "dedup_coseno" and events[3].pareja.global_id == 4 and events[3].pareja.snip == "text t"
    gone = {r.fuente: r for r in emptied_sources(rows, out.kept, out.events).collect()}
    assert set(gone) == {"u"} and gone["u"].motivo == "dedup_coseno"


@pytest.mark.parametrize("few", [4096, 5])
def test_retrieve_both_ways(spark, monkeypatch, few):
    monkeypatch.setattr("quern.operators.retrieval.FEW", few)
    v, _ = clones(9)
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    asked = frame(spark, v[:20]).withColumnRenamed("pos", "query_id")
    got = {}
    for r in retrieve(asked, frame(spark, v).repartition(7), 6).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.pos, r.distance))
    for i in range(20):
        sims = np.round(unit @ unit[i], 9)
        assert {p for p, _ in got[i]} == set(np.lexsort((np.arange(300), -sims))[:6].tolist()) or len(set(sims[[p for p, _ in got[i]]])) < 6
        assert [d for _, d in got[i]] == pytest.approx(sorted(1 - unit @ unit[i])[:6], abs=1e-9)
    assert len(retrieve(asked, frame(spark, v).limit(2), 6).collect()) == 40
    assert retrieve(asked, frame(spark, v).limit(0), 6).count() == retrieve(asked.limit(0), frame(spark, v), 6).count() == 0


def test_quantiles_by_group(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=101), "b": rng.normal(size=4), "": rng.normal(size=1)}
    rows = [(p or None, float(x)) for p, xs in values.items() for x in xs] + [("b", None), ("none", None)]
    df = spark.createDataFrame(rows, "dedup_policy string, redundancy double").repartition(5)
    out = {r.policy: r for r in redundancy_by_policy(df, 0.0).collect()}
    assert set(out) == {"a", "b", "semantica", "none"} and out["none"].p50 is None and out["b"].n == 5
    for p, xs in values.items():
        r = out[p or "semantica"]
        assert (r.p50, r.p90) == pytest.approx(tuple(np.quantile(xs, [0.5, 0.9])))
    whole = quantiles(df, "redundancy", {"p25": 0.25, "p75": 0.75}).first()
    assert tuple(whole) == pytest.approx(tuple(np.quantile(np.concatenate(list(values.values())), [0.25, 0.75])))
    assert quantiles(df.limit(0), "redundancy", {"p50": 0.5}).first().p50 is None


def test_quartiles(spark):
    import statistics

    lengths = [3, 9, 10, 40, 41, 77, 90]
    df = spark.createDataFrame([("x" * n, "no_chunk" if n > 50 else None) for n in lengths], "page_content string, chunking_hint string")
    r = chunk_length_stats(df).first()
    assert [r.p25, r.p50, r.p75] == statistics.quantiles(lengths, n=4) and r.n_short == 5 and r.n_whole == 2
    few = chunk_length_stats(df.limit(3)).first()
    assert few.p25 == few.p50 == few.p75 == 9
    assert chunk_length_stats(df.limit(0)).first().n == 0


def test_coherence(spark):
    v = np.random.default_rng(1).normal(size=(6, 4))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([("d", i, [float(x) for x in r]) for i, r in enumerate(v)], "document_id string, chunk_index int, embedding array<double>")
    r = chunk_coherence(df).first()
    assert r.adjacent == pytest.approx(np.mean([u[i] @ u[i + 1] for i in range(5)]))
    assert r.others == pytest.approx(np.mean([u[i] @ u[j] for i in range(6) for j in range(i + 2, 6)]))


def test_one_large_cluster_writes_few_rows(spark, monkeypatch):
    """20,000 rows that are all near to each other, and some that are not."""
    from quern.operators import blocks, dedup

    written = []
    for module in (blocks, dedup):
        keep = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, keep=keep: written.append((name, out := keep(df, name))) or out)
    rng = np.random.default_rng(4)
    v = np.ones((20_000, 8)) / np.sqrt(8) + rng.normal(size=(20_000, 8)) * 0.01
    v = np.vstack([v, rng.normal(size=(50, 8))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    score = np.round(rng.uniform(size=len(v)), 3)
    kept, winners = sequential(v, score, 0.93)
    out = greedy_semantic_dedup(frame(spark, v, score).repartition(8), 0.93)
    assert {r.pos for r in out.kept.collect()} == kept
    assert {r.pos: r.winner for r in out.dropped.collect()} == winners
    rows = {name: df.count() for name, df in written}
    assert max(rows.values()) <= dedup.LISTED * len(v) and sum(rows.values()) < 30 * len(v), rows


@pytest.mark.parametrize(("few_edges", "listed", "few_rows"), [(0, 2, 0), (100_000, 1, 4096)])
def test_greedy_with_short_lists_and_known_neighbors(spark, monkeypatch, few_edges, listed, few_rows):
    from quern.operators import blocks, dedup

    monkeypatch.setattr(dedup, "FEW_ROWS", few_rows)
    monkeypatch.setattr(dedup, "FEW_EDGES", few_edges)
    monkeypatch.setattr(dedup, "LISTED", listed)
    v, score = clones(21, n=300, dim=6)
    kept, winners = sequential(v, score, 0.6)
    rows = frame(spark, v, score).repartition(3)
    near = None
    if few_edges:
        found = blocks.neighbors(packed(rows, "pos", "embedding", 40), 0.6, 5)
        near = rows.select("pos").join(found.withColumnRenamed("id", "pos"), "pos", "left")
    out = greedy_semantic_dedup(rows, 0.6, near=near)
    assert {r.pos for r in out.kept.collect()} == kept
    assert {r.pos: r.winner for r in out.dropped.collect()} == winners


def test_pruned_tiles_lose_no_pair(spark, monkeypatch):
    from quern.operators import blocks as B

    monkeypatch.setattr(B, "STRIPS", 24)
    tile_pairs = B.tile_pairs
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(8, 12))
    v = centres[rng.integers(0, 8, 900)] + rng.normal(size=(900, 12)) * 0.1
    v *= rng.uniform(0.2, 1.3, size=(900, 1)) / np.linalg.norm(v, axis=1, keepdims=True)
    v[5] = 0
    blocks = packed(frame(spark, v).repartition(4), "pos", "embedding", 30)
    sims = v @ v.T
    for threshold in (0.93, 0.0):
        got = sorted((min(r.a, r.b), max(r.a, r.b)) for r in similarity_edges(blocks, threshold).collect())
        assert got == [(i, j) for i in range(900) for j in range(i + 1, 900) if sims[i, j] >= threshold]
    assert tile_pairs(blocks, None, 0.93).count() < tile_pairs(blocks, None).count() == blocks.strips * (blocks.strips + 1) // 2
    assert tile_pairs(blocks, None, -0.5).count() == tile_pairs(blocks, None).count()


def test_neighbors_list_what_is_near(spark):
    from quern.operators.blocks import neighbors

    v, score = clones(8, n=200 + 100)
    blocks = packed(frame(spark, v, score).repartition(4), "pos", "embedding", 33, score="semantic_score")
    sims = v @ v.T
    np.fill_diagonal(sims, -np.inf)
    got = {r.id: r for r in neighbors(blocks, 0.5, 3).collect()}
    for i in range(300):
        near = sorted((-score[j], j) for j in np.flatnonzero(sims[i] >= 0.5))
        assert got[i].n_near == len(near) and [x.other for x in got[i].near] == [j for _, j in near[:3]]
        assert got[i].sim == pytest.approx(sims[i].max(), abs=1e-12)


def test_nearest_rows_leave_out_most_leaves(monkeypatch):
    """Rows in clusters: few pairs of rows are multiplied, and each row's nearest is that of all pairs."""
    from quern.operators import blocks

    rng = np.random.default_rng(8)
    v = rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 0.01
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[1000:1010] = v[3]
    v[7] = 0
    monkeypatch.setattr(blocks, "LEAF_ROWS", 64)
    pairs, look = [], blocks._Leaves.look
    monkeypatch.setattr(blocks._Leaves, "look", lambda self, n, rows, others, leaf: pairs.append(len(rows) * len(others.leaves[leaf])) or look(self, n, rows, others, leaf))
    strip = lambda rows: blocks._Leaves([blocks.Block({"ids": rows.tobytes(), "vectors": v[rows].tobytes(), "scores": b"", "lo": [], "hi": [], "norm": 1.0, "strip": 0, "block": 0})], np.eye(8))
    a, b = strip(np.arange(0, 4000, 2)), strip(np.arange(1, 4000, 2))
    for x, y in ((a, a), (b, b), (a, b), (b, a)):
        x.search(y)
    sims = np.round(v @ v.T, 9)
    np.fill_diagonal(sims, -np.inf)
    for x in (a, b):
        assert np.allclose(x.sim, sims[x.ids].max(axis=1), atol=1e-8)
        assert np.allclose(sims[x.ids, x.other], sims[x.ids].max(axis=1), atol=1e-8)
    assert sum(pairs) < 0.3 * len(v) ** 2


def test_many_strips_shuffle_in_rounds(spark, monkeypatch):
    """Nearest rows and near pairs among 40 strips: all are found, copies in one strip and in several among them, and what is shuffled doesn't grow with the pairs of strips."""
    import glob
    import os

    from quern.operators import blocks

    n, rounds = 3000, []
    for name, value in {"STRIP_BYTES": n * 64 // 40, "ROUND_BYTES": 1 << 16, "LEAF_ROWS": 16, "BLOCK_ROWS": 40}.items():
        monkeypatch.setattr(blocks, name, value, raising=False)
    keep = blocks.materialize
    monkeypatch.setattr(blocks, "materialize", lambda df, name: rounds.append(name) or keep(df, name))
    rng = np.random.default_rng(9)
    v = rng.normal(size=(60, 8))[rng.integers(0, 60, n)] + rng.normal(size=(n, 8)) * 0.2
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[200:400], v[50:53], v[7], v[9] = v[3], v[40], 0, 1.5 * v[9]
    sims = np.round(v @ v.T, 9)
    np.fill_diagonal(sims, -np.inf)
    size = lambda: sum(os.path.getsize(f) for f in glob.glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*", recursive=True))
    packed_ = packed(frame(spark, v).repartition(4), "pos", "embedding", 40)
    before = size()
    got = {r.id: r for r in nearest(packed_).collect()}
    assert size() - before < 4 * v.nbytes and packed_.strips > 30, (size() - before, v.nbytes)
    assert rounds.count("nearest-other") > 2
    assert sorted(got) == list(range(n))
    for i in range(n):
        assert got[i].sim == pytest.approx(sims[i].max(), abs=1e-8) and sims[i, got[i].other] == pytest.approx(sims[i].max(), abs=1e-8)
    assert all(got[i].other == 40 for i in (50, 51, 52)) and got[40].other == 50
    edges = sorted((min(r.a, r.b), max(r.a, r.b)) for r in similarity_edges(packed_, 0.95).collect())
    assert edges == [(i, j) for i, j in np.argwhere(np.triu(sims >= 0.95, 1)).tolist()] and "tile-round" in rounds


@pytest.mark.parametrize(("leading", "dropped"), [(40, 0.0), (40, 0.9), (250, 0.1)])
def test_greedy_in_rounds_of_leading_rows(spark, monkeypatch, leading, dropped):
    from quern.operators import dedup

    monkeypatch.setattr(dedup, "LEADING", leading)
    monkeypatch.setattr(dedup, "DROPPED", dropped)
    v, score = clones(11)
    kept, winners = sequential(v, score, 0.45)
    out = greedy_semantic_dedup(frame(spark, v, score).repartition(4), 0.45)
    assert {r.pos for r in out.kept.collect()} == kept
    assert {r.pos for r in out.dropped.collect()} == set(winners)


@pytest.mark.parametrize("few", [0, 4096])
def test_many_queries_hold_few_products(spark, monkeypatch, few):
    """The same hits, ties by id among them, in slices of queries; a slice's products are all that is held."""
    import tracemalloc

    from quern.operators import blocks, retrieval

    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 4)).round(1)
    v[150:] = v[:150]
    monkeypatch.setattr(retrieval, "FEW", few)
    monkeypatch.setattr(blocks, "ASKED_ROWS", 7)
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    got = {}
    for r in retrieve(frame(spark, v[:60]).withColumnRenamed("pos", "query_id"), frame(spark, v).repartition(3), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], 1 - r.distance))
    for q, hits in got.items():
        assert [s for _, s in sorted(hits)] == pytest.approx(sorted(u[q] @ u.T, reverse=True)[:5])
    monkeypatch.setattr(blocks, "ASKED_ROWS", 256)
    top, x = blocks._Top(np.arange(4096), rng.normal(size=(4096, 16)), 5), rng.normal(size=(2048, 16))
    tracemalloc.start()
    top.add(np.arange(2048), x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30 << 20
    assert np.array_equal(top.ids, np.argsort(-(top.q @ x.T), axis=1, kind="stable")[:, :5])
