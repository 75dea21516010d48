"""Queries of vectors, scores and dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quern.functions import vectors as V
from quern.operators import dedup, metrics, scoring
from quern.operators.blocks import packed, similarity_edges
from quern.operators.evaluation import nearest_neighbor, duplicate_pairs_sample, vector_integrity
from quern.queries.base import CHUNKS, PAIRS, VECTORS, Tables, chunks, query, vectors

THRESHOLD = 0.35
_r = lambda c, n=6: F.round(c, n)


@query("t7_l2_cut_dim", f"WITH {VECTORS} SELECT pos, round(v[3] / sqrt(list_dot_product(v[1:16], v[1:16])), 6) AS third, 16 AS dim FROM vectors")
def _(t: Tables) -> DataFrame:
    return vectors(t).withColumn("c", V.cut_dim(F.col("embedding"), 16)).select("pos", _r(F.col("c")[2]).alias("third"), F.size("c").alias("dim"))


@query("t8_cosine", f"WITH {VECTORS} SELECT a.pos, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM vectors a JOIN vectors b ON b.pos = a.pos + 1")
def _(t: Tables) -> DataFrame:
    a, b = vectors(t), vectors(t).select((F.col("pos") - 1).alias("pos"), F.col("embedding").alias("other"))
    return a.join(b, "pos").select("pos", _r(V.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


_CENTROID = "means AS (SELECT i, avg(v[i]) AS m FROM vectors, (SELECT unnest(range(1, 65)) AS i) GROUP BY i), centroid AS (SELECT list(m / n ORDER BY i) AS c FROM means, (SELECT sqrt(sum(m * m)) AS n FROM means))"


@query("v0_centroid", f"WITH {VECTORS}, {_CENTROID} SELECT unnest(range(0, 64)) AS at, round(unnest(c), 6) AS v FROM centroid")
def _(t: Tables) -> DataFrame:
    rows = V.centroid(vectors(t)).select(F.posexplode("centroid").alias("at", "v"))
    return rows.select(F.col("at").cast("long").alias("at"), _r(F.col("v")).alias("v"))


@query("v1_centrality", f"WITH {VECTORS}, {_CENTROID} SELECT pos, round(list_dot_product(v, c), 6) AS centrality FROM vectors, centroid")
def _(t: Tables) -> DataFrame:
    return V.centrality(vectors(t)).select("pos", _r(F.col("centrality")).alias("centrality"))


@query("v2_redundancy", f"WITH {VECTORS}, {PAIRS.format(of='vectors')} SELECT a AS pos, round(greatest(0, max(sim)), 6) AS redundancy FROM pairs GROUP BY a")
def _(t: Tables) -> DataFrame:
    return scoring.redundancy(vectors(t)).select("pos", _r(F.col("redundancy")).alias("redundancy"))


_SCORED = f"""vectors AS (SELECT pos, v FROM chunks), {_CENTROID}, {PAIRS.format(of='vectors')}, near AS (SELECT a AS pos, greatest(0, max(sim)) AS redundancy FROM pairs GROUP BY a),
scored AS (SELECT pos, dedup_policy, list_dot_product(k.v, c) AS centrality, coalesce(redundancy, 0) AS redundancy,
    round(least(1, greatest(0, 0.45::DOUBLE * coalesce(relevancia_llm, 0) + 0.2::DOUBLE * list_dot_product(k.v, c) + 0.2::DOUBLE * (1 - coalesce(redundancy, 0)) + 0.15::DOUBLE * 0.7)), 4) AS score FROM chunks k LEFT JOIN near USING (pos), centroid)"""


@query("v3_semantic_score", f"WITH {CHUNKS}, {_SCORED} SELECT pos, score AS semantic_score FROM scored")
def _(t: Tables) -> DataFrame:
    return scoring.score(chunks(t)).select("pos", "semantic_score")


@query("a5_redundancy_by_policy", f"WITH {CHUNKS}, {_SCORED} SELECT coalesce(dedup_policy, 'semantica') AS policy, count(*) AS n, round(avg(redundancy), 6) AS mean, round(quantile_cont(redundancy, 0.5), 6) AS p50, round(quantile_cont(redundancy, 0.9), 6) AS p90, round(100.0 * count(*) FILTER (redundancy >= 0.35) / count(*), 6) AS pct_above FROM scored GROUP BY 1")
def _(t: Tables) -> DataFrame:
    out = metrics.redundancy_by_policy(scoring.score(chunks(t)), THRESHOLD)
    return out.select("policy", "n", *(_r(F.col(c)).alias(c) for c in ("mean", "p50", "p90", "pct_above")))


@query("a6_scoring_summary", f"WITH {CHUNKS}, {_SCORED} SELECT round(min(score), 4) AS score_min, round(avg(score), 6) AS score_mean, round(max(score), 4) AS score_max, round(avg(centrality), 6) AS centrality_mean, round(avg(redundancy), 6) AS redundancy_mean, count(*) FILTER (score >= 0.6) AS n_good FROM scored")
def _(t: Tables) -> DataFrame:
    out = metrics.scoring_summary(scoring.score(chunks(t)))
    return out.select("score_min", _r(F.col("score_mean")).alias("score_mean"), "score_max", _r(F.col("centrality_mean")).alias("centrality_mean"), _r(F.col("redundancy_mean")).alias("redundancy_mean"), "n_good")


@query("v4_nearest_neighbor", f"WITH {VECTORS}, unit AS (SELECT pos, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM vectors), {PAIRS.format(of='unit')} SELECT a AS pos, round(max(sim), 6) AS sim, arg_max(b, sim) AS neighbor, max(sim) >= 0.35 AS is_duplicate FROM pairs GROUP BY a")
def _(t: Tables) -> DataFrame:
    out = nearest_neighbor(vectors(t), THRESHOLD)
    return out.select("pos", _r(F.col("sim")).alias("sim"), "neighbor", "is_duplicate")


@query("v5_duplicate_pairs_sample", f"WITH {CHUNKS}, unit AS (SELECT pos, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM chunks), {PAIRS.format(of='unit')}, best AS (SELECT a AS pos, max(sim) AS sim, arg_max(b, sim) AS neighbor FROM pairs GROUP BY a) SELECT b.pos, neighbor, round(sim, 6) AS sim, k.page_content AS text, n.page_content AS neighbor_text FROM (SELECT * FROM best WHERE sim >= 0.35 ORDER BY pos LIMIT 100) b JOIN chunks k ON k.pos = b.pos JOIN chunks n ON n.pos = neighbor")
def _(t: Tables) -> DataFrame:
    rows = chunks(t)
    out = duplicate_pairs_sample(nearest_neighbor(rows, THRESHOLD), rows)
    return out.withColumn("sim", _r(F.col("sim")))


@query("j5_similarity_join", f"WITH {VECTORS}, {PAIRS.format(of='vectors')} SELECT a, b, round(sim, 6) AS sim FROM pairs WHERE a < b AND sim >= 0.35")
def _(t: Tables) -> DataFrame:
    e = similarity_edges(packed(vectors(t), "pos", "embedding"), THRESHOLD)
    return e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), _r(F.col("sim")).alias("sim"))


def greedy_sql(of: str, score: str, threshold: float = THRESHOLD) -> str:
    """CTEs of the sequential definition: rows in order of score, each kept unless a kept one is near."""
    return f"""ranks AS (SELECT pos, v, row_number() OVER (ORDER BY {score} DESC, pos) AS rk FROM {of}),
edges AS (SELECT a.pos AS a, b.pos AS b, a.rk AS ra, b.rk AS rb, list_dot_product(a.v, b.v) AS sim FROM ranks a JOIN ranks b ON a.rk < b.rk WHERE list_dot_product(a.v, b.v) >= {threshold}),
steps AS (SELECT r.rk, r.pos, coalesce(list(e.a) FILTER (e.a IS NOT NULL), []) AS before FROM ranks r LEFT JOIN edges e ON e.b = r.pos GROUP BY r.rk, r.pos),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT i + 1, CASE WHEN list_has_any(kept, before) THEN kept ELSE list_append(kept, s.pos) END FROM walk JOIN steps s ON s.rk = i + 1),
kept AS (SELECT unnest(kept) AS pos FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)),
winners AS (SELECT b AS pos, arg_max(a, sim) AS winner, max(sim) AS sim FROM edges WHERE a IN (SELECT pos FROM kept) AND b NOT IN (SELECT pos FROM kept) GROUP BY b)"""


@query("v6_greedy_semantic_dedup", f"WITH RECURSIVE {VECTORS}, {greedy_sql('vectors', 'pos * 7919 % 1000')} SELECT r.pos, k.pos IS NOT NULL AS kept, winner, round(sim, 6) AS sim FROM ranks r LEFT JOIN kept k ON k.pos = r.pos LEFT JOIN winners w ON w.pos = r.pos")
def _(t: Tables) -> DataFrame:
    rows = vectors(t).withColumn("semantic_score", F.col("pos") * 7919 % 1000)
    g = dedup.greedy_semantic_dedup(rows, THRESHOLD)
    out = rows.select("pos").join(g.kept.withColumn("k", F.lit(True)), "pos", "left").join(g.dropped, "pos", "left")
    return out.select("pos", F.coalesce("k", F.lit(False)).alias("kept"), "winner", _r(F.col("sim")).alias("sim"))


_EXACT = """keyed AS (SELECT *, CASE dedup_policy WHEN 'exact_key' THEN entity_key WHEN 'group_only' THEN group_key || '/' || chunk_index ELSE row || '/' || page_content END AS k FROM chunks WHERE dedup_policy IS NOT NULL),
exact AS (SELECT *, row_number() OVER (PARTITION BY source, dedup_policy, k ORDER BY pos) = 1 AS kept FROM keyed)"""
_DEDUP = f"WITH RECURSIVE {CHUNKS}, {_EXACT}, sem AS (SELECT * FROM chunks WHERE dedup_policy IS NULL), {greedy_sql('sem', 'semantic_score')}, stays AS (SELECT pos FROM exact WHERE kept UNION ALL SELECT pos FROM kept), events AS (SELECT 'dedup_clave' AS motivo, NULL::DOUBLE AS sim, source AS fuente, pos AS global_id, NULL::BIGINT AS winner FROM exact WHERE NOT kept UNION ALL SELECT 'dedup_coseno', round(sim, 4), source, w.pos, winner FROM winners w JOIN chunks USING (pos))"


def _both(t: Tables) -> tuple[DataFrame, dedup.Dedup]:
    rows = chunks(t)
    return rows, dedup.deduplicate(rows, THRESHOLD)


@query("w2_exact_key_dedup", f"WITH {CHUNKS}, {_EXACT} SELECT pos, kept FROM exact")
def _(t: Tables) -> DataFrame:
    return dedup.exact_key_dedup(chunks(t).where("dedup_policy IS NOT NULL")).select("pos", "kept")


@query("v7_deduplicate", f"{_DEDUP} SELECT motivo, sim, fuente, global_id, winner FROM events")
def _(t: Tables) -> DataFrame:
    return _both(t)[1].events.select("motivo", "sim", "fuente", "global_id", F.col("pareja.global_id").alias("winner"))


@query("x1_union_kept", f"{_DEDUP} SELECT pos FROM stays")
def _(t: Tables) -> DataFrame:
    return _both(t)[1].kept.select("pos")


@query("j4_winner_lookup", f"{_DEDUP} SELECT e.global_id, k.source AS fuente, k.pos AS winner, k.semantic_score AS score, substring(replace(trim(k.page_content), chr(10), ' '), 1, 120) AS snip FROM events e JOIN chunks k ON k.pos = e.winner")
def _(t: Tables) -> DataFrame:
    e = _both(t)[1].events.where("motivo = 'dedup_coseno'")
    return e.select("global_id", "pareja.fuente", F.col("pareja.global_id").alias("winner"), "pareja.score", "pareja.snip")


def _by_two(df: DataFrame) -> DataFrame:
    """Sources of two rows each, of which some lose both."""
    return df.withColumn("source", F.concat("source", F.lit("/"), F.floor((F.col("pos") + 1) / 2).cast("string")))


@query("x2_sources_gone", f"{_DEDUP}, own AS (SELECT pos, source || '/' || (pos + 1) // 2 AS source FROM chunks) SELECT DISTINCT source FROM own WHERE source NOT IN (SELECT source FROM own JOIN stays USING (pos))")
def _(t: Tables) -> DataFrame:
    rows, d = _both(t)
    return _by_two(rows).select("source").subtract(_by_two(d.kept).select("source"))


@query("w3_audit_sample", f"{_DEDUP} SELECT motivo, sim, fuente, global_id FROM events WHERE fuente LIKE '%src1%' ORDER BY sim DESC NULLS LAST, fuente, global_id LIMIT 20")
def _(t: Tables) -> DataFrame:
    return dedup.audit_sample(_both(t)[1].events, "src1", None, 20).select("motivo", "sim", "fuente", "global_id")


@query("a2_source_table", f"{_DEDUP} SELECT source, sum(docs)::BIGINT AS docs, sum(pre)::BIGINT AS chunks_pre, sum(post)::BIGINT AS chunks_post, sum(pre) > 0 AND sum(post) = 0 AS emptied FROM (SELECT source, 1 AS docs, 0 AS pre, 0 AS post FROM documents UNION ALL SELECT source, 0, 1, 0 FROM chunks UNION ALL SELECT source, 0, 0, 1 FROM chunks JOIN stays USING (pos)) GROUP BY ROLLUP (source)")
def _(t: Tables) -> DataFrame:
    rows, d = _both(t)
    return metrics.source_table(t.documents, rows, d.kept)


@query("a3_category_coverage", f"{_DEDUP} SELECT category, count(k.pos) AS pre, count(s.pos) AS post FROM (SELECT unnest(['tarifas', 'normativa', 'reservas', 'abonos', 'instalaciones', 'agenda']) AS category) LEFT JOIN chunks k ON k.doc_category = category LEFT JOIN stays s ON s.pos = k.pos GROUP BY category")
def _(t: Tables) -> DataFrame:
    rows, d = _both(t)
    return metrics.category_coverage(rows, d.kept)


@query("a4_top_tags", f"{_DEDUP} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM chunks JOIN stays USING (pos)) GROUP BY tag ORDER BY n DESC, tag LIMIT 3")
def _(t: Tables) -> DataFrame:
    return metrics.top_tags(_both(t)[1].kept)


@query("a7_dedup_summary", f"{_DEDUP} SELECT pre, pre - total AS post, exact, semantic, total, round(100.0 * total / pre, 1)::DOUBLE AS pct FROM (SELECT (SELECT count(*) FROM chunks) AS pre, count(*) FILTER (motivo = 'dedup_clave') AS exact, count(*) FILTER (motivo = 'dedup_coseno') AS semantic, count(*) AS total FROM events)")
def _(t: Tables) -> DataFrame:
    rows, d = _both(t)
    return metrics.dedup_summary(rows, d.events)


@query("a8_discards_by_source", f"{_DEDUP} SELECT fuente, count(*) AS n FROM events GROUP BY fuente")
def _(t: Tables) -> DataFrame:
    return metrics.discards_by_source(_both(t)[1].events)


@query("a9_emptied_sources", f"{_DEDUP}, own AS (SELECT pos, source || '/' || (pos + 1) // 2 AS fuente FROM chunks), gone AS (SELECT fuente FROM own GROUP BY fuente HAVING count(*) FILTER (pos IN (SELECT pos FROM stays)) = 0), e AS (SELECT o.fuente, motivo, sim, global_id, row_number() OVER (PARTITION BY o.fuente ORDER BY sim DESC NULLS LAST, global_id) AS n FROM events JOIN own o ON o.pos = global_id WHERE o.fuente IN (SELECT fuente FROM gone)) SELECT fuente, motivo, sim, global_id FROM e WHERE n = 1")
def _(t: Tables) -> DataFrame:
    rows, d = _both(t)
    own = _by_two
    keyed = own(rows)
    events = d.events.drop("fuente").join(keyed.select(F.col("pos").alias("global_id"), F.col("source").alias("fuente")), "global_id")
    return dedup.emptied_sources(keyed, own(d.kept), events)


@query("a18_signals", f"""{_DEDUP}, c AS (SELECT category, count(k.pos) AS pre, count(s.pos) AS post FROM (SELECT unnest(['tarifas', 'normativa', 'reservas', 'abonos', 'instalaciones', 'agenda']) AS category) LEFT JOIN chunks k ON k.doc_category = category LEFT JOIN stays s ON s.pos = k.pos GROUP BY category),
s AS (SELECT source, count(*) AS pre, count(s.pos) AS post FROM chunks LEFT JOIN stays s USING (pos) GROUP BY source), p AS (SELECT round(100.0 * (SELECT count(*) FROM events) / count(*), 1)::DOUBLE AS pct FROM chunks), found AS (
SELECT 'short_chunks' AS signal, '' AS subject, n::DOUBLE AS value FROM (SELECT count(*) AS n FROM chunks WHERE length(page_content) < 50) WHERE n > 0 UNION ALL SELECT 'emptied_source', source, pre FROM s WHERE post = 0
UNION ALL SELECT 'many_discards', '', pct FROM p WHERE pct > 50 UNION ALL SELECT 'no_discards', '', 0 FROM p WHERE pct = 0 UNION ALL SELECT 'empty_category', category, pre FROM c WHERE post = 0
UNION ALL SELECT 'few_good_scores', '', v FROM (SELECT 100.0 * count(*) FILTER (semantic_score >= 0.6) / count(*) AS v FROM chunks) WHERE v < 50)
SELECT signal, subject, round(value, 6) AS value FROM found UNION ALL SELECT 'none', '', 0 WHERE NOT EXISTS (SELECT 1 FROM found)""")
def _(t: Tables) -> DataFrame:
    rows, d = _both(t)
    scored = rows.withColumns({"centrality": F.lit(0.0), "redundancy": F.lit(0.0)})
    out = metrics.signals(metrics.chunk_length_stats(rows), metrics.source_table(t.documents, rows, d.kept), metrics.dedup_summary(rows, d.events), metrics.category_coverage(rows, d.kept), metrics.scoring_summary(scored))
    return out.withColumn("value", _r(F.col("value")))


@query("a1_chunk_length_stats", f"""
WITH {CHUNKS}, l AS (SELECT length(page_content) AS n, row_number() OVER (ORDER BY length(page_content)) AS r, count(*) OVER () AS m FROM chunks),
q AS (SELECT i, greatest(1, least(any_value(m) - 1, i * (any_value(m) + 1) // 4)) AS j, any_value(m) AS m FROM l, (SELECT unnest([1, 2, 3]) AS i) GROUP BY i),
v AS (SELECT i, (max(n) FILTER (r = j) * (4 - (i * (any_value(q.m) + 1) - 4 * any_value(j))) + max(n) FILTER (r = j + 1) * (i * (any_value(q.m) + 1) - 4 * any_value(j))) / 4 AS x FROM q, l GROUP BY i)
SELECT count(*) AS n, min(n) AS min, (SELECT x FROM v WHERE i = 1) AS p25, round(avg(n), 1) AS mean, (SELECT x FROM v WHERE i = 2) AS p50, (SELECT x FROM v WHERE i = 3) AS p75, max(n) AS max, count(*) FILTER (n < 50) AS n_short, (SELECT count(*) FROM chunks WHERE chunking_hint = 'no_chunk') AS n_whole FROM l""")
def _(t: Tables) -> DataFrame:
    return metrics.chunk_length_stats(chunks(t))


@query("a10_vector_integrity", f"WITH {VECTORS} SELECT count(*) AS n, max(len(v))::INT AS dim, 0::BIGINT AS n_bad, count(*) FILTER (list_dot_product(v, v) = 0) AS n_zero, round(min(sqrt(list_dot_product(v, v))), 6) AS norm_min, round(avg(sqrt(list_dot_product(v, v))), 6) AS norm_mean, round(max(sqrt(list_dot_product(v, v))), 6) AS norm_max FROM vectors")
def _(t: Tables) -> DataFrame:
    out = vector_integrity(vectors(t))
    return out.select("n", "dim", "n_bad", "n_zero", *(_r(F.col(c)).alias(c) for c in ("norm_min", "norm_mean", "norm_max")))


_OWN = "own AS (SELECT k.pos, k.v, s.score FROM chunks k JOIN scored s USING (pos) WHERE k.dedup_policy IS NULL)"


@query("flagship", f"WITH RECURSIVE {CHUNKS}, {_SCORED}, {_EXACT}, {_OWN}, {greedy_sql('own', 'score')} SELECT pre, pre - exact - semantic AS post, exact, semantic, exact + semantic AS total, round(100.0 * (exact + semantic) / pre, 1)::DOUBLE AS pct FROM (SELECT (SELECT count(*) FROM chunks) AS pre, (SELECT count(*) FROM exact WHERE NOT kept) AS exact, (SELECT count(*) FROM winners) AS semantic)")
def _(t: Tables) -> DataFrame:
    """Documents with vectors and labels, scored, deduplicated, and summed up."""
    rows = scoring.score(chunks(t).drop("semantic_score"))
    return metrics.dedup_summary(rows, dedup.deduplicate(rows, THRESHOLD).events)
