"""Queries of retrieval, the evidence gate and prompts. Questions are the vectors with an id below a twenty-fifth of all."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quern.functions.text import ABSTENTION, eval_prompt
from quern.operators import retrieval as R
from quern.queries.base import CHUNKS, VECTORS, Tables, chunks, query, vectors

#: Every 25th vector asks: a query set of the data's own size.
_ASKS, _MOST = 25, 0.72


def _queries(t: Tables) -> DataFrame:
    return vectors(t).where(F.col("pos") % _ASKS == 0).select(F.col("pos").alias("query_id"), "embedding")


def _hits(of: str, k: int) -> str:
    return f"""ranked AS (SELECT q.pos AS query_id, x.pos, 1 - list_cosine_similarity(q.v, x.v) AS distance, row_number() OVER (PARTITION BY q.pos ORDER BY list_cosine_similarity(q.v, x.v) DESC, x.pos) AS rank
FROM {of} q JOIN {of} x ON q.pos % {_ASKS} = 0), hits AS (SELECT * FROM ranked WHERE rank <= {k})"""


@query("v8_retrieve", f"WITH {VECTORS}, {_hits('vectors', 10)} SELECT query_id, pos, round(distance, 6) AS distance, rank FROM hits")
def _(t: Tables) -> DataFrame:
    out = R.retrieve(_queries(t), vectors(t), 10)
    return out.select("query_id", "pos", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("v9_seed_neighbors", f"WITH {VECTORS}, {_hits('vectors', 6)} SELECT query_id AS seed, pos, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM hits WHERE pos <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5")
def _(t: Tables) -> DataFrame:
    rows = vectors(t)
    return R.seed_neighbors(rows.where(F.col("pos") % _ASKS == 0), rows, 5).select("seed", "pos", F.col("rank").cast("long").alias("rank"))


_SOME = f"{VECTORS}, {_hits('vectors', 6)}, others AS (SELECT * FROM hits WHERE rank > 1)"


@query("o1_evidence_gate", f"WITH {_SOME} SELECT query_id, round(min(distance), 6) AS best_distance, min(distance) <= {_MOST} AS has_evidence FROM others GROUP BY query_id")
def _(t: Tables) -> DataFrame:
    asked = _queries(t)
    hits = R.retrieve(asked, vectors(t), 6).where("rank > 1")
    out = R.evidence_gate(asked.select("query_id"), hits, _MOST)
    return out.withColumn("best_distance", F.round("best_distance", 6))


def _questions(t: Tables) -> DataFrame:
    """Questions of chunks, some blank, some of an opposite vector, which nothing is near to."""
    rows = chunks(t).where(F.col("pos") % _ASKS == 0)
    text = F.when(F.col("pos") % 3 == 0, " ").otherwise(F.concat(F.lit("¿"), "source", F.lit("?")))
    away = F.transform("embedding", lambda x: F.when(F.col("pos") % 2 == 0, x).otherwise(-x))
    return rows.select(F.col("pos").alias("query_id"), text.alias("question"), away.alias("embedding"))


_ASKED = f"""asked AS (SELECT pos AS query_id, CASE WHEN pos % 3 = 0 THEN ' ' ELSE '¿' || source || '?' END AS question, CASE WHEN pos % 2 = 0 THEN 1 ELSE -1 END AS way, v FROM chunks WHERE pos % {_ASKS} = 0),
near AS (SELECT query_id, x.pos, x.source, x.page_content AS text, 1 - way * list_cosine_similarity(q.v, x.v) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY way * list_cosine_similarity(q.v, x.v) DESC, x.pos) AS rank FROM asked q JOIN chunks x ON trim(question) <> ''),
gate AS (SELECT query_id, min(distance) <= 0.65 AS ok FROM near GROUP BY query_id)"""


def _batch(k: int) -> str:
    return f"""SELECT a.query_id, question, CASE WHEN trim(question) = '' THEN 'empty' END AS error, coalesce(ok, false) AS has_evidence, trim(question) <> '' AND NOT coalesce(ok, false) AS abstained,
    CASE WHEN coalesce(ok, false) THEN least(5, {k}, (SELECT count(*) FROM chunks)) ELSE 0 END AS n_chunks, coalesce(s.sources, '') AS sources, CASE WHEN coalesce(ok, false) THEN c.context ELSE '' END AS context
    FROM asked a LEFT JOIN gate g USING (query_id) LEFT JOIN (SELECT query_id, string_agg(source, ',' ORDER BY r) AS sources FROM (SELECT query_id, source, min(rank) AS r FROM near JOIN gate USING (query_id) WHERE rank <= CASE WHEN ok THEN least(5, {k}) ELSE {k} END GROUP BY query_id, source) GROUP BY query_id) s USING (query_id)
    LEFT JOIN (SELECT query_id, string_agg('--- Fragmento ' || rank || ' (fuente: ' || source || ') ---' || chr(10) || trim(text, chr(10) || ' '), chr(10) || chr(10) ORDER BY rank) AS context FROM near WHERE rank <= least(5, {k}) GROUP BY query_id) c USING (query_id)"""


@query("o2_rag_batch", f"WITH {CHUNKS}, {_ASKED}, b AS ({_batch(7)}) SELECT *, CASE WHEN has_evidence THEN 'S' || chr(10) || chr(10) || '=== CONTEXTO ===' || chr(10) || context || chr(10) || chr(10) || '=== PREGUNTA ===' || chr(10) || question || chr(10) || chr(10) || '=== RESPUESTA ===' END AS prompt, CASE WHEN abstained THEN '{ABSTENTION}' END AS answer FROM b")
def _(t: Tables) -> DataFrame:
    out = R.rag_batch(_questions(t), chunks(t), 7, "S")
    return out.withColumns({"sources": F.array_join("sources", ","), "n_chunks": F.col("n_chunks").cast("long")})


@query("x4_ordered_sources", f"WITH {CHUNKS}, {_ASKED} SELECT query_id, string_agg(source, ',' ORDER BY r) AS sources FROM (SELECT query_id, source, min(rank) AS r FROM near WHERE rank <= 7 GROUP BY query_id, source) GROUP BY query_id")
def _(t: Tables) -> DataFrame:
    rows = chunks(t)
    hits = R.with_content(R.retrieve(_questions(t).where("trim(question) <> ''"), rows, 7), rows)
    return R.ordered_sources(hits).withColumn("sources", F.array_join("sources", ","))


_GRID = " UNION ALL ".join(f"SELECT {k} AS top_k, * FROM ({_batch(k)})" for k in (1, 3, 5))


def _grid(t: Tables) -> DataFrame:
    questions = _questions(t).withColumns({"fuente_esperada": F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")), "out_of_corpus": F.col("query_id") % 2 == 1, "categoria_esperada": F.concat(F.lit("c"), (F.col("query_id") % 3).cast("string"))})
    return R.rag_grid_report(questions, chunks(t), (1, 3, 5))


@query("a17_rag_grid_report", f"WITH {CHUNKS}, {_ASKED}, b AS ({_GRID}) SELECT top_k, query_id, error, abstained, n_chunks, sources, list_contains(string_split(sources, ','), 'src' || (query_id % 20)) AS source_hit, abstained AND query_id % 2 = 1 AS right_abstention FROM b")
def _(t: Tables) -> DataFrame:
    return _grid(t).select("top_k", "query_id", "error", "abstained", F.col("n_chunks").cast("long").alias("n_chunks"), F.array_join("sources", ",").alias("sources"), "source_hit", "right_abstention")


_RATES = """SELECT top_k, categoria, grouping_id(top_k, categoria)::INT AS level, count(*) AS n, count(error) AS errors, count(*) FILTER (abstained) AS abstained, round(avg(n_chunks), 6) AS mean_chunks,
    round(count(*) FILTER (hit AND query_id % 2 = 0) / nullif(count(*) FILTER (query_id % 2 = 0), 0), 6) AS source_hit_rate, round(count(*) FILTER (abstained AND query_id % 2 = 1) / nullif(count(*) FILTER (query_id % 2 = 1), 0), 6) AS right_abstention_rate"""


@query("a17_rag_grid_rates", f"WITH {CHUNKS}, {_ASKED}, b AS (SELECT *, list_contains(string_split(sources, ','), 'src' || (query_id % 20)) AS hit, 'c' || (query_id % 3) AS categoria FROM ({_GRID})) {_RATES} FROM b GROUP BY GROUPING SETS ((top_k, categoria), (top_k), ())")
def _(t: Tables) -> DataFrame:
    out = R.rag_rates(_grid(t))
    return out.select("top_k", "categoria", "level", "n", "errors", "abstained", *(F.round(c, 6).alias(c) for c in ("mean_chunks", "source_hit_rate", "right_abstention_rate")))


@query("v8_hits_with_metadata", f"WITH {CHUNKS}, ranked AS (SELECT q.pos AS query_id, x.pos, x.source, x.page_content AS text, x.doc_category, x.entity_key, row_number() OVER (PARTITION BY q.pos ORDER BY list_cosine_similarity(q.v, x.v) DESC, x.pos) AS rank FROM chunks q JOIN chunks x ON q.pos % {_ASKS} = 0) SELECT query_id, rank, pos, source, text, doc_category, entity_key FROM ranked WHERE rank <= 3")
def _(t: Tables) -> DataFrame:
    rows = chunks(t)
    asked = rows.where(F.col("pos") % _ASKS == 0).select(F.col("pos").alias("query_id"), "embedding")
    hits = R.with_content(R.retrieve(asked, rows, 3), rows)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "pos", "source", "text", "metadata.doc_category", "metadata.entity_key")


_EVAL = "Tipo {question_type}. ID: {chunk_id}\n{context}\n\nCandidatos:\n{candidates}"


@query("t12_eval_prompt", rf"""WITH {CHUNKS}, near AS (SELECT q.pos AS seed, x.pos, x.page_content AS text, round(list_cosine_similarity(q.v, x.v), 4) AS s, row_number() OVER (PARTITION BY q.pos ORDER BY list_cosine_similarity(q.v, x.v) DESC, x.pos) AS rank FROM chunks q JOIN chunks x ON q.pos % {_ASKS} = 0 AND x.pos <> q.pos),
others AS (SELECT seed, string_agg('ID: ' || pos || ' | cosine: ' || printf('%.4f', s) || chr(10) || substring(text, 1, 2500), chr(10) || chr(10) ORDER BY rank) AS c FROM near WHERE rank <= 2 GROUP BY seed)
SELECT pos, 'Tipo factual. ID: ' || pos || chr(10) || substring(page_content, 1, 5000) || chr(10) || chr(10) || 'Candidatos:' || chr(10) || c AS prompt FROM chunks JOIN others ON seed = pos""")
def _(t: Tables) -> DataFrame:
    rows = chunks(t)
    seeds = rows.where(F.col("pos") % _ASKS == 0)
    near = R.with_content(R.seed_neighbors(seeds, rows, 2), rows)
    # rounded here, since two engines sum a cosine in different orders
    listed = near.groupBy(F.col("seed").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("pos").alias("id"), F.round(1 - F.col("distance"), 4).alias("score"), "text"))).alias("near"))
    prompt = eval_prompt(_EVAL, F.col("pos"), F.col("page_content"), F.lit("factual"), F.col("near"))
    return seeds.join(listed, "pos").select("pos", prompt.alias("prompt"))


@query("o3_query_log", f"""WITH {CHUNKS}, {_ASKED}, b AS ({_batch(3)}) SELECT query_id, '{{"pregunta":"' || question || '","top_k":3,"n_chunks":' || n_chunks || ',"modelo":"m","abstained":' || abstained || ',"t_retrieval":' || (query_id % 4) || '.5}}' AS line FROM b""")
def _(t: Tables) -> DataFrame:
    timed = R.rag_batch(_questions(t), chunks(t), 3).withColumns({"top_k": F.lit(3), "retrieval": F.col("query_id") % 4 + 0.5})
    return R.query_log(timed, "m", ("retrieval",))


@query("j2_attach_vectors", f"WITH {CHUNKS} SELECT pos, page_content, round(v[1], 6) AS first FROM chunks")
def _(t: Tables) -> DataFrame:
    rows = chunks(t)
    joined = rows.select("pos", "page_content").join(vectors(t).select("pos", "embedding"), "pos")
    return joined.select("pos", "page_content", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))
