"""Queries of corpus reports and retrieval metrics, and of the two jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.operators import evaluation as E
from quern.operators.retrieval import retrieve
from quern.operators.tagging import CATEGORIES
from quern.plans.corpus_job import run_corpus_job
from quern.plans.quality_report import run_quality_report
from quern.queries.base import CHUNKS, PAIRS, VECTORS, Tables, chunks, query, vectors
from quern.queries.texts import hash_embedder
from quern.queries.vectors import greedy_sql

_r = lambda c: F.round(F.col(c), 6).alias(c)
_KS = (1, 5)


def records(t: Tables) -> DataFrame:
    """Chunks as records, with blanks and repeated ids."""
    i = F.col("pos")
    return chunks(t).select(
        "pos", F.concat(F.lit("r"), (i - F.when(i % 50 == 1, 1).otherwise(0)).cast("string")).alias("id"), F.when(i % 11 == 0, " ").otherwise(F.col("page_content")).alias("text"), F.when(i % 13 == 0, "").otherwise(F.col("source")).alias("source"),
        F.concat(F.lit("d"), F.floor(i / 3).cast("string")).alias("document_id"), F.when(i % 9 > 0, F.col("doc_category")).alias("category"), F.when(i % 7 > 0, F.create_map(F.lit("lang"), F.col("doc_category"), F.lit("k"), F.lit("v"))).alias("metadata"),
        F.map_keys("tag_flags").alias("tags"), F.when(i % 17 > 0, F.col("embedding")).alias("embedding"),
    )


RECORDS = f"""{CHUNKS}, records AS (SELECT pos, 'r' || (pos - CASE WHEN pos % 50 = 1 THEN 1 ELSE 0 END) AS id, CASE WHEN pos % 11 = 0 THEN ' ' ELSE page_content END AS text, CASE WHEN pos % 13 = 0 THEN '' ELSE source END AS source,
    'd' || pos // 3 AS document_id, CASE WHEN pos % 9 > 0 THEN doc_category END AS category, pos % 7 > 0 AS has_metadata, tags, CASE WHEN pos % 17 > 0 THEN v END AS v FROM chunks)"""


@query("a11_validate_vectors", f"WITH {RECORDS} SELECT (SELECT count(*) FROM records) AS n, count(*) AS n_valid, (SELECT count(*) FROM records WHERE v IS NULL) AS n_missing, max(len(v))::INT AS dim, 0::BIGINT AS n_bad, 0::BIGINT AS n_zero, count(*) FILTER (NOT has_metadata) AS n_no_metadata, count(*) FILTER (source = '') AS n_no_source, count(*) FILTER (trim(text) = '') AS n_no_text, (SELECT count(*) FROM (SELECT id FROM records WHERE v IS NOT NULL GROUP BY id HAVING count(*) > 1)) AS n_duplicate_ids, round(min(s), 6) AS norm_min, round(avg(s), 6) AS norm_mean, round(max(s), 6) AS norm_max, round(quantile_cont(s, 0.25), 6) AS norm_p25, round(quantile_cont(s, 0.5), 6) AS norm_p50, round(quantile_cont(s, 0.75), 6) AS norm_p75 FROM (SELECT *, sqrt(list_dot_product(v, v)) AS s FROM records WHERE v IS NOT NULL)")
def _(t: Tables) -> DataFrame:
    out = E.validate_vectors(records(t))
    return out.select(*(_r(c) if c.startswith("norm_") else F.col(c) for c in out.columns))


_LENGTHS = "l AS (SELECT length(text) AS n, trim(text) = '' AS blank, coalesce(nullif(source, ''), '__sin_fuente__') AS s, coalesce(nullif(document_id, ''), '__sin_documento__') AS d FROM records), per AS (SELECT count(*) AS c FROM l GROUP BY d)"
_LENGTH_ROW = f"""SELECT count(*) AS n_records, min(n)::INT AS length_min, round(avg(n), 6) AS length_mean, max(n)::INT AS length_max, {", ".join(f"round(quantile_cont(n, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90, 95, 99))},
    count(*) FILTER (n < 10) AS below_10, count(*) FILTER (n < 50) AS below_50, count(*) FILTER (n > 2000) AS above_2000, count(*) FILTER (n > 3000) AS above_3000, count(*) FILTER (blank) AS empty, count(DISTINCT s) AS n_sources, count(DISTINCT d) AS n_documents,
    (SELECT round(avg(c), 6) FROM per) AS per_document_mean, (SELECT quantile_cont(c, 0.5) FROM per) AS per_document_median, (SELECT max(c) FROM per) AS per_document_max FROM l"""


@query("a12_length_report", f"WITH {RECORDS}, {_LENGTHS} {_LENGTH_ROW}")
def _(t: Tables) -> DataFrame:
    out = E.length_report(records(t))
    return out.select(*(_r(c) if c.startswith("p") and c not in ("per_document_median", "per_document_max") or c == "length_mean" else F.col(c) for c in out.columns))


@query("a12_length_flags", f"WITH {RECORDS} SELECT pos, length(text)::INT AS length, trim(text) = '' AS empty, length(trim(text, chr(10) || ' ')) < 10 AS short_10, length(trim(text, chr(10) || ' ')) < 50 AS short_50, length(text) > 2000 AS long_2000, length(text) > 3000 AS long_3000, source, document_id, category FROM records")
def _(t: Tables) -> DataFrame:
    rows = records(t)
    # ids repeat among these records, so their places stand for them
    return E.length_flags(rows.withColumn("id", F.col("pos"))).withColumnRenamed("id", "pos")


@query("a12_chunks_by", f"WITH {RECORDS} SELECT 'source' AS kind, coalesce(nullif(source, ''), '__sin_fuente__') AS name, count(*) AS n FROM records GROUP BY ALL UNION ALL SELECT 'category', coalesce(nullif(category, ''), '__sin_categoria__'), count(*) FROM records GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return E.chunks_by(records(t))


_BY_CATEGORY = "by_category AS (SELECT coalesce(nullif(category, ''), '__sin_categoria__') AS category, count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT document_id) AS n_documents, round(avg(length(text)), 6) AS mean_length, round(100.0 * count(*) / (SELECT count(*) FROM records), 6) AS share FROM records GROUP BY 1)"


@query("a13_category_report", f"WITH {RECORDS}, {_BY_CATEGORY} SELECT * FROM by_category")
def _(t: Tables) -> DataFrame:
    out = E.category_report(records(t))
    return out.select("category", "n", "n_sources", "n_documents", _r("mean_length"), _r("share"))


_NAMES = """k AS (SELECT unnest(['lang', 'k']) AS name FROM records WHERE has_metadata), g AS (SELECT unnest(tags) AS name, pos, unnest(range(0, len(tags))) AS p FROM records), top AS (SELECT name, count(*) AS n, min(pos * 100 + p) AS f FROM g GROUP BY name ORDER BY n DESC, f LIMIT 3)"""
_WITHOUT = " UNION ALL ".join(f"SELECT 'without' AS kind, 'without_{c}' AS name, count(*) FILTER (coalesce({c}, '') = '') AS n FROM records" for c in ("category", "source", "document_id"))


@query("a14_metadata_report", f"WITH {RECORDS}, {_NAMES} SELECT 'key' AS kind, name, count(*) AS n FROM k GROUP BY name UNION ALL SELECT 'tag', name, count(*) FROM g GROUP BY name UNION ALL SELECT 'top', name, n FROM top UNION ALL {_WITHOUT}")
def _(t: Tables) -> DataFrame:
    rows = records(t)
    named = lambda df, kind, name: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col("n"))
    keys = named(E.metadata_keys(rows.where("metadata IS NOT NULL")), "key", "key")
    missing = E.records_without(rows)
    missing = missing.select(F.lit("without").alias("kind"), F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in missing.columns))))
    return keys.unionByName(named(E.tag_counts(rows), "tag", "tag")).unionByName(named(E.top_tags_first_seen(rows), "top", "tag")).unionByName(missing)


@query("a15_neighbor_summary", f"WITH {VECTORS}, {PAIRS.format(of='vectors')}, n AS (SELECT a, max(sim) AS sim FROM pairs GROUP BY a) SELECT round(avg(sim), 6) AS mean, round(min(sim), 6) AS min, round(max(sim), 6) AS max, round(quantile_cont(sim, 0.5), 6) AS p50, round(quantile_cont(sim, 0.9), 6) AS p90, round(quantile_cont(sim, 0.95), 6) AS p95, round(quantile_cont(sim, 0.99), 6) AS p99, count(*) FILTER (sim >= 0.35) AS n_duplicates, round(100.0 * count(*) FILTER (sim >= 0.35) / count(*), 6) AS pct_duplicates FROM n")
def _(t: Tables) -> DataFrame:
    out = E.neighbor_summary(E.nearest_neighbor(vectors(t), 0.35))
    return out.select(*(_r(c) if c != "n_duplicates" else F.col(c) for c in out.columns))


@query("w7_chunk_coherence", f"""WITH {VECTORS}, c AS (SELECT pos // 8 AS document_id, pos, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vectors), p AS (SELECT a.document_id, b.pos = a.pos + 1 AS next, list_dot_product(a.u, b.u) AS s FROM c a JOIN c b ON a.document_id = b.document_id AND a.pos < b.pos)
SELECT document_id, round(avg(s) FILTER (next), 6) AS adjacent, round(avg(s) FILTER (NOT next), 6) AS others FROM p GROUP BY document_id""")
def _(t: Tables) -> DataFrame:
    rows = vectors(t).select(F.floor(F.col("pos") / 8).alias("document_id"), F.col("pos").alias("chunk_index"), "embedding")
    return E.chunk_coherence(rows).select("document_id", _r("adjacent"), _r("others"))


def _cases(t: Tables) -> tuple[DataFrame, E.SharedRelevance]:
    """A case for every 25th vector. Relevant are all others of its label, a third of a table's rows as it may be: cases with an even id grade them 1 or 2, the others only list them. So each label has two groups of members, and no pair of case and member is made."""
    rows = vectors(t)
    asked = rows.where(F.col("pos") % 25 == 0).select(F.col("pos").alias("case_id"), "label", "embedding")
    group = lambda graded: 2 * F.col("label").cast("long") + graded.cast("int")
    known = rows.where("label IS NOT NULL").select(F.col("pos").alias("id"), "label", F.explode(F.array(F.lit(False), F.lit(True))).alias("graded"))
    members = known.select(group(F.col("graded")).alias("group"), "id", (~F.col("graded")).alias("listed"), F.when(F.col("graded"), (1 + F.col("id") % 20 / 10).cast("int").cast("double")).alias("gain"))
    return asked.select("case_id", "embedding"), E.SharedRelevance(asked.select("case_id", group(F.col("case_id") % 2 == 0).alias("group"), F.col("case_id").alias("own")), members)


_METRICS = f"""{VECTORS}, rel AS (SELECT q.pos AS case_id, x.pos AS id, CASE WHEN q.pos % 2 = 0 THEN (1 + x.pos % 20 // 10)::DOUBLE ELSE 1.0::DOUBLE END AS g FROM vectors q JOIN vectors x ON q.label = x.label AND x.pos <> q.pos WHERE q.pos % 25 = 0),
ranked AS (SELECT q.pos AS case_id, x.pos AS id, round(list_cosine_similarity(q.v, x.v), 12) AS s, row_number() OVER (PARTITION BY q.pos ORDER BY round(list_cosine_similarity(q.v, x.v), 12) DESC, x.pos) AS rank FROM vectors q JOIN vectors x ON q.pos % 25 = 0),
j AS (SELECT r.*, rel.g FROM ranked r LEFT JOIN rel USING (case_id, id)),
ideal AS (SELECT case_id, g, row_number() OVER (PARTITION BY case_id ORDER BY g DESC) AS n FROM rel), n AS (SELECT case_id, count(*) AS n FROM rel GROUP BY case_id),
m AS (SELECT case_id, any_value(n.n) AS n, 1.0::DOUBLE / min(rank) FILTER (g IS NOT NULL) AS rr, string_agg(id::VARCHAR, ',' ORDER BY rank) FILTER (rank <= {max(_KS)}) AS top_ids, {", ".join(f"count(g) FILTER (rank <= {k}) AS hits_{k}, sum(coalesce(g, 0) / log2(rank + 1)) FILTER (rank <= {k}) AS dcg_{k}, max(s) FILTER (rank <= {k}) AS top_score_{k}" for k in _KS)} FROM j LEFT JOIN n USING (case_id) GROUP BY case_id),
i AS (SELECT case_id, {", ".join(f"sum(g / log2(n + 1)) FILTER (n <= {k}) AS ideal_{k}" for k in _KS)} FROM ideal GROUP BY case_id),
metrics AS (SELECT case_id, coalesce(n, 0) AS n, coalesce(rr, 0) AS rr, top_ids, {", ".join(f"hits_{k}, coalesce(hits_{k} / n, 0) AS recall_{k}, hits_{k} / {k} AS precision_{k}, coalesce(dcg_{k} / ideal_{k}, 0) AS ndcg_{k}, top_score_{k}" for k in _KS)} FROM m LEFT JOIN i USING (case_id))"""


def _evaluated(t: Tables, ks: tuple[int, ...] = _KS) -> DataFrame:
    cases, relevance = _cases(t)
    return E.evaluate_retrieval(cases, relevance, vectors(t), ks)


@query("v10_evaluate_retrieval", f"WITH {_METRICS} SELECT case_id, n, round(rr, 6) AS rr, top_ids, {', '.join(f'hits_{k}, round(recall_{k}, 6) AS recall_{k}, round(precision_{k}, 6) AS precision_{k}, round(ndcg_{k}, 6) AS ndcg_{k}, round(top_score_{k}, 6) AS top_score_{k}' for k in _KS)} FROM metrics")
def _(t: Tables) -> DataFrame:
    out = _evaluated(t).withColumn("top_ids", F.array_join(F.col("top_ids").cast("array<string>"), ","))
    return out.select(*(F.col(c).cast("long").alias(c) if c in ("case_id", "n") or c.startswith("hits") else F.col(c) if c == "top_ids" else _r(c) for c in out.columns))


@query("a16_retrieval_summary", f"WITH {_METRICS} SELECT count(*) AS queries, {', '.join(f'round(avg({m}_{k}), 6) AS mean_{m}_{k}' for m in ('recall', 'precision', 'ndcg') for k in _KS)}, round(avg(rr), 6) AS mrr, count(*) FILTER (hits_1 > 0) AS queries_with_hit_1 FROM metrics")
def _(t: Tables) -> DataFrame:
    out = E.retrieval_summary(_evaluated(t), _KS)
    return out.select(*(F.col(c) if c.startswith("queries") else _r(c) for c in out.columns))


@query("x3_intersection_count", f"WITH {_METRICS} SELECT case_id, hits_5 AS hits FROM metrics")
def _(t: Tables) -> DataFrame:
    return _evaluated(t, (5,)).select("case_id", F.col("hits_5").cast("long").alias("hits"))


@query("j8_relevance_join", f"WITH {_METRICS} SELECT case_id, id, rank, coalesce(g, 0) AS gain FROM j WHERE rank <= 5")
def _(t: Tables) -> DataFrame:
    cases, relevance = _cases(t)
    hits = retrieve(cases, vectors(t), 5, "case_id").withColumnRenamed("pos", "id")
    out = E.judged_hits(hits.select("case_id", "id", "rank"), relevance)
    return out.select("case_id", "id", F.col("rank").cast("long").alias("rank"), "gain")


@query("j3_align_records", f"""WITH {CHUNKS}, c AS (SELECT 'r' || (pos % 100) AS id, arg_max(page_content, pos) AS text, arg_max(source, pos) AS source, arg_max(CASE WHEN pos % 2 = 0 THEN '' ELSE doc_category END, pos) AS category FROM chunks GROUP BY ALL)
SELECT 'r' || k.pos AS id, coalesce(c.text, 'none') AS text, coalesce(c.source, 'v') AS source, coalesce(nullif(c.category, ''), 'w') AS category, 'own' AS a, CASE WHEN c.id IS NOT NULL THEN 'chunk' END AS b FROM chunks k LEFT JOIN c ON c.id = 'r' || k.pos""")
def _(t: Tables) -> DataFrame:
    rows = chunks(t)
    own = rows.select(F.concat(F.lit("r"), F.col("pos").cast("string")).alias("id"), F.lit("none").alias("text"), F.lit("v").alias("source"), F.lit("").alias("document_id"), F.lit("w").alias("category"), F.create_map(F.lit("a"), F.lit("own")).alias("metadata"))
    other = rows.select("pos", F.concat(F.lit("r"), (F.col("pos") % 100).cast("string")).alias("id"), F.col("page_content").alias("text"), "source", F.lit("d").alias("document_id"), F.when(F.col("pos") % 2 == 0, "").otherwise(F.col("doc_category")).alias("category"), F.create_map(F.lit("a"), F.lit("chunk"), F.lit("b"), F.lit("chunk")).alias("metadata"))
    return E.align_records(own, other).select("id", "text", "source", "category", F.col("metadata")["a"].alias("a"), F.col("metadata")["b"].alias("b"))


@query("o4_eval_cases", """
WITH s AS (SELECT doc_id AS seed_id, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE lang END AS query, doc_id % 5 <> 1 AS answerable FROM documents),
v AS (SELECT doc_id AS seed_id, doc_id + 1 AS id, doc_id % 4 AS grade FROM documents), good AS (SELECT seed_id, id, grade FROM v WHERE grade IN (1, 2) AND id IN (SELECT doc_id FROM documents))
SELECT s.seed_id, query, CASE WHEN NOT answerable THEN NULL ELSE coalesce(id, s.seed_id) END AS id, CASE WHEN NOT answerable THEN NULL ELSE coalesce(grade, 2)::DOUBLE END AS grade FROM s LEFT JOIN good USING (seed_id) WHERE trim(query) <> ''""")
def _(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    seeds = t.documents.select(i.alias("seed_id"), F.when(i % 10 == 0, " ").otherwise(F.col("lang")).alias("query"), F.lit("a").alias("answer"), (i % 5 != 1).alias("answerable"))
    verdicts = t.documents.select(i.alias("seed_id"), (i + 1).alias("id"), (i % 4).alias("grade"))
    cases = E.eval_cases(seeds, verdicts, t.documents.select(i.alias("id")))
    return cases.select("seed_id", "query", F.explode_outer("relevance").alias("id", "grade"))


def tagger(prompts: list[str]) -> list[str]:
    return [f'{{"categoria": "{CATEGORIES[len(p) % 6]}", "tags": ["abono"], "relevancia": 0.5}}' for p in prompts]


def _job(t: Tables, hint: Column) -> DataFrame:
    i = F.col("doc_id")
    docs = t.documents.select(
        "source", i.cast("int").alias("doc_id"), F.col("text").alias("page_content"), i.cast("int").alias("row"), hint.alias("chunking_hint"), F.concat(F.lit("E"), (i % 500).cast("string")).alias("entity_key"),
        F.lit(None).cast("string").alias("group_key"), F.when(i % 4 < 3, "exact_key").alias("dedup_policy"),
    )
    return run_corpus_job(docs, hash_embedder, tagger, 16).index


@query("p1_run_corpus_job")
def _(t: Tables) -> DataFrame:
    """Documents of all three ways of splitting; tests hold the job against a plain version, since SQL has no splitter."""
    index = _job(t, F.when(F.col("doc_id") % 8 == 0, "no_chunk").when(F.col("doc_id") % 8 == 1, "light_chunk"))
    return index.select("id", "source", "doc_id", "chunk_index", "chunk_size", "doc_category", "semantic_score")


@query("p1_corpus_job_whole", rf"""WITH RECURSIVE b AS (SELECT doc_id, source, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '\n\s*\n\s*', chr(10) || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)) AS t FROM documents),
clean AS (SELECT doc_id, source, regexp_replace(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '^\s+|\s+$', '', 'g') AS page_content FROM b),
placed AS (SELECT *, row_number() OVER (ORDER BY source, doc_id) - 1 AS pos FROM clean), heads AS (SELECT source, arg_min(page_content, doc_id) AS f FROM placed GROUP BY source),
tags AS (SELECT source, ['tarifas', 'normativa', 'reservas', 'abonos', 'instalaciones', 'agenda'][1 + (2 + least(8000, length(f))) % 6] AS doc_category FROM heads),
words AS (SELECT pos, length(w) % 16 AS slot, count(*) AS n FROM (SELECT pos, unnest(string_split_regex(page_content, '\s+')) AS w FROM placed) WHERE w <> '' GROUP BY ALL),
cells AS (SELECT pos, slot, coalesce(n, 0) AS n FROM placed CROSS JOIN (SELECT unnest(range(0, 16)) AS slot) LEFT JOIN words USING (pos, slot)),
vectors AS (SELECT pos, list((n / greatest(s, 1e-12))::DOUBLE ORDER BY slot) AS v FROM cells JOIN (SELECT pos, sqrt(sum(n * n)) AS s FROM cells GROUP BY pos) USING (pos) GROUP BY pos),
means AS (SELECT i, avg(v[i]) AS m FROM vectors, (SELECT unnest(range(1, 17)) AS i) GROUP BY i), centroid AS (SELECT list(m / n ORDER BY i) AS c FROM means, (SELECT sqrt(sum(m * m)) AS n FROM means)),
{PAIRS.format(of='vectors')}, near AS (SELECT a AS pos, greatest(0, max(sim)) AS redundancy FROM pairs GROUP BY a),
scored AS (SELECT r.*, v, doc_category, round(least(1, greatest(0, 0.45::DOUBLE * 0.5 + 0.2::DOUBLE * list_dot_product(v, c) + 0.2::DOUBLE * (1 - coalesce(redundancy, 0)) + 0.15::DOUBLE * 0.7)), 4) AS score FROM placed r JOIN vectors USING (pos) JOIN tags USING (source) LEFT JOIN near USING (pos), centroid),
exact AS (SELECT pos FROM scored WHERE doc_id % 4 < 3 QUALIFY row_number() OVER (PARTITION BY source, doc_id % 500 ORDER BY pos) = 1), own AS (SELECT pos, v, score FROM scored WHERE doc_id % 4 = 3),
{greedy_sql('own', 'score', 0.93)}, stays AS (SELECT pos FROM exact UNION ALL SELECT pos FROM kept)
SELECT source || '::' || (row_number() OVER (ORDER BY pos) - 1) AS id, source, doc_id::INT AS doc_id, doc_category, score AS semantic_score FROM scored JOIN stays USING (pos)""")
def _(t: Tables) -> DataFrame:
    return _job(t, F.lit("no_chunk")).select("id", "source", "doc_id", "doc_category", "semantic_score")


_EVERY = RECORDS.replace("CASE WHEN pos % 17 > 0 THEN v END AS v", "v")
_PIVOTED = lambda of, section: f"SELECT '{section}' AS section, name AS metric, value::DOUBLE AS value FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM {of}) ON COLUMNS(*) INTO NAME name VALUE value)"


@query("p2_run_quality_report", f"""WITH {_EVERY}, {_METRICS.replace(VECTORS + ',', 'vectors AS (SELECT pos, embedding::DOUBLE[] AS v, label FROM embeddings JOIN (SELECT pos FROM records) ON pos = vec_id),')}, {_LENGTHS}, lengths AS ({_LENGTH_ROW}), {_NAMES}, {_BY_CATEGORY}, {PAIRS.format(of='records')}, nearest AS (SELECT a, max(sim) AS sim FROM pairs GROUP BY a),
norms AS (SELECT sqrt(list_dot_product(v, v)) AS s FROM records), checked AS (SELECT count(*) AS n, count(*) AS n_valid, 0 AS n_missing, max(len(v)) AS dim, 0 AS n_bad, 0 AS n_zero, count(*) FILTER (NOT has_metadata) AS n_no_metadata, count(*) FILTER (source = '') AS n_no_source, count(*) FILTER (trim(text) = '') AS n_no_text, (SELECT min(s) FROM norms) AS norm_min, (SELECT avg(s) FROM norms) AS norm_mean, (SELECT max(s) FROM norms) AS norm_max,
    (SELECT count(*) FROM (SELECT id FROM records GROUP BY id HAVING count(*) > 1)) AS n_duplicate_ids, (SELECT quantile_cont(s, 0.25) FROM norms) AS norm_p25, (SELECT quantile_cont(s, 0.5) FROM norms) AS norm_p50, (SELECT quantile_cont(s, 0.75) FROM norms) AS norm_p75 FROM records),
near AS (SELECT avg(sim) AS mean, min(sim) AS min, max(sim) AS max, count(*) FILTER (sim >= 0.35) AS n_duplicates, 100.0 * count(*) FILTER (sim >= 0.35) / count(*) AS pct_duplicates, quantile_cont(sim, 0.5) AS p50, quantile_cont(sim, 0.9) AS p90, quantile_cont(sim, 0.95) AS p95, quantile_cont(sim, 0.99) AS p99 FROM nearest),
found AS (SELECT count(*) AS queries, {', '.join(f'avg({m}_{k}) AS mean_{m}_{k}' for m in ('recall', 'precision', 'ndcg') for k in _KS)}, avg(rr) AS mrr, count(*) FILTER (hits_1 > 0) AS queries_with_hit_1 FROM metrics),
out AS ({' UNION ALL '.join(_PIVOTED(of, section) for of, section in (('checked', 'vectors'), ('lengths', 'lengths'), ('near', 'neighbors'), ('found', 'retrieval')))} UNION ALL SELECT 'metadata', name, n FROM ({_WITHOUT}) UNION ALL SELECT 'metadata_keys', name || '.n', count(*) FROM k GROUP BY name UNION ALL SELECT 'tags', name || '.n', count(*) FROM g GROUP BY name
    UNION ALL {' UNION ALL '.join(f"SELECT 'categories', category || '.{c}', {c} FROM by_category" for c in ('n', 'n_sources', 'n_documents', 'mean_length', 'share'))})
SELECT section, metric, round(value, 5) AS value FROM out""")
def _(t: Tables) -> DataFrame:
    """All sections of the report, retrieval over the vectors of the records."""
    rows = records(t).drop("embedding").join(vectors(t).select("pos", "embedding"), "pos")
    cases, relevance = _cases(t)
    known = rows.select("pos")
    cases = cases.join(known.withColumnRenamed("pos", "case_id"), "case_id", "left_semi")
    relevance = E.SharedRelevance(relevance.cases.join(cases.select("case_id"), "case_id", "left_semi"), relevance.members.join(known.withColumnRenamed("pos", "id"), "id", "left_semi"))
    out = run_quality_report(rows, 0.35, cases, relevance, _KS)
    return out.withColumn("value", F.round("value", 5))
