"""Both jobs end to end, and the registered queries against their SQL on the smallest tables."""

import glob
import json
import os
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators.chunking import split_text
from quern.operators.dedup import EVENT
from quern.plans.corpus_job import run_corpus_job
from quern.queries import base, evaluation, retrieval, samples, tables, texts, vectors  # noqa: F401
from quern.queries.texts import hash_embedder, keyword_tagger
from quern.sources import files

SF = "/root/testdata/sf0.001"


def test_corpus_job(spark, tmp_path):
    rows = [(f"f{i % 3}", i, f"Texto {i % 9} con palabras y números {i % 9}.", i, "no_chunk" if i % 2 else None, f"E{i % 2}", None, "exact_key" if i % 4 == 0 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, "source string, doc_id int, page_content string, row int, chunking_hint string, entity_key string, group_key string, dedup_policy string")
    job = run_corpus_job(docs, hash_embedder, keyword_tagger, 16)
    d = job.metrics["dedup"].first()
    assert d.pre == 40 and d.post == d.pre - d.exact - d.semantic and d.exact > 0 and d.semantic > 0
    ids = [r.id for r in job.index.select("id").collect()]
    assert len(ids) == len(set(ids)) == d.post and sorted(int(i.split("::")[1]) for i in ids) == list(range(d.post))
    files.write_audit(job.events, str(tmp_path / "audit"))
    assert files.read_audit(spark, str(tmp_path / "audit"), EVENT).count() == d.total
    total = job.metrics["sources"].where("source IS NULL").first()
    assert (total.docs, total.chunks_pre, total.chunks_post) == (40, 40, d.post)
    assert job.metrics["integrity"].first().n == 40 and job.indexed is None
    emptied = {r.fuente for r in job.metrics["emptied"].collect()}
    assert emptied == {r.source for r in job.metrics["sources"].where("emptied AND source IS NOT NULL").collect()}
    told = {(r.signal, r.subject) for r in job.metrics["signals"].collect()}
    assert {s for n, s in told if n == "emptied_source"} == emptied and any(n == "short_chunks" for n, _ in told)
    plain = run_corpus_job(docs.withColumn("source", F.lit("one")), hash_embedder, keyword_tagger, 16, tsd=False, table="corpus_job_index")
    assert plain.index.count() == 40 and plain.events is None and plain.indexed == (40, 40)
    assert {r.id for r in spark.table("corpus_job_index").select("id").collect()} == {f"one::{i}" for i in range(40)}
    spark.sql("DROP TABLE corpus_job_index")


def test_job_reads_and_cleans_a_document_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    rows = [(f"f{i % 3}", i, f"Texto {i} con palabras.", i, ("no_chunk", "light_chunk", None)[i % 3], f"E{i}", None, "exact_key") for i in range(30)]
    docs = spark.createDataFrame(rows, "source string, doc_id int, page_content string, row int, chunking_hint string, entity_key string, group_key string, dedup_policy string")
    assert run_corpus_job(docs.mapInPandas(counted, docs.schema), hash_embedder, keyword_tagger, 16).index.count() == 30
    assert read.value == 30


def size_of(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path.removeprefix('file://')}/**", recursive=True) if os.path.isfile(f))


def test_job_writes_texts_once(spark):
    """Of a job's texts, which can't be packed, one copy is left beside what the steps found, and none in shuffles."""
    rng = np.random.default_rng(2)
    rows = [(f"f{i % 3}", i, " ".join(rng.bytes(int(n)).hex() for n in rng.integers(2, 12, 1500)), i, ("no_chunk", None)[i % 2], f"E{i}", None, ("exact_key", None)[i % 3 > 1]) for i in range(200)]
    docs = spark.createDataFrame(rows, "source string, doc_id int, page_content string, row int, chunking_hint string, entity_key string, group_key string, dedup_policy string")
    folders = [spark.conf.get("spark.checkpoint.dir"), spark.conf.get("spark.local.dir")]
    docs.write.parquet(path := f"{folders[0]}/texts-alone")
    texts, before = size_of(path), [size_of(f) for f in folders]
    job = run_corpus_job(spark.read.parquet(path), hash_embedder, keyword_tagger, 16, overlap=0)
    shared, shuffled = (size_of(f) - b for f, b in zip(folders, before, strict=True))
    assert shared < 2 * texts and shuffled < texts, (shared, shuffled, texts)
    assert job.index.where("chunk_index = 0").count() > 130 and job.metrics["dedup"].first().pre > 1000


def plain_job(docs, size, overlap, threshold):
    """The job over rows(source, doc_id, text, hint, entity) with a loop for each step; one policy by doc_id."""
    chunks = []
    for source, doc, text, hint, entity in sorted(docs):
        whole = hint == "no_chunk" or hint == "light_chunk" and len(text) <= size
        chunks += [(source, doc, n, part, entity) for n, part in enumerate([text] if whole else split_text(text, size, overlap))]
    v = np.array(hash_embedder([c[3] for c in chunks]))
    centre = v.mean(axis=0)
    sims = v @ v.T
    np.fill_diagonal(sims, -1)
    said = json.loads(keyword_tagger(["x"])[0])
    score = np.round(0.45 * said["relevancia"] + 0.2 * v @ (centre / np.linalg.norm(centre)) + 0.2 * (1 - np.maximum(0, sims.max(axis=1))) + 0.15 * 0.7, 4)
    seen, kept = set(), []
    for n, (source, doc, _, _, entity) in enumerate(chunks):
        if doc % 4 == 0 and (source, entity) not in seen:
            seen.add((source, entity))
            kept.append(n)
    near = []
    for n in sorted((n for n in range(len(chunks)) if chunks[n][1] % 4), key=lambda n: (-score[n], n)):
        if not any(sims[n, k] >= threshold for k in near):
            near.append(n)
    return [(f"{chunks[n][0]}::{i}", chunks[n][1], chunks[n][2], chunks[n][3], pytest.approx(score[n], abs=1e-4)) for i, n in enumerate(sorted(kept + near))]


def test_job_with_splitting_equals_a_plain_version(spark):
    rng = np.random.default_rng(3)
    words = ["a", "de", "uno", "casa", "plaza", "piscina", "entradas", "deportivo", "municipales", "instalación"]
    text = lambda n: ". ".join(" ".join(words[i] for i in rng.integers(0, 10, 8)) for _ in range(n))
    docs = [(f"f{i % 3}", i, text(int(rng.integers(1, 30))), (None, "no_chunk", "light_chunk")[i % 3], f"E{i % 5}") for i in range(60)]
    docs += [("f9", 60 + i, docs[2 * i][2], None, "E0") for i in range(9)]
    rows = [(s, d, t, d, h, e, None, "exact_key" if d % 4 == 0 else None) for s, d, t, h, e in docs]
    df = spark.createDataFrame(rows, "source string, doc_id int, page_content string, row int, chunking_hint string, entity_key string, group_key string, dedup_policy string")
    job = run_corpus_job(df.repartition(5), hash_embedder, lambda prompts: keyword_tagger(["x"] * len(prompts)), 16, size=200, overlap=30, threshold=0.97)
    got = [(r.id, r.doc_id, r.chunk_index, r.document, r.semantic_score) for r in job.index.collect()]
    expected = plain_job(docs, 200, 30, 0.97)
    assert sorted(got, key=lambda r: int(r[0].split("::")[1])) == expected and 150 < len(expected) < 400


def _value(v):
    return str(float(v)) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["t1_clean_text", "t11_normalize_verdict", "g2_chunk_routing", "c6_grouped_docs", "s6_read_delimited", "s6_read_delimited_folder", "load_files", "v6_greedy_semantic_dedup", "v7_deduplicate", "v10_evaluate_retrieval", "p1_corpus_job_whole", "j5_similarity_join", "o2_rag_batch", "a1_chunk_length_stats", "w4_question_types", "flagship"])
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    out = base.QUERIES[name](spark, SF)
    expected = con.sql(base.ORACLE_SQL[name])
    assert sorted(out.columns) == sorted(expected.columns)
    order = sorted(range(len(expected.columns)), key=lambda i: expected.columns[i])
    got = sorted(tuple(map(_value, r)) for r in out.select(*sorted(out.columns)).collect())
    assert got == sorted(tuple(_value(r[i]) for i in order) for r in expected.fetchall())
