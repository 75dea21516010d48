"""Registration of queries, and the frames that they share, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """t.documents and so on: the tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables under name, with SQL that gives the same rows."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def chunks(t: Tables) -> DataFrame:
    """Documents with a vector as chunks: policy by id, category by language, relevance by quality, flags by id."""
    d, e, q = t.documents, t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding", "label"), t.labels.select("doc_id", F.col("quality").cast("double").alias("relevancia_llm"))
    i = F.col("doc_id")
    rows = d.join(e, "doc_id").join(q, "doc_id", "left")
    flag = lambda tag, k: F.when(i % k == 0, F.lit(tag))
    tags = F.array_compact(F.array(flag("piscina", 2), flag("reserva", 3), flag("abono", 6)))
    return rows.select(
        i.alias("pos"), "source", i.cast("int").alias("doc_id"), (i % 3).cast("int").alias("chunk_index"), F.col("text").alias("page_content"), i.cast("int").alias("row"),
        F.concat(F.lit("E"), (i % 40).cast("string")).alias("entity_key"), F.concat(F.lit("G"), (i % 30).cast("string")).alias("group_key"),
        F.when(i % 4 == 0, "exact_only").when(i % 4 == 1, "exact_key").when(i % 4 == 2, "group_only").alias("dedup_policy"),
        F.when(F.col("lang") == "en", "tarifas").when(F.col("lang") == "fr", "normativa").when(F.col("lang") == "de", "reservas").otherwise("sin_categoria").alias("doc_category"),
        F.map_from_entries(F.transform(tags, lambda x: F.struct(x, F.lit(True)))).alias("tag_flags"), F.when(i % 5 == 0, "no_chunk").alias("chunking_hint"),
        "relevancia_llm", "embedding", "label", (i * 7919 % 1000 / 1000).alias("semantic_score"),
    )


#: The same in SQL, as the CTE `chunks`; vectors as DOUBLE[].
CHUNKS = """chunks AS (SELECT d.doc_id AS pos, d.source, d.doc_id::INT AS doc_id, (d.doc_id % 3)::INT AS chunk_index, d.text AS page_content, d.doc_id::INT AS row,
    'E' || (d.doc_id % 40) AS entity_key, 'G' || (d.doc_id % 30) AS group_key,
    CASE d.doc_id % 4 WHEN 0 THEN 'exact_only' WHEN 1 THEN 'exact_key' WHEN 2 THEN 'group_only' END AS dedup_policy,
    CASE d.lang WHEN 'en' THEN 'tarifas' WHEN 'fr' THEN 'normativa' WHEN 'de' THEN 'reservas' ELSE 'sin_categoria' END AS doc_category,
    list_filter([CASE WHEN d.doc_id % 2 = 0 THEN 'piscina' END, CASE WHEN d.doc_id % 3 = 0 THEN 'reserva' END, CASE WHEN d.doc_id % 6 = 0 THEN 'abono' END], lambda x: x IS NOT NULL) AS tags,
    CASE WHEN d.doc_id % 5 = 0 THEN 'no_chunk' END AS chunking_hint, q.quality::DOUBLE AS relevancia_llm, e.embedding::DOUBLE[] AS v, e.label, d.doc_id * 7919 % 1000 / 1000 AS semantic_score
    FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels q ON q.doc_id = d.doc_id)"""
#: Vectors and the dot products of all ordered pairs of different rows.
VECTORS = "vectors AS (SELECT vec_id AS pos, embedding::DOUBLE[] AS v, label FROM embeddings)"
PAIRS = "pairs AS (SELECT a.pos AS a, b.pos AS b, list_dot_product(a.v, b.v) AS sim FROM {of} a JOIN {of} b ON a.pos <> b.pos)"


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("pos"), "embedding", "label")
