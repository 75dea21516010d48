"""Pipeline over documents: classify quality, drop near duplicates, redact secrets, mix sources, encode and decode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. Every
stage but the last returns the columns of docs; the last returns (doc_id, n_tokens, ids_sha256, decoded_sha256).

The classifier can't be expressed in SQL, so there is no ORACLE_SQL; tests/llm hold the stages against brute-force versions.

Defined results: rows without a doc_id are judged by no one and pass the first two stages; rows that repeat a doc_id stay or go together;
a null or empty text scores as its statistics say, is near to nothing, holds no secret, has size 0 in the mix, so that none is taken in a
part but some in a whole pass, and encodes to no ids; other columns, whatever their names, pass through all stages but the last; an empty
table gives empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm.byte_bpe import round_trip
from quern.llm.mixing import mixed
from quern.llm.near_dedup import near_duplicates
from quern.llm.quality_classifier import classify
from quern.llm.secret_scan import redacted
from quern.llm.shared import materialize

ORACLE_SQL = None
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _keep(docs: DataFrame, verdicts: DataFrame, condition: str) -> DataFrame:
    """The rows of docs whose doc_id has a verdict that meets the condition; rows without a doc_id stay."""
    bad = verdicts.where(f"doc_id IS NOT NULL AND NOT ({condition})").select("doc_id").distinct()
    return docs.join(bad.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return _keep(docs, classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "predicted = 1")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return _keep(docs, near_duplicates(docs), "kept")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mark; no document goes."""
    return redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights: a row for each copy taken."""
    return mixed(docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of what they decode to."""
    return round_trip(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", classify_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode_and_decode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
