"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir; where that is unset, on one machine (as in tests) under a temporary one, on a cluster an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own_root(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _own_root(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(spark.sparkContext, "_quern_shared", None):
        spark.sparkContext._quern_shared = "file://" + tempfile.mkdtemp(prefix="quern-")
    return spark.sparkContext._quern_shared


def mounted_dir(spark: SparkSession, name: str) -> str:
    """The same as a path that Python workers open: the shared folder must be mounted on the executors."""
    uri = urlparse(shared_dir(spark, name))
    if uri.scheme not in ("", "file"):
        raise ValueError(f"{name}: workers memory-map files, so spark.checkpoint.dir must be a mounted folder, not {uri.scheme}://")
    os.makedirs(uri.path, exist_ok=True)
    return uri.path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: survives lost executors and is computed once."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
