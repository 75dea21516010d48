"""Tables written to the folder that driver and executors share, and global row numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Of Spark 4.1 on: an execution's shuffle files go when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a partition that monotonically_increasing_id() leaves room for, in bits.
_ROW_BITS = 33
#: The folders of the scratch() blocks that are open, the innermost last.
_SCRATCH: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


def _root(spark: SparkSession) -> str:
    context = spark.sparkContext
    if root := context.getConf().get("spark.checkpoint.dir"):
        return root
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context._quern_tables = getattr(context, "_quern_tables", None) or "file://" + tempfile.mkdtemp(prefix="quern-")
    return context._quern_tables


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{_root(spark).rstrip('/')}/{name}"


def materialize(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """df written as Parquet under spark.checkpoint.dir and read again: computed once, and it survives lost executors. Where the setting is unset, a temporary folder serves on one machine, as in tests; on a cluster that is an error. outlives: the table stays when the scratch() around it ends."""
    spark, folders = df.sparkSession, _SCRATCH.get()
    folders = folders[:-1] if outlives else folders
    path = f"{folders[-1] if folders else _root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize() writes inside are deleted at the end, but for those that outlive it; nothing that reads the others may be left by then."""
    folders = _SCRATCH.get()
    path = f"{folders[-1] if folders else _root(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    before = _SCRATCH.set((*folders, path))
    try:
        yield
    finally:
        _SCRATCH.reset(before)
    spark.range(0).write.mode("overwrite").parquet(path)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def in_written_order(df: DataFrame, name: str, table: str, outlives: bool = False) -> DataFrame:
    """df written, with the row's 0-based place in the order of its partitions and their rows: only the sizes of partitions are added up, no row is moved."""
    rows = materialize(df.withColumn("_at", F.monotonically_increasing_id()), table, outlives)
    part = F.shiftright("_at", _ROW_BITS)
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = materialize(rows.groupBy(part.alias("_part")).count().select("_part", before.alias("_before")), "sizes", outlives)
    placed = rows.join(F.broadcast(sizes), part == F.col("_part"))
    return placed.withColumn(name, F.col("_before") + F.col("_at") - F.shiftleft("_part", _ROW_BITS)).drop("_at", "_part", "_before")


def with_global_index(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """df with its 0-based place in the order of these columns: ranges are numbered apart and moved by the sizes of those before."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(F.broadcast(sizes.drop("count")), "_range").withColumn(name, F.col("_before") + place).drop("_range", "_before")


def with_ordinals(df: DataFrame, key: str, *order: str, name: str = "ordinal") -> DataFrame:
    """df with the row's 0-based place among those of its key, in the order of these columns. Keys and order are numbered in ranges, which may part a key, and rows meet their numbers by an id of their own, so no task holds a key's rows."""
    rows = materialize(df.withColumn("_uid", F.monotonically_increasing_id()), "rows")
    placed = materialize(with_global_index(rows.select(F.col(key).alias("_key"), *order, "_uid"), "_key", *order, "_uid", name="_at"), "places")
    first = placed.groupBy("_key").agg(F.min("_at").alias("_first")).withColumnRenamed("_key", "_of")
    numbers = placed.join(first, F.col("_key").eqNullSafe(F.col("_of"))).select("_uid", (F.col("_at") - F.col("_first")).cast("int").alias(name))
    return rows.join(numbers, "_uid").drop("_uid")
