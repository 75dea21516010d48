"""Column functions over ARRAY<FLOAT> or ARRAY<DOUBLE> vectors, computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """v over its norm; a zero vector stays zero."""
    n = F.array(norm(v))
    return F.transform(n, lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n)))[0]


def cut_dim(v: Column, cap: int) -> Column:
    """The first cap values, normalised anew; a vector of cap values or fewer stays as it is."""
    return F.when(F.size(v) > cap, l2_normalize(F.slice(v, 1, cap))).otherwise(v.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(n == 0, F.lit(1.0)).otherwise(n))


def centroid(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: the mean vector, of unit norm if it isn't zero. Only one row of sums per dimension and task is shuffled."""
    mean = df.select(F.posexplode(vector).alias("at", "v")).groupBy("at").agg(F.avg(F.col("v").cast("double")).alias("v"))
    whole = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda e: e["v"]).alias("centroid"))
    return whole.select(l2_normalize(F.col("centroid")).alias("centroid"))


def centrality(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """df with the dot product of its vector and the centroid, a single row of known width."""
    return df.join(F.broadcast(centroid(df, vector)), how="cross").withColumn("centrality", dot(F.col(vector), F.col("centroid"))).drop("centroid")
