"""Centroid clustering in JVM-native expressions: integer distances to literal centroids, a minimum of structs, column sums.

Vectors of exactly `width` components, none null or not finite, are kept; a component x becomes floor(scale * x). The first centroids are
the kept vectors whose ids have the smallest digests. Each round assigns every vector to its nearest centroid (of equals the one with the
smaller number) and replaces the centroid of every cluster that has vectors by floor(sum / count) in each component; then all are
assigned once more. Everything is in longs, so the result doesn't depend on how rows are dealt out.

A round is one scan with an aggregate of one row for each cluster, width sums in it: no row is shuffled, and the driver holds k centroids.

Defined results: rows that repeat an id are vectors of their own (of equal digests the smaller vector comes first); a row without an id
is assigned like any other, but starts no centroid; fewer vectors than k give fewer centroids; no vector gives no row; numbers that a
long can't hold are an error. Other columns of the input are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.shared import materialize

WIDTH, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3


def integer_vector(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as longs; null where a component is null or not finite."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fits, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def literal_vector(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' if v > -(2**63) else 'CAST(-9223372036854775808 AS BIGINT)' for v in values)})")


def distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, d: s + d)


def nearest_centroid(vector: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest one; of equals the smaller number."""
    return F.array_min(F.array(*(F.struct(distance(vector, literal_vector(c)).alias("distance"), F.lit(n).alias("cluster")) for n, c in enumerate(centroids))))


def first_centroids(kept: DataFrame, k: int, round_seed: int = 1) -> list[list[int]]:
    """The vectors v of the k ids with the smallest digests: at most k rows leave a task."""
    digest = F.sha2(F.concat(F.lit(f"{round_seed}:"), F.col("id").cast("string")), 256)
    return [r.v for r in kept.where("id IS NOT NULL").select("v", digest.alias("digest")).orderBy("digest", "v").limit(k).collect()]


def moved(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: k rows of sums come to the driver."""
    width = len(centroids[0])
    at = kept.select(nearest_centroid(F.col("v"), centroids)["cluster"].alias("cluster"), *(F.col("v")[i].alias(f"x{i}") for i in range(width)))
    sums = at.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"x{i}") for i in range(width)))
    floored = [F.expr(f"(x{i} - pmod(x{i}, n)) div n").alias(f"x{i}") for i in range(width)]
    new = {r.cluster: list(r[1:]) for r in sums.select("cluster", *floored).collect()}
    return [new.get(n, c) for n, c in enumerate(centroids)]


def cluster_vectors(df: DataFrame, id: str, vector: str, width: int = WIDTH, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every kept vector: its cluster, the squared distance to that centroid, and that distance summed over the cluster and over all."""
    rows = df.select(F.col(id).alias("id"), F.when(F.size(vector) == width, integer_vector(F.col(vector), scale)).alias("v"))
    kept = materialize(rows.where("v IS NOT NULL"), "integer-vectors")
    centroids = first_centroids(kept, k)
    if not centroids:
        return kept.select("id", *(F.lit(None).cast(kind).alias(name) for name, kind in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid", "array<long>"))))
    centroids = reduce(lambda c, _: moved(kept, c), range(rounds), centroids)
    assigned = materialize(kept.select("id", nearest_centroid(F.col("v"), centroids).alias("b")).select("id", "b.cluster", "b.distance"), "clusters")
    totals = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    # of k clusters, so small enough to be literals
    of_cluster = lambda value: reduce(lambda c, n: c.when(F.col("cluster") == n, value(n)), totals, F)
    return assigned.select(
        "id", "cluster", "distance", of_cluster(lambda n: F.lit(totals[n]).cast("long")).alias("cluster_inertia"), F.lit(sum(totals.values())).cast("long").alias("inertia"), of_cluster(lambda n: literal_vector(centroids[n])).alias("centroid"),
    )
