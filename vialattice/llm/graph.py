"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialize


def _summary(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


#: A vertex of more than this share of the edges, and of at least so many, is dealt over salts.
SHARE, LEAST, SALTS = 500, 1000, 64


def _with_least(edges: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """``edges`` (a, b) with the columns that ``least`` (a, n, m) has of a; a hub's edges go to many tasks."""
    limit = max(LEAST, rows // SHARE)  # at most SHARE vertices have more
    hot = F.broadcast(least.where(F.col("n") > limit).select("a", F.lit(SALTS).alias("many")))
    left = edges.join(hot, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("many", F.lit(1))).cast("int")).drop("many")
    right = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > limit, SALTS - 1).otherwise(0)))).drop("n")
    return left.join(right, ["a", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of each vertex: (id, component), for vertices that have an edge.

    ``edges`` has long columns a and b. Alternates large-star and small-star steps, each an
    aggregation to the least neighbour and a join that deals a hub's edges over salts, until the edges are stars around the least ids.
    Each round's edges are written to the shared folder, and the previous round's are deleted.
    """
    edges, path = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _summary(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.count("*").alias("n"), F.least(F.min("b"), F.col("a")).alias("m"))
        large = _with_least(both, least, 2 * seen[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large, large_path = materialize(large.where("a <> b").distinct(), "edges")
        least = large.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m"))
        small = _with_least(large, least, 2 * seen[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        small, small_path = materialize(small.distinct(), "edges")
        drop_path(edges.sparkSession, path)
        drop_path(edges.sparkSession, large_path)
        edges, path = small, small_path
        if (now := _summary(edges)) == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
