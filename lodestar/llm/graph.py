"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def _beside(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges(u, v) with the least m of each u. The key is not the column that `least` was grouped by, so both sides are dealt for
    the join alone and Spark can split a hub among several tasks."""
    key = F.col("u").bitwiseXOR(F.lit(1))
    return edges.withColumn("key", key).join(least.select(key.alias("key"), "m"), "key").drop("key")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for each id of edges(a, b), component its smallest reachable id.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until the edge list stands still; every
    round is written to the shared folder and the one before deleted, nothing is collected. Self-loops and repeated edges are
    harmless; nulls are dropped.
    """
    edges = materialize(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        both = edges.where("u <> v").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _beside(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _beside(large, least).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, edges = edges, materialize(small.select("e.*").where("u <> v").distinct())
        forget(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v", "u") % 999983)).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    heads = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(heads)
