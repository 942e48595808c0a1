"""Connected components over edge tables: rounds of large-star and small-star, each round written and reread."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.llm.common import Scratch


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Links each node's larger (large star) or smaller (small star) neighbours to the least of them all."""
    if both_ways:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = near.join(low, "a")
    if both_ways:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the least node that each node with an edge reaches. Takes edges (a, b) of longs; loops and repeats are harmless.

    A large group costs one row a member and round, not one for each pair. A node without edges has no row.
    """
    edges = scratch.table(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    state = None
    for k in count(1):
        stepped = scratch.table(_stars(_stars(edges, True), False), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        edges = stepped
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x")).first()
        if state == (now.n, now.x):
            break
        state = (now.n, now.x)
    least = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return least.union(least.select(F.col("component").alias("node"), "component").distinct())
