"""Connected components over edge tables: rounds of large star and small star, each round written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.operators.scratch import cut, free


def _round(edges: DataFrame) -> DataFrame:
    """Larger neighbours are linked to the least neighbour of a node, then all lesser ones to the least of them."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    large = both.join(low, "a").where("b > a AND b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b) of longs: the least node that each node with an edge reaches.

    The number of rounds grows with the logarithm of the longest path; a group costs a row a member and round.
    """
    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x")).first()
        if state == (now.n, now.x):
            break
        state = (now.n, now.x)
        stepped = cut(_round(edges), "edges")
        free(edges)
        edges = stepped
    least = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return least.union(least.select(F.col("component").alias("node"), "component").distinct())
