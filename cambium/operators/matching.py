"""One-to-one assignment: greedy by components or best edges first, and reciprocal best with margins; what stays unmatched; report counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.functions import hashing as H
from cambium.operators import graph
from cambium.operators.scratch import cut, free

__all__ = ["best_first", "cut", "free", "greedy", "match_summary", "ranked_both_ways", "reciprocal_best", "top_candidates", "unmatched"]


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges in order, without those that share an end with an edge taken before."""
    left: set[object] = set()
    right: set[object] = set()
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            fine = a not in left and b not in right
            keep.append(fine)
            if fine:
                left.add(a)
                right.add(b)
        yield batch.filter(pa.array(keep, pa.bool_())).select(range(batch.num_columns - 2))


def _placed(order: list[Column]) -> Column:
    return F.struct(*[o.alias(f"o{k}") for k, o in enumerate([*order, F.col("i1"), F.col("i2")])])


def _walk(dealt: DataFrame, order: Column, columns: list[str]) -> DataFrame:
    """What _taken keeps of each partition of dealt, gone through in order."""
    ends = [(F.col(i) if isinstance(dealt.schema[i].dataType, T.IntegralType) else F.to_json(F.struct(i))).alias(f"_{i}") for i in ("i1", "i2")]
    rows = dealt.sortWithinPartitions(order).select(*columns, *ends)
    return rows.mapInArrow(_taken, dealt.select(*columns).schema)


def greedy(edges: DataFrame, order: list[Column], most_edges: int = 2_000_000) -> DataFrame:
    """Greedy one-to-one matching, best edge first, of edges (i1, i2, ...).

    order, with i1 and i2 after it, must rank edges totally. Edges of unlike connected components have no end in common, so
    each task goes through the edges of whole components in order and keeps the ends it has used. Components of more than
    most_edges go by best_first.
    """
    columns = edges.columns
    edges = cut(edges.select("*", F.xxhash64(F.lit(1), "i1").alias("_a"), F.xxhash64(F.lit(2), "i2").alias("_b")), "edges")
    found = cut(graph.components(edges.select(F.col("_a").alias("a"), F.col("_b").alias("b"))), "components")
    labelled = edges.join(found.withColumnRenamed("node", "_a"), "_a")
    large = cut(labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_edges).select("component"), "large")
    rest = None if large.isEmpty() else cut(labelled.join(large, "component", "left_semi").select(*columns), "large")
    own = labelled if rest is None else labelled.join(large, "component", "left_anti")
    taken = cut(_walk(own.repartition("component"), _placed(order), columns), "taken")
    free(edges, found)
    return taken if rest is None else taken.unionByName(best_first(rest, order, most_edges))


#: Edges that are looked at to find where the best ones end, and ends that every executor may hold.
LOOKED_AT, HELD_ENDS = 20_000, 500_000


def best_first(edges: DataFrame, order: list[Column], most_edges: int = 2_000_000) -> DataFrame:
    """What greedy gives, for edges of few components that are large: no components are sought.

    The best edges, about most_edges, go through one task in order; whatever they leave can't change what they took. Then all
    edges go that share an end with a taken one, so each round takes most_edges off the rest and mostly many more.
    """
    columns = edges.columns
    rest = edges if getattr(edges, "_cut_path", None) else cut(edges, "edges")
    taken: DataFrame | None = None
    while True:
        n = rest.count()
        head = rest
        if n > most_edges:
            # A sample says where to part them; wherever that is, the result is the same.
            share = min(1.0, LOOKED_AT / n)
            last = rest.sample(share, seed=7).select(_placed(order).alias("_order")).orderBy("_order").limit(max(1, int(share * most_edges))).agg(F.max("_order").alias("_last"))
            head = rest.join(F.broadcast(last), F.col("_last").isNull() | (_placed(order) <= F.col("_last")))
        won = cut(_walk(head.select(*columns).repartition(1), _placed(order), columns), "won")
        taken = won if taken is None else taken.unionByName(won)
        less = rest
        if n > most_edges:
            few = won.count() <= HELD_ENDS
            for i in ("i1", "i2"):
                ends = won.select(i)
                less = less.join(F.broadcast(ends) if few else ends, i, "left_anti")
            less = cut(less.select(*columns), "edges")
        if rest is not edges:
            free(rest)
        if n <= most_edges:
            return taken
        rest = less


def ranked_both_ways(scored: DataFrame) -> DataFrame:
    """scored (i1, i2, score) with each pair's place and margin to the runner-up on both sides."""
    source = Window.partitionBy("i1").orderBy(F.desc("score"), "i2")
    target = Window.partitionBy("i2").orderBy(F.desc("score"), "i1")
    rows = scored.withColumn("source_place", F.row_number().over(source)).withColumn("source_next", F.lead("score").over(source))
    rows = rows.withColumn("target_place", F.row_number().over(target)).withColumn("target_next", F.lead("score").over(target))
    return rows.withColumn("source_margin", F.col("score") - F.coalesce("source_next", F.lit(0))).withColumn("target_margin", F.col("score") - F.coalesce("target_next", F.lit(0))).drop("source_next", "target_next")


def reciprocal_best(scored: DataFrame, least_score: int = 7200, least_margin: int = 700) -> DataFrame:
    """One row for each i1: its best i2, decision (accepted or abstained) and confidence. Two windows, no loop."""
    best = ranked_both_ways(scored).where("source_place = 1")
    accepted = (F.col("target_place") == 1) & (F.col("score") >= least_score) & (F.col("source_margin") >= least_margin) & (F.col("target_margin") >= least_margin)
    return best.select("i1", "i2", "score", "source_margin", "target_margin", F.when(accepted, "accepted").otherwise("abstained").alias("decision"), H.tier(F.col("score"), F.col("source_margin"), F.col("target_margin")).alias("confidence"))


def top_candidates(candidates: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each i1, with truncated: were there more?"""
    own = Window.partitionBy("i1")
    rows = candidates.withColumn("place", F.row_number().over(own.orderBy(*order))).withColumn("truncated", F.count(F.lit(1)).over(own) > k)
    return rows.where(F.col("place") <= k)


def unmatched(rows: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """rows whose id no match holds on that side (i1 or i2)."""
    return rows.join(matches.select(F.col(side).alias("id")), "id", "left_anti")


def match_summary(left: DataFrame, right: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: counts and similarity (matched over the larger side, 10000 for two empty sides), in basis points."""
    n = lambda t, name: t.agg(F.count(F.lit(1)).alias(name))
    row = n(left, "n_old").join(n(right, "n_new"), F.lit(True)).join(n(matches, "matched"), F.lit(True))  # one row each
    high = F.greatest("n_old", "n_new")
    return row.withColumn("removed", F.col("n_old") - F.col("matched")).withColumn("added", F.col("n_new") - F.col("matched")).withColumn("similarity_bps", F.when(high == 0, F.lit(H.SCALE)).otherwise(F.floor(F.col("matched") * H.SCALE / high)).cast("long"))
