"""Source maps as tables, and position queries over them as as-of joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cambium.functions import sourcemap
from cambium.operators import ordered as O

#: Columns fit below this; a position is line * WIDTH + column.
WIDTH = 1 << 31


def segments(maps: DataFrame, limits: sourcemap.Limits = sourcemap.Limits()) -> DataFrame:
    """Segments of maps (map_id, json): map_id, at, seg_ix, gen_line, gen_col, source, orig_line, orig_col, name."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, k, g.line, g.column, g.source, g.original_line, g.original_column, g.name) for i, text in zip(frame["map_id"], frame["json"], strict=True) for k, g in enumerate(sourcemap.decode(text, limits))]
            yield pd.DataFrame(rows, columns=["map_id", "seg_ix", "gen_line", "gen_col", "source", "orig_line", "orig_col", "name"]).astype({"orig_line": "Int64", "orig_col": "Int64"})

    kind = maps.schema["map_id"].dataType.simpleString()
    made = maps.select("map_id", "json").mapInPandas(run, f"map_id {kind}, seg_ix long, gen_line long, gen_col long, source string, orig_line long, orig_col long, name string")
    return made.withColumn("at", F.col("gen_line") * WIDTH + F.col("gen_col"))


def validate(maps: DataFrame, limits: sourcemap.Limits = sourcemap.Limits()) -> DataFrame:
    """(map_id, valid, segments, digest, error) of maps (map_id, json): whether each is sound and within the limits, how many
    segments it has, the SHA-256 of its bytes, and what is wrong."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, text in zip(frame["map_id"], frame["json"], strict=True):
                try:
                    rows.append((i, len(sourcemap.decode(text, limits)), None))
                except sourcemap.MapError as e:
                    rows.append((i, None, str(e)))
            yield pd.DataFrame(rows, columns=["map_id", "segments", "error"]).astype({"segments": "Int64"})

    kind = maps.schema["map_id"].dataType.simpleString()
    found = maps.select("map_id", "json").mapInPandas(run, f"map_id {kind}, segments long, error string")
    digest = maps.select("map_id", F.sha2(F.col("json").cast("binary"), 256).alias("digest"))
    return found.join(digest, "map_id").select("map_id", F.col("error").isNull().alias("valid"), "segments", "digest", "error")


def positions(sources: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """offsets (keys, byte) with line and column (UTF-16 units, from 0) in sources (keys, source). A byte that starts no
    character is an error."""
    asked = offsets.groupBy(*keys).agg(F.collect_set("byte").alias("bytes"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = frame[keys].copy()
            made["found"] = [[{"byte": b, "line": l, "column": c} for b, (l, c) in zip(at, sourcemap.positions(text or "", list(at)), strict=True)] for text, at in zip(frame["source"], frame["bytes"], strict=True)]
            yield made

    schema = ", ".join([*[f"{k} {sources.schema[k].dataType.simpleString()}" for k in keys], "found array<struct<byte:long,line:long,column:long>>"])
    return sources.join(asked, keys).select(*keys, "source", "bytes").mapInPandas(run, schema).select(*keys, F.inline("found"))


def redacted(found: DataFrame) -> DataFrame:
    """What a lookup found, without the names of sources and symbols."""
    return found.drop("source", "name")


def lookup(queries: DataFrame, table: DataFrame, spread: bool = False) -> DataFrame:
    """queries (map_id, line, column, ...) with source, orig_line, orig_col, name and status.

    The segment in force is the one at the greatest position not after the query's, on that line or an earlier one. All
    segments at that position count: several are `ambiguous`; one without an original, or none, is `unmapped`. With spread,
    the positions of one map are dealt to many tasks: for maps with more segments and queries than one task should sort.
    """
    extra = [c for c in queries.columns if c != "map_id"]
    q = queries.withColumn("at", F.col("line") * WIDTH + F.col("column"))
    rows = O.asof_rows(q, table.select("map_id", "at", "source", "orig_line", "orig_col", "name"), ["map_id"], "at", spread)
    found = rows.select("map_id", *extra, "source", "orig_line", "orig_col", "name").distinct()
    found = found.withColumn("n", F.count("orig_line").over(Window.partitionBy("map_id", *extra))).where("n = 0 OR orig_line IS NOT NULL")
    return found.withColumn("status", F.when(F.col("n") == 0, "unmapped").when(F.col("n") > 1, "ambiguous").otherwise("mapped")).drop("n")


def compose(queries: DataFrame, outer: DataFrame, inner: DataFrame, inner_of: DataFrame, spread: bool = False) -> DataFrame:
    """lookup in outer, then of what it finds in the map that inner_of (source, inner_id) names; the inner name wins."""
    first = lookup(queries, outer, spread).join(inner_of, "source", "left")
    keys = [c for c in queries.columns]
    second = first.where("status != 'unmapped'").select(*[F.col(k).alias(f"q_{k}") for k in keys], F.col("inner_id").alias("map_id"), F.col("orig_line").alias("line"), F.col("orig_col").alias("column"), F.col("name").alias("outer_name"))
    found = lookup(second, inner, spread)
    found = found.select(*[F.col(f"q_{k}").alias(k) for k in keys], "source", "orig_line", "orig_col", F.coalesce("name", "outer_name").alias("name"), "status")
    lost = first.where("status = 'unmapped'").select(*keys, F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("orig_line"), F.lit(None).cast("long").alias("orig_col"), F.lit(None).cast("string").alias("name"), "status")
    return found.unionByName(lost)
