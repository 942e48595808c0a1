"""Archived comparisons: a folder of Parquet tables and a manifest that tells whether they are whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = 1
TABLES = ["declarations", "matches", "changes"]


class DumpError(ValueError):
    pass


def _manifest(table: DataFrame, name: str) -> DataFrame:
    """One row: rows and a digest of a table that doesn't depend on their order (sums of two hashes of each row)."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(table.columns)]))
    first, second = (F.sum(F.conv(F.substring(F.sha2(row, 256), at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16))
    return table.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(":", F.coalesce(first, F.lit(0)).cast("string"), F.coalesce(second, F.lit(0)).cast("string")), 256).alias("digest")).select(F.lit(name).alias("name"), F.lit(VERSION).alias("version"), "rows", "digest")


def save(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> None:
    """Writes tables and, last, their manifest: a folder without one is not a dump."""
    if set(tables) != set(TABLES):
        raise DumpError(f"a dump holds {TABLES}")
    parts = None
    for name in TABLES:
        tables[name].write.mode("errorifexists").option("compression", "zstd").parquet(f"{folder}/{name}")
        one = _manifest(spark.read.parquet(f"{folder}/{name}"), name)
        parts = one if parts is None else parts.unionByName(one)
    parts.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/manifest")


def validate(spark: SparkSession, folder: str) -> DataFrame:
    """(name, problem) of what is not as the manifest says. Empty for a whole dump."""
    said = spark.read.parquet(f"{folder}/manifest")
    found = None
    for name in TABLES:
        one = _manifest(spark.read.parquet(f"{folder}/{name}"), name)
        found = one if found is None else found.unionByName(one)
    both = said.alias("s").join(found.alias("f"), "name", "full_outer")
    problem = F.when(F.col("s.version").isNull() | F.col("f.version").isNull(), "missing").when(F.col("s.version") != VERSION, "version").when(F.col("s.rows") != F.col("f.rows"), "rows").when(F.col("s.digest") != F.col("f.digest"), "digest")
    return both.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a dump; DumpError where they are not whole."""
    if wrong := validate(spark, folder).collect():  # a row a table at most
        raise DumpError(", ".join(f"{r.name}: {r.problem}" for r in wrong))
    return {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}


def find(dump: dict[str, DataFrame], name: str) -> DataFrame:
    """Declarations of a name, each with its match: the old side's first."""
    d = dump["declarations"].where(F.col("name") == name).select("side", "id", "kind", "line", "signature")
    m = dump["matches"]
    old = d.where("side = 'old'").join(m.select(F.col("i1").alias("id"), F.col("name_new").alias("other"), "similarity", "classification"), "id", "left")
    new = d.where("side = 'new'").join(m.select(F.col("i2").alias("id"), F.col("name_old").alias("other"), "similarity", "classification"), "id", "left")
    return old.unionByName(new).orderBy(F.desc("side"), "id")


def find_first(dump: dict[str, DataFrame], name: str) -> DataFrame:
    """The first declaration of a name: of the old side, else of the new."""
    return dump["declarations"].where(F.col("name") == name).orderBy(F.desc("side"), "id").limit(1).select("side", "id", "name", "kind", "line", "signature")


def match_of(dump: dict[str, DataFrame], pair_id, decl_ix: int) -> DataFrame:
    return dump["matches"].where((F.col("i1.pair_id") == pair_id) & (F.col("i1.decl_ix") == decl_ix))


def match_named(dump: dict[str, DataFrame], name: str | None = None) -> DataFrame:
    """(pair_id, name, line, other, other_line, similarity): for each pair the first old declaration of a name (of every
    name if none is given) and what it matches; null if nothing."""
    d = dump["declarations"]
    old = d.where("side = 'old'") if name is None else d.where((F.col("side") == "old") & (F.col("name") == name))
    first = old.groupBy("pair_id", "name").agg(F.min_by(F.struct("id", "line"), "decl_ix").alias("f")).select("pair_id", "name", "f.id", "f.line")
    new = d.where("side = 'new'").select(F.col("id").alias("i2"), F.col("name").alias("other"), F.col("line").alias("other_line"))
    found = first.join(dump["matches"].select(F.col("i1").alias("id"), "i2", "similarity"), "id", "left").join(new, "i2", "left")
    return found.select("pair_id", "name", "line", "other", "other_line", "similarity")


def inspect(declarations: DataFrame, matches: DataFrame, name: str) -> DataFrame:
    """What there is of a name: the old side's declarations with what they match, then those of the new side that no
    declaration shown matches. (pair_id, side, id, kind, line, end_line, size, signature, other, other_line, similarity,
    hashes, strings, constants, api, text): the first 10 hashes, 5 of each kind of evidence, and 200 characters."""
    most = F.slice("hashes", 1, 10).alias("hashes"), *[F.slice(c, 1, 5).alias(c) for c in ("strings", "constants", "api")]
    show = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text")).alias("text")
    rows = declarations.where(F.col("name") == name).select("pair_id", "side", "id", "kind", "line", "end_line", "size", "signature", *most, show)
    new = declarations.where("side = 'new'").select(F.col("id").alias("i2"), F.col("name").alias("other"), F.col("line").alias("other_line"))
    met = matches.select("i1", "i2", "similarity").join(new, "i2")
    old = rows.where("side = 'old'").join(met.withColumnRenamed("i1", "id"), "id", "left")
    shown = old.select(F.col("i2").alias("id")).where("id IS NOT NULL")
    rest = rows.where("side = 'new'").join(shown, "id", "left_anti")
    return old.drop("i2").unionByName(rest, allowMissingColumns=True)


def unmatched(dump: dict[str, DataFrame], side: str) -> DataFrame:
    """Declarations of a side (old or new) that nothing matches."""
    key = "i1" if side == "old" else "i2"
    return dump["declarations"].where(F.col("side") == side).join(dump["matches"].select(F.col(key).alias("id")), "id", "left_anti")


def summary(dump: dict[str, DataFrame]) -> DataFrame:
    return dump["changes"].groupBy("pair_id", "change").agg(F.count(F.lit(1)).alias("n"))


def overview(dump: dict[str, DataFrame]) -> DataFrame:
    """Per pair: declarations of both sides, matches, similarity, and changes by kind."""
    d, m = dump["declarations"], dump["matches"]
    sides = d.groupBy("pair_id").agg(F.count_if(F.col("side") == "old").alias("total_old"), F.count_if(F.col("side") == "new").alias("total_new"))
    n = m.groupBy("pair_id").agg(F.count(F.lit(1)).alias("matched"))
    kinds = {"additions": "addition", "deletions": "deletion", "modifications": "modification"}
    c = dump["changes"].groupBy("pair_id").agg(*[F.count_if(F.col("change") == k).alias(name) for name, k in kinds.items()])
    rows = sides.join(n, "pair_id", "left").join(c, "pair_id", "left").fillna(0)
    return rows.withColumn("similarity", F.col("matched") / F.greatest("total_old", "total_new"))


def renames(dump: dict[str, DataFrame]) -> DataFrame:
    """(pair_id, old, new) of matched declarations whose names differ."""
    return dump["matches"].where("name_old != name_new").select("pair_id", F.col("name_old").alias("old"), F.col("name_new").alias("new"))


def first_lines(dump: dict[str, DataFrame], k: int) -> DataFrame:
    """The first k changes of each pair, for a short report."""
    return dump["changes"].withColumn("place", F.row_number().over(Window.partitionBy("pair_id").orderBy("change", "name"))).where(F.col("place") <= k)
