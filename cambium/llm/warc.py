"""Merkle fixity audit of WARC replicas.

A leaf of the tree is a record: its id, its number among the records of that id, offset range and digest. A node covers FAN
neighbours of the level below and hashes their offset ranges and digests in order: first the records of an id by number,
until each id is one node, then the ids; the last level has a root (two where there are negative ids). Replicas with equal
roots are equal. Else only children of differing nodes are compared, level by level, down to the records that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.llm.common import Scratch, ranked

#: Children of a node, and records of a WARC file.
FAN, PER_FILE = 16, 1024


def record(url: Column, payload: Column) -> Column:
    """A WARC response record."""
    payload = F.coalesce(payload.cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, payload, F.lit("\r\n\r\n"))


def archive(pages: DataFrame, id_column: str = "page_id", url: str = "url", payload: str = "html", per_file: int = PER_FILE) -> DataFrame:
    """Records (id, nth, file, at, size, digest) of pages in id order: file is id div per_file, at the offset in its file.

    nth counts the rows of one id from 0, by digest and size. Any 64-bit id will do; ids and files may hold any share of all
    rows. Null urls and payloads are empty; rows without an id have no record. An empty table gives an empty archive.
    """
    scratch = Scratch(pages.sparkSession, "archive")
    rows = pages.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), record(F.col(url), F.col(payload)).alias("record"))
    rows = rows.select("id", F.octet_length("record").cast("long").alias("size"), F.sha2(F.col("record").cast("binary"), 256).alias("digest"))
    rows = scratch.table(rows.withColumn("file", F.floor(F.col("id") / F.lit(per_file)) if per_file & (per_file - 1) else F.shiftright("id", per_file.bit_length() - 1)), "records")
    dealt = ranked(scratch, rows, ["file", "id"], ["digest", "size"], "dealt", "nth", total=("size", "at", ["file"]))
    return dealt.select("id", "nth", "file", "at", "size", "digest")


def _leaves(records: DataFrame) -> DataFrame:
    leaf = F.sha2(F.concat_ws(":", F.lit("leaf"), "id", "nth", "file", "at", "size", "digest"), 256)
    return records.select("id", "nth", F.col("at").alias("lo"), (F.col("at") + F.col("size")).alias("hi"), leaf.alias("hash"))


def _up(level: int, nth_levels: int) -> list[Column]:
    """The node above a node of a level."""
    bits = FAN.bit_length() - 1
    return [F.col("id"), F.shiftright("nth", bits)] if level < nth_levels else [F.shiftright("id", bits), F.lit(0).cast("long")]


def heights(*archives: DataFrame) -> tuple[int, int]:
    """Levels over the numbers of records of an id, and levels over ids, that bring all archives to their roots."""
    ends = [a.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("nth").alias("nth")).first() for a in archives]
    ends = [e for e in ends if e.lo is not None]
    if not ends:
        return 0, 0
    lo, hi, nth, bits = min(e.lo for e in ends), max(e.hi for e in ends), max(e.nth for e in ends), FAN.bit_length() - 1
    a = b = 0
    while nth:
        nth, a = nth >> bits, a + 1
    while not (lo >= -1 and hi <= 0):
        lo, hi, b = lo >> bits, hi >> bits, b + 1
    return a, b


def tree(scratch: Scratch, records: DataFrame, name: str, height: tuple[int, int]) -> list[DataFrame]:
    """Levels (id, nth, lo, hi, hash) from the leaves up to the root."""
    levels = [scratch.table(_leaves(records), f"{name}-0")]
    for level in range(sum(height)):
        up = [c.alias(n) for c, n in zip(_up(level, height[0]), ("up_id", "up_nth"), strict=True)]
        children = F.sort_array(F.collect_list(F.struct("id", "nth", "lo", "hi", "hash")))  # FAN at most
        above = levels[-1].select("*", *up).groupBy("up_id", "up_nth").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), children.alias("children"))
        text = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["id"], c["nth"], c["lo"], c["hi"], c["hash"])), "|")
        levels.append(scratch.table(above.select(F.col("up_id").alias("id"), F.col("up_nth").alias("nth"), "lo", "hi", F.sha2(text, 256).alias("hash")), f"{name}-{level + 1}"))
    return levels


def audit(spark: SparkSession, left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, nth, status) of the records of two archives that differ: damaged (same offset, other bytes), moved (same bytes at
    another offset), changed (both), missing (only in left) or extra (only in right). Equal replicas give no rows; an empty
    replica lacks every record."""
    scratch = Scratch(spark, "fixity")
    left, right = scratch.table(left, "left"), scratch.table(right, "right")
    height = heights(left, right)
    a, b = tree(scratch, left, "a", height), tree(scratch, right, "b", height)
    open_: DataFrame | None = None
    for level in range(sum(height), -1, -1):
        x, y = a[level], b[level]
        if open_ is not None:
            up = [c.alias(n) for c, n in zip(_up(level, height[0]), ("up_id", "up_nth"), strict=True)]
            inside = open_.select(F.col("id").alias("up_id"), F.col("nth").alias("up_nth")).hint("merge")  # of a damaged replica they may be many
            x, y = (t.select("*", *up).join(inside, ["up_id", "up_nth"], "left_semi").drop("up_id", "up_nth") for t in (x, y))
        both = x.select("id", "nth", F.col("hash").alias("x")).join(y.select("id", "nth", F.col("hash").alias("y")), ["id", "nth"], "full_outer")
        open_ = scratch.table(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("id", "nth"), f"open-{level}")
    key = ["id", "nth"]
    l, r = (t.join(open_.hint("merge"), key, "left_semi").select(*key, F.struct("file", "at").alias(f"{n}_at"), F.struct("size", "digest").alias(f"{n}_is")) for t, n in ((left, "l"), (right, "r")))
    both = l.join(r, key, "full_outer")
    status = (
        F.when(F.col("r_is").isNull(), "missing").when(F.col("l_is").isNull(), "extra")
        .when(F.col("l_at") == F.col("r_at"), "damaged").when(F.col("l_is") == F.col("r_is"), "moved").otherwise("changed")
    )
    return both.select(*key, status.alias("status"))
