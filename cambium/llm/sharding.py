"""Sharding by best fit decreasing.

Equal texts are one indivisible group. Groups enter shards in descending size, each the shard with the least room that
still takes it; the shards' rooms stand in a balanced tree. The fixed capacity is the least for which the groups fit the
shards, found by bisection. Groups are taken in classes, not one by one: sizes below a class width apart count as the
larger of them, and all groups of a class that enter one shard in a row enter it together. So the driver's work depends
on the number of classes (bounded) and shards, not on the number of groups. Groups of a class are then dealt by rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.llm.common import Scratch, ranked

SHARDS = 8
#: Relative width of a size class is 1 / FINE; there are FINE classes for each doubling, 64 * FINE at most.
FINE = 1024


class Rooms:
    """Shards by (room, shard) in a treap: a balanced tree whose priorities follow from the shard's number."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _priority(shard: int) -> int:
        return (shard + 1) * 0x9E3779B97F4A7C15 % (1 << 64)

    def _split(self, node, key):
        """Nodes under key, nodes from key on. A node: [key, priority, left, right]."""
        if node is None:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            node[3] = a
            return node, b
        a, b = self._split(node[2], key)
        node[2] = b
        return a, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, room: int, shard: int) -> None:
        a, b = self._split(self.root, (room, shard))
        self.root = self._merge(self._merge(a, [(room, shard), self._priority(shard), None, None]), b)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the least (room, shard) with room >= size."""
        a, b = self._split(self.root, (size, -1))
        if b is None:
            self.root = a
            return None
        node = b
        while node[2] is not None:
            node = node[2]
        least = node[0]
        _, rest = self._split(b, (least[0], least[1] + 1))
        self.root = self._merge(a, rest)
        return least


def fit(classes: list[tuple[int, int]], capacity: int, most: int) -> list[list[tuple[int, int]]] | None:
    """Runs for each class [(shard, groups)], or None if more than most shards of capacity would be needed. classes:
    (size, groups), descending in size."""
    rooms, opened, out = Rooms(), 0, []
    for size, groups in classes:
        runs = []
        while groups:
            if (found := rooms.take(size)) is None:
                if opened == most or size > capacity:
                    return None
                found, opened = (capacity, opened), opened + 1
            room, shard = found
            n = min(groups, room // size)  # it stays the tightest that takes this size while it takes it
            runs.append((shard, n))
            groups -= n
            rooms.add(room - n * size, shard)
        out.append(runs)
    return out


def assign(classes: list[tuple[int, int]], shards: int = SHARDS) -> list[list[tuple[int, int]]]:
    """Runs of the least capacity for which best fit decreasing needs at most `shards` shards. A group that is larger than
    an even share of what is left has the last free shard to itself, so that the others can still be even."""
    left, alone = sum(s * n for s, n in classes), [0] * len(classes)
    free, k = shards, 0
    while free > 1 and k < len(classes):
        if alone[k] == classes[k][1]:
            k += 1
        elif classes[k][0] * free > left:
            alone[k], free, left = alone[k] + 1, free - 1, left - classes[k][0]
        else:
            break
    rest = [(s, n - a) for (s, n), a in zip(classes, alone, strict=True)]
    low = max(-(-left // free), max((s for s, n in rest if n), default=1)) - 1
    high = low + 1
    while fit(rest, high, free) is None:
        high += max(1, high // 8)
    while high - low > max(1, left // free // 1_000_000):
        middle = (low + high) // 2
        low, high = (low, middle) if fit(rest, middle, free) is not None else (middle, high)
    last = shards
    runs = fit(rest, high, free)
    for k, n in enumerate(alone):
        for _ in range(n):
            last -= 1
            runs[k] = [(last, 1), *runs[k]]
    return runs


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 1. law is `bytes`: the shards' sizes are as near to equal as whole
    groups allow; a group larger than an even share has a shard of its own. Equal texts (null counts as empty) share a shard.
    slot: place within the shard by doc_id (nulls first), from 0 without gaps; rows that share an id by text hash.
    grown_shard is null under this law. Repeated rows are rows of one group. No rows give an empty table.
    """
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("key"))
    rows = scratch.table(rows, "rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    # Classes: the first bits of the size, one more than the truncated ones, so that a class never counts a group too small.
    shift = F.greatest(F.lit(0), F.length(F.bin("bytes")) - (FINE.bit_length()))
    groups = groups.withColumn("s", shift.cast("int")).withColumn("class", F.expr("shiftleft(shiftright(bytes - 1, s) + 1, s)")).drop("s", "bytes")
    dealt = ranked(scratch, groups, ["class"], ["key"], "groups")
    classes = sorted(((r["class"], r["count"]) for r in spark.read.parquet(scratch.path("groups")).groupBy("class").count().collect()), reverse=True)
    runs = []
    for (size, _), parts in zip(classes, assign(classes, shards), strict=True):
        done = 0
        for shard, n in parts:
            runs.append((size, done, done + n, shard))
            done += n
    table = F.broadcast(spark.createDataFrame(runs or [(0, 0, 0, 0)], "class long, lo long, hi long, shard int"))  # classes * shards rows at most
    on = (dealt["class"] == table["class"]) & (dealt["rank"] >= table["lo"]) & (dealt["rank"] < table["hi"])
    placed = scratch.table(rows.join(dealt.join(table, on).select("key", "shard"), "key").select("doc_id", "size", "text_crc32", "shard"), "placed")
    scratch.drop("rows", "groups")
    slots = ranked(scratch, placed, ["shard"], ["doc_id", "text_crc32"], "slots", "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
