"""Packing by cutting-stock column generation.

Documents longer than a sequence are cut into full sequences and a rest. The lengths of all pieces form a histogram with
as many classes as a sequence has quanta. A linear program over patterns (how many pieces of each class one sequence
holds) covers the histogram with the fewest sequences; patterns enter as columns, priced by a knapsack over the program's
dual values. Whole multiples of each pattern are dealt to the pieces by their rank within their class; what rounding
leaves, a few pieces for each pattern, is packed best fit decreasing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cambium.llm import tokens
from cambium.llm.common import Scratch, ranked, text_slices

#: Tokens of a sequence, and of a quantum: a class holds the lengths that need the same number of quanta.
CAPACITY, QUANTUM = 2048, 8


def price(dual: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best pattern for these duals: unbounded knapsack by dynamic programming over the room."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        fit = int(np.searchsorted(sizes, w, side="right"))
        if fit:
            value = best[w - sizes[:fit]] + dual[:fit]
            k = int(value.argmax())
            if value[k] > best[w] + 1e-12:
                best[w], pick[w] = value[k], k
    counts, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            counts[pick[w]] += 1
            w -= sizes[pick[w]]
    return float(best[room]), counts


def first_columns(sizes: np.ndarray, demand: np.ndarray, room: int) -> np.ndarray:
    """Patterns that first fit decreasing meets, each used while its pieces last: together they pack the whole demand."""
    left, out = demand.astype(np.int64).copy(), []
    while left.any():
        pattern, free = np.zeros(len(sizes), np.int64), room
        for c in np.flatnonzero(left)[::-1].tolist():
            pattern[c] = min(int(left[c]), free // int(sizes[c]))
            free -= int(pattern[c] * sizes[c])
        used = pattern > 0
        left -= pattern * int((left[used] // pattern[used]).min())
        out.append(pattern)
    return np.array(out)


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, most_columns: int = 3_000, gap: float = 2e-4) -> list[tuple[int, np.ndarray]]:
    """Patterns with whole multiples: [(times, pieces of each class)], none of them over demand.

    sizes ascend, in quanta; demand > 0. The program starts with the columns of first fit decreasing; priced columns enter
    until it is within gap (or half a sequence) of a lower bound (the total length, or Farley's bound), or most_columns
    have entered. Any basis packs all pieces, so the limits only cost padding. The program's values are rounded down, and
    cut where they cover more than asked.
    """
    m = len(sizes)
    pool = first_columns(sizes, demand, room)
    columns = np.diag(room // sizes).astype(float)  # a first basis: each class alone
    inverse = np.diag(1 / np.diag(columns))
    exact, demand = demand, demand * (1 + 1e-7 * np.arange(m))  # unlike amounts: no ties that make the simplex method stall
    amount = inverse @ demand
    bound = float(demand @ sizes) / room
    for k in range(most_columns):
        dual = inverse.sum(axis=0)
        gains = pool @ dual
        pattern = pool[int(gains.argmax())]
        if gains.max() <= 1 + 1e-7:
            if amount.sum() - bound <= max(0.5, gap * amount.sum()):
                break
            value, pattern = price(dual, sizes, room)
            bound = max(bound, amount.sum() / max(value, 1))
            if value <= 1 + 1e-7 or amount.sum() - bound <= max(0.5, gap * amount.sum()):
                break
        way = inverse @ pattern
        rows = np.flatnonzero(way > 1e-9)
        ratio = amount[rows] / way[rows]
        leave = int(rows[ratio.argmin()])
        step = max(0.0, float(ratio.min()))
        amount -= step * way
        amount[leave] = step
        columns[:, leave] = pattern
        pivot = inverse[leave] / way[leave]
        inverse -= np.outer(way, pivot)
        inverse[leave] = pivot
        if k % 500 == 499:
            inverse = np.linalg.inv(columns)
            amount = inverse @ demand
    left, out = exact.astype(np.int64).copy(), []
    for j in np.argsort(-amount, kind="stable").tolist():
        pattern = columns[:, j].astype(np.int64)
        used = pattern > 0
        times = min(int(amount[j] + 1e-3), int((left[used] // pattern[used]).min()))
        if times > 0:
            left -= times * pattern
            out.append((times, pattern))
    return out


def best_fit(sizes: np.ndarray, left: np.ndarray, room: int) -> list[np.ndarray]:
    """Sequences for the pieces that are left, largest first, each into the tightest gap."""
    bins: list[np.ndarray] = []
    gaps: list[tuple[int, int]] = []
    for c in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[c])):
            at = bisect_left(gaps, (int(sizes[c]), -1))
            if at < len(gaps):
                gap, b = gaps.pop(at)
            else:
                gap, b = room, len(bins)
                bins.append(np.zeros(len(sizes), np.int64))
            bins[b][c] += 1
            insort(gaps, (gap - int(sizes[c]), b))
    return bins


def plan(lengths: dict[int, int], capacity: int = CAPACITY, quantum: int = QUANTUM) -> list[tuple[int, int, int, int, int]]:
    """Runs (class, first rank, end rank, first sequence, pieces a sequence) for a histogram {class: pieces}."""
    room = capacity // quantum
    sizes = np.array(sorted(lengths), np.int64)
    if not len(sizes):
        return []
    demand = np.array([lengths[c] for c in sizes.tolist()], np.int64)
    patterns = solve(sizes, demand.astype(float), room)
    left = demand - sum((n * p for n, p in patterns), np.zeros(len(sizes), np.int64))
    patterns += [(1, p) for p in best_fit(sizes, left, room)]
    runs, done, sequence = [], np.zeros(len(sizes), np.int64), 0
    for times, pattern in patterns:
        for c in np.flatnonzero(pattern).tolist():
            n = int(pattern[c])
            runs.append((int(sizes[c]), int(done[c]), int(done[c]) + times * n, sequence, n))
            done[c] += times * n
        sequence += times
    return runs


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Pieces of every document: doc_id, copy, start, length, ids_crc32, doc_tokens. copy tells rows apart that share an id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = tokens.encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in text_slices(batches):
            rows = []
            ids = batch.column(0).to_pylist()
            for d, x in zip(ids, enc.ids(batch.column(1).to_pylist()), strict=True):
                x += tail
                n = len(x) // 4
                mark = zlib.crc32(x)
                for a in range(0, n, capacity):
                    part = x[4 * a : 4 * (a + capacity)]
                    rows.append((d, mark, a, len(part) // 4, zlib.crc32(part), n))
            kinds = [pa.int64()] * 6
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.mapInArrow(cut, "doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, quantum: int = QUANTUM, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text (null: empty) and an end id, so each has a piece. Pieces of a document
    are full sequences from its start on and one rest; they keep their order. sequence_id runs from 0 without gaps, offset
    within a sequence too. Pieces of equal class are ranked by length (longest first), doc_id (nulls first), content and
    start. Rows that repeat are packed each. Other columns don't matter; no documents give an empty table.
    """
    if capacity % quantum:
        raise ValueError("capacity must be a multiple of quantum")
    path = path or tokens.default_path()
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    pieces = token_pieces(rows, path, capacity).withColumn("size", F.ceil(F.col("length") / quantum).cast("int"))
    pieces = scratch.table(pieces, "cut")  # dealing by range reads its input twice, and tokenising is the dear part
    placed = ranked(scratch, pieces.withColumn("short", -F.col("length")), ["size"], ["short", "doc_id", "copy", "start"], "pieces")
    counts = {r["size"]: r["count"] for r in spark.read.parquet(scratch.path("pieces")).groupBy("size").count().collect()}  # at most room rows
    runs = plan(counts, capacity, quantum)  # at most (room patterns + leftovers) * room rows
    table = spark.createDataFrame(runs or [(0, 0, 0, 0, 1)], "size int, lo long, hi long, first long, each long")
    on = (placed["size"] == table["size"]) & (placed["rank"] >= table["lo"]) & (placed["rank"] < table["hi"])
    dealt = placed.join(F.broadcast(table), on).withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each")).cast("long"))
    order = Window.partitionBy("sequence_id").orderBy("short", "doc_id", "copy", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("offset")
    return dealt.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)
