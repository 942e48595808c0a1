"""Benchmark decontamination by winnowing.

Of every GUARANTEE - K + 1 consecutive K-grams of words a text keeps the one with the least hash (the last of equals). Two
texts that share GUARANTEE words in a row therefore keep a common fingerprint inside them. Fingerprints of documents are
joined with those of the benchmark, and each hit is extended over the windows that it stands for, by the hash of all their
words: a window of GUARANTEE words that some item has as well is a match, and matches that overlap are one span. Items with
fewer words are one window, which is found as a whole. Every step is one over arrays, whatever the words repeat.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.llm import words
from cambium.llm.common import Scratch, fresh, text_slices

GUARANTEE, K = 13, 5
#: Benchmark words (8 bytes each, about 24 with their windows) that one broadcast holds; items of equal words count once. A
#: larger benchmark is taken in blocks of about that size, one pass over the documents each. An item of more than
#: SEGMENT_WORDS is taken in segments that overlap by a window.
BLOCK_WORDS, SEGMENT_WORDS = 2_000_000, 100_000


def fingerprint_places(grams: np.ndarray, window: int) -> np.ndarray:
    """For each run of window grams the place of the least, the last of equals."""
    size = len(grams) - window + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    low, at = grams[:size].copy(), np.arange(size)
    for j in range(1, window):
        x = grams[j : j + size]
        better = x <= low
        np.copyto(low, x, where=better)
        at[better] = np.flatnonzero(better) + j
    return at


class Index:
    """Fingerprints and windows of a block of items: [(item ids, word hashes)]."""

    def __init__(self, items: list[tuple[list[str], np.ndarray]], guarantee: int = GUARANTEE, k: int = K):
        self.guarantee, self.k, self.window = guarantee, k, guarantee - k + 1
        self.names: list[frozenset[str]] = [frozenset(i) for i, _ in items]
        marks, found = [np.zeros(0, np.uint64)], {}
        for i, (_, x) in enumerate(items):
            size = min(len(x), guarantee)
            if size:
                found.setdefault(size, []).append((i, words.ngrams(x, size)))
            if size == guarantee:
                grams = words.ngrams(x, k)
                marks.append(grams[np.unique(fingerprint_places(grams, self.window))])
        self.keys = np.unique(np.concatenate(marks))
        self.windows = {size: self._table(rows) for size, rows in found.items()}

    def _table(self, rows: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted window hashes, and for each the number of the set of items that have it."""
        hashes = np.concatenate([x for _, x in rows])
        owner = np.repeat([i for i, _ in rows], [len(x) for _, x in rows])
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(hashes))
        sets = owner[starts].astype(np.int64)
        known: dict[bytes, int] = {}
        for j in np.flatnonzero(owner[starts] != owner[ends - 1]).tolist():
            own = np.unique(owner[starts[j] : ends[j]])
            mark = own.tobytes()
            if mark not in known:
                known[mark] = len(self.names)
                self.names.append(frozenset().union(*(self.names[i] for i in own.tolist())))
            sets[j] = known[mark]
        return hashes[starts], sets

    def matches(self, hashes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, first words, documents, item sets) of all windows that items have, for each size of windows; words count
        within the slice."""
        for size, (known, sets) in self.windows.items():
            grams = words.ngrams(hashes, size)
            at = np.arange(len(grams))
            row = np.searchsorted(offsets, at, side="right") - 1
            fine = at + size <= offsets[row + 1]  # within one document
            if size == self.guarantee:  # a window that an item has keeps a fingerprint that the item keeps
                short = words.ngrams(hashes, self.k)
                fine &= isin(short, self.keys)[fingerprint_places(short, self.window)]
            at = np.flatnonzero(fine)
            at = at[isin(grams[at], known)]
            if len(at):
                yield size, at, row[at], sets[np.searchsorted(known, grams[at])]


def isin(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """x in the sorted keys; a table of 16 bits answers most of it."""
    if not len(keys):
        return np.zeros(len(x), bool)
    maybe = np.zeros(1 << 16, bool)
    maybe[(keys >> np.uint64(48)).astype(np.int64)] = True
    out = maybe[(x >> np.uint64(48)).astype(np.int64)]
    at = np.flatnonzero(out)
    out[at] = keys[np.minimum(np.searchsorted(keys, x[at]), len(keys) - 1)] == x[at]
    return out


def spans_of(hit: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, end) of runs of hit words, which end with their document; words count within it."""
    first = np.zeros(len(hit) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], hit[:-1]]) & ~first[:-1]
    after = np.concatenate([hit[1:], [False]]) & ~first[1:]
    start, end = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return row, start - offsets[row], end - offsets[row]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(index, text: str, names: list[str], keep: list[str], before: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for batch in text_slices(batches, text, fill=False):  # a null text has no words, and is null in what is kept
            hashes, offsets = words.hash_words(batch.column(batch.schema.get_field_index(text)).fill_null(""), words.ALNUM)
            hit = np.zeros(len(hashes) + 1, np.int64)
            items: dict[int, set[str]] = defaultdict(set)
            if before:
                for d, (old, had) in enumerate(zip(batch.column(names[1]).to_pylist(), batch.column(names[2]).to_pylist(), strict=True)):
                    for x in old or ():
                        hit[x["start"] + int(offsets[d])] += 1
                        hit[x["end"] + int(offsets[d])] -= 1
                    items[d] |= set(had or ())
            for size, at, docs, sets in found.matches(hashes, offsets):
                np.add.at(hit, at, 1)
                np.add.at(hit, at + size, -1)
                for d, k in np.unique(np.stack([docs, sets], axis=1), axis=0).tolist():
                    items[d] |= found.names[k]
            spans: dict[int, list[dict[str, int]]] = defaultdict(list)
            for d, start, end in zip(*(x.tolist() for x in spans_of(np.cumsum(hit[:-1]) > 0, offsets)), strict=True):
                spans[d].append({"start": start, "end": end})
            rows = range(batch.num_rows)
            out = [batch.column(c) for c in keep]
            out.append(pa.array(np.diff(offsets)))
            out.append(pa.array([spans.get(d, []) for d in rows], _ARROW_SPANS))
            out.append(pa.array([sorted(items[d]) if d in items else [] for d in rows], pa.list_(pa.string())))
            yield pa.record_batch(out, names=[*keep, *names])

    return run


def _blocks(benchmark: DataFrame, item: str, text: str, guarantee: int, k: int) -> Iterator[Index]:
    """Indexes of at most about BLOCK_WORDS words each; the driver holds one at a time."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            hashes, offsets = words.hash_words(batch.column(1), words.ALNUM)
            ids, parts = [], []
            for i, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for at in range(a, max(a + 1, b - guarantee + 1), SEGMENT_WORDS):
                    ids.append(i)
                    parts.append(hashes[at : min(b, at + SEGMENT_WORDS + guarantee - 1)].view(np.int64).tolist())
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(parts, pa.list_(pa.int64()))], names=["item", "hashes"])

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    made = rows.mapInArrow(hashed, "item string, hashes array<long>").where(F.size("hashes") > 0).groupBy("hashes").agg(F.collect_set("item").alias("items"))
    total = made.agg(F.sum(F.size("hashes").cast("long"))).first()[0] or 0
    parts = -(-total // BLOCK_WORDS)
    for part in range(parts):
        block = made.where(F.pmod(F.xxhash64("hashes"), F.lit(parts)) == part) if parts > 1 else made
        yield Index([(r["items"], np.array(r["hashes"], dtype=np.int64).view(np.uint64)) for r in block.toLocalIterator()], guarantee, k)


def overlaps(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None, text: str = "text", item: str = "item_id", guarantee: int = GUARANTEE, k: int = K) -> tuple[DataFrame, list[str]]:
    """columns of docs (all by default) with n_words, spans and items, and the names under which those three stand.

    A-Z are lower-cased; words are runs of 0-9, a-z and characters beyond ASCII; null or empty texts have none. spans:
    merged word ranges [start, end) that lie in a window of guarantee words of an item, or in all of a shorter item.
    items: sorted ids, as strings, of items with such a window; a null id marks words and isn't listed; items without
    words match nothing. Rows that repeat are judged each. Columns of docs that are named n_words, spans or items stay,
    and the new names get an underscore. Without items all spans are empty; an empty docs gives an empty table.
    """
    keep = list(columns or docs.columns)
    names = fresh(docs, "n_words", "spans", "items")
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], SPANS), T.StructField(names[2], T.ArrayType(T.StringType()))])
    wide = T.StructType([*docs.schema.fields, *schema.fields[-3:]])
    scratch, out = None, docs
    pending = None
    for k_th, index in enumerate(_blocks(benchmark, item, "text", guarantee, k)):
        if pending is not None:  # another block follows: write with the texts, which it needs
            scratch = scratch or Scratch(spark, "winnow")
            out = scratch.table(out.mapInArrow(_scan(pending, text, names, docs.columns, k_th > 1), wide), f"block-{k_th}")
        pending = spark.sparkContext.broadcast(index)
    if pending is None:
        pending = spark.sparkContext.broadcast(Index([], guarantee, k))
    return out.mapInArrow(_scan(pending, text, names, keep, out is not docs), schema), names


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows: those of whose words a twentieth or more lies in shared windows."""
    out, (n_words, spans, _) = overlaps(spark, docs, benchmark)
    return out.where(~contaminated(n_words, spans)).select(*docs.columns)


def n_hit(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(n_words: str, spans: str):
    return (n_hit(spans) > 0) & (20 * n_hit(spans) >= F.col(n_words))
