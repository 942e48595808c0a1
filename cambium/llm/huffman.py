"""Token files: canonical, length-limited Huffman coding of ids from counts over the whole corpus.

Format. A corpus is a folder of two Parquet tables, so that any store Spark writes to can hold it. `codebook`: one row an
id, (id, length), from which the canonical codes follow. `blocks`: a folder for each part (part=0, 1, ...,
ascending with the documents), in it rows in ascending order of `first_start`, each an independent block of whole documents: `payload` (the bit stream, most significant bit first), `n_ids`, `checkpoints` (bit
offsets of every EVERY-th id), and of its documents `doc_ids`, `starts` (ids of all documents before), `sizes`. A reader
can begin at any block, and in it at any checkpoint.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.llm import tokens
from cambium.llm.common import Scratch, text_slices

#: Ids after which a block is closed, ids between checkpoints, and the greatest code length if the vocabulary allows it.
BLOCK, EVERY, LONGEST = 1 << 16, 256, 20
#: Word pieces that a worker remembers while it writes a corpus.
MEMORY = 1_000_000
BLOCKS = "first_start long, n_ids long, payload binary, checkpoints array<long>, doc_ids array<long>, starts array<long>, sizes array<long>"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths (at most longest) of an optimal prefix code for counts > 0: package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.uint8)
    if n > 1 << longest:
        raise ValueError(f"{n} symbols do not fit codes of {longest} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    packages, levels = np.zeros(0), []
    for _ in range(longest):
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        both = both[rank]
        both = both[: len(both) // 2 * 2]
        packages = both[0::2] + both[1::2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        k = int(np.count_nonzero(is_leaf[:take]))
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, np.uint8)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes: shorter first, ids ascending within a length."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, lengths = ids[order].astype(np.uint32), lengths[order].astype(np.int64)
        self.longest = int(lengths[-1]) if len(lengths) else 1
        room = (1 << (self.longest - lengths)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(room)])
        self.sizes = lengths
        self.first = first[:-1]  # code, left-aligned to longest bits
        top = int(self.ids.max()) + 1 if len(ids) else 0
        self.code, self.length = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code[self.ids] = (self.first >> (self.longest - lengths)).astype(np.uint64)
        self.length[self.ids] = lengths
        self.room = room

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(payload, bit offset of every EVERY-th id)."""
        size = self.length[ids]
        end = np.cumsum(size)
        at = end - size
        total = int(end[-1]) if len(ids) else 0
        if not total:
            return b"", at
        # Codes that begin in a word of 32 bits share no bit, so their sum in a window of 64 is all of them.
        window = self.code[ids] << (64 - size - (at & 31)).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        window, word = np.add.reduceat(window, first), word[first]
        out = np.zeros(int(word[-1]) + 2, np.uint64)
        out[word] = window >> np.uint64(32)
        out[word + 1] += window & np.uint64(0xFFFFFFFF)
        return out.astype(">u4").tobytes()[: (total + 7) // 8], at[::EVERY]

    def table(self) -> np.ndarray:
        """For each possible next `longest` bits the id times 64 plus its code's length."""
        kind = np.uint32 if len(self.code) < 1 << 26 else np.uint64
        found = np.ones(1 << self.longest, kind)
        found[: int(self.room.sum())] = np.repeat(self.ids.astype(kind) << kind(6) | self.sizes.astype(kind), self.room)
        return found


def decode(book: Codebook, table: np.ndarray, payloads: list[bytes], checkpoints: list[np.ndarray], n_ids: list[int]) -> list[np.ndarray]:
    """Ids of each block. All stretches between checkpoints advance together, one id a step."""
    joined = b"".join(p + b"\0" * 4 for p in payloads)
    b = np.frombuffer(joined, np.uint8).astype(np.uint32)
    window = np.zeros(len(b), np.uint32)
    window[:-3] = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    base = np.cumsum([0, *(len(p) + 4 for p in payloads)])[:-1]
    bit = np.concatenate([c.astype(np.int64) + 8 * s for c, s in zip(checkpoints, base, strict=True)])
    left = np.concatenate([np.minimum(EVERY, n - EVERY * np.arange(len(c))) for c, n in zip(checkpoints, n_ids, strict=True)])
    out = np.zeros((EVERY, len(bit)), table.dtype)
    shift = np.uint32(32 - book.longest)
    for step in range(EVERY):
        if step and not (live := left > step).all():
            bit = np.where(live, bit, 0)
        key = (window[bit >> 3] << (bit & 7).astype(np.uint32)) >> shift
        out[step] = table[key]
        bit = bit + (out[step] & 63).astype(np.int64)
    flat, found, at = (out >> 6).astype(np.uint32, copy=False).T, [], 0
    for c, n in zip(checkpoints, n_ids, strict=True):
        found.append(flat[at : at + len(c)].reshape(-1)[:n])
        at += len(c)
    return found


def write_corpus(spark: SparkSession, docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encodes every whole text (null: empty), ends each with end_id, and writes folder/codebook and folder/blocks.

    Documents stand in ascending id order (nulls first), rows that share an id by the hash of their texts; each row is a
    document of its own. No documents give an empty codebook and no blocks. Other columns don't matter. Rows are dealt by
    range, so that no task gets more than its share; a block holds whole documents, at least one.
    """
    path = path or tokens.default_path()
    scratch = Scratch(spark, "huffman")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, done = tokens.encoder(path, MEMORY), TaskContext.get().partitionId(), 0
        tail = np.array([end_id], np.uint32).tobytes()
        for batch in text_slices(batches):
            made = [x + tail for x in enc.ids(batch.column(1).to_pylist())]
            sizes = np.array([len(x) // 4 for x in made], np.int64)
            counts = np.bincount(np.frombuffer(b"".join(made), "<u4"))
            found = np.flatnonzero(counts)
            told = [np.concatenate([found, counts[found]]).astype("<i8").tobytes(), *[None] * (len(made) - 1)]
            before = done + np.cumsum(sizes) - sizes
            done += int(sizes.sum())
            yield pa.record_batch([batch.column(0), pa.array(sizes), pa.array(before), pa.array(np.full(len(made), part, np.int32)), pa.array([_narrow(x) for x in made], pa.binary()), pa.array(told, pa.binary())], names=["doc_id", "n", "before", "part", "ids", "counts"])

    # counts: ids, and how often each occurs, of a slice of documents, at the first of them.
    coded = scratch.table(dealt.mapInArrow(tokenised, "doc_id long, n long, before long, part int, ids binary, counts binary"), "ids")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                found, n = np.frombuffer(x, "<i8").reshape(2, -1)
                if len(found) and found[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(found[-1] + 1 - len(total), np.int64)])
                total[found] += n
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found), pa.array(total[found])], names=["id", "count"])

    # One row an id at most: the vocabulary bounds what the driver gets.
    counts = coded.select("counts").where("counts IS NOT NULL").mapInArrow(counted, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).toPandas().sort_values("id")
    ids, weight = counts["id"].to_numpy(np.int64), counts["count"].to_numpy(np.int64)
    longest = max(LONGEST, int(len(ids)).bit_length())
    lengths = code_lengths(weight, longest)
    spark.createDataFrame([(int(i), int(n)) for i, n in zip(ids, lengths, strict=True)], "id long, length int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/codebook")

    # Where each part begins: one number a part.
    sizes = coded.groupBy("part").agg(F.sum("n").alias("n")).toPandas().sort_values("part")
    begin = dict(zip(sizes["part"].tolist(), np.concatenate([[0], np.cumsum(sizes["n"].to_numpy(np.int64))]).tolist()[:-1], strict=True))
    shared = spark.sparkContext.broadcast((ids, lengths, begin))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, begin = shared.value
        book = Codebook(ids, lengths)
        hold: list[tuple[int | None, int, np.ndarray]] = []
        part, expected = None, None

        def closed() -> pa.RecordBatch:
            stream = np.concatenate([x for _, _, x in hold]).astype(np.int64)
            payload, marks = book.encode(stream)
            row = [[part], [hold[0][1]], [len(stream)], [payload], [marks], [[d for d, _, _ in hold]], [[s for _, s, _ in hold]], [[len(x) for _, _, x in hold]]]
            return pa.record_batch([pa.array(v, k) for v, k in zip(row, _KINDS, strict=True)], names=_NAMES)

        for batch in batches:
            for d, p, s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                start = begin[p] + s
                if hold and (p != part or start != expected or start - hold[0][1] >= BLOCK):
                    yield closed()
                    hold = []
                x = _wide(x)
                hold.append((d, start, x))
                part, expected = p, start + len(x)
        if hold:
            yield closed()

    # A part's blocks go to the folder of its number: parts ascend with the documents, blocks within one by first_start.
    made = coded.select("doc_id", "part", "before", "ids").mapInArrow(packed, f"part int, {BLOCKS}")
    made.sortWithinPartitions("part", "first_start").write.mode("overwrite").option("compression", "none").partitionBy("part").parquet(f"{folder}/blocks")
    if not begin:  # so that an empty corpus can be read
        spark.createDataFrame([], f"{BLOCKS}, part int").write.mode("overwrite").parquet(f"{folder}/blocks")
    scratch.close()


_NAMES = ["part", "first_start", "n_ids", "payload", "checkpoints", "doc_ids", "starts", "sizes"]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _narrow(x: bytes) -> bytes:
    """Ids in two bytes each where all fit, behind a byte that says so."""
    ids = np.frombuffer(x, "<u4")
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + x


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<u2" if x[0] == 2 else "<u4", offset=1)


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit, binary) of every document of a corpus."""
    book = spark.read.parquet(f"{folder}/codebook").orderBy("id").toPandas()
    shared = spark.sparkContext.broadcast((book["id"].to_numpy(np.int64), book["length"].to_numpy(np.int64)))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Codebook(*shared.value)
        table = made.table()
        for batch in batches:
            k = 0
            while k < batch.num_rows:
                j, total = k, 0
                while j < batch.num_rows and (j == k or total < 8 * BLOCK):
                    total += batch.column(1)[j].as_py()
                    j += 1
                part = batch.slice(k, j - k)
                k = j
                marks = [m.values.to_numpy() for m in part.column(3)]
                found = decode(made, table, part.column(2).to_pylist(), marks, part.column(1).to_pylist())
                doc, start, size, ids = [], [], [], []
                for x, d, s, n in zip(found, part.column(4).to_pylist(), part.column(5).to_pylist(), part.column(6).to_pylist(), strict=True):
                    edges = (4 * np.cumsum([0, *n])).tolist()
                    raw = x.astype("<u4", copy=False).tobytes()
                    doc += d
                    start += s
                    size += n
                    ids += [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return spark.read.parquet(f"{folder}/blocks").select("first_start", "n_ids", "payload", "checkpoints", "doc_ids", "starts", "sizes").mapInArrow(unpacked, "doc_id long, start long, n_tokens long, ids binary")
