"""Shared folder, tables that cut lineage, ranks without one big window, and Arrow slices."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.operators.scratch import shared_folder

#: Rows, and bytes, that Spark sends a Python worker at a time: a batch of whole texts is in memory on both sides. A row of
#: more bytes is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Bytes of text that a Python worker turns into arrays at a time.
SLICE_BYTES = 1 << 21


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends workers BATCH_ROWS rows and BATCH_BYTES at a time, or as many as it did if that is less."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))


class Scratch:
    """Parquet tables in the shared folder. A lost executor re-reads them instead of replaying their lineage."""

    def __init__(self, spark: SparkSession, label: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _delete(self, path: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def release(self) -> None:
        """Lets Spark delete shuffle files that no living table needs: it does so when the driver collects its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session is gone; the folder is the cluster's to clean
            pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, one for each of names."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ranked(scratch: Scratch, df: DataFrame, keys: list[str], order: list[str], name: str, rank: str = "rank", deal: list[str] | None = None, total: tuple[str, str, list[str]] | None = None) -> DataFrame:
    """df with rank, the 0-based place of a row within its keys by order.

    Rows are dealt by range over keys and order (or over `deal`, the first of them), so a key that holds a third of all rows
    spreads over many tasks. Each task numbers its own run of a key; the number of rows of that key in earlier tasks, one
    row for each (task, key), is added. total: (column, as, by) adds the sum of a column over all rows before within `by`,
    the first of keys. The dealt rows are written first: both steps see the same partitions. Dealing by range reads df
    twice; df should be cheap to read.
    """
    part, at, base, sum_at, sum_base = fresh(df.withColumns({n: F.lit(0) for n in (rank, *(total or ())[1:2])}), "part", "nth", "base", "sum_at", "sum_base")
    dealt = df.repartitionByRange(*[F.col(c) for c in deal or [*keys, *order]]).withColumn(part, F.spark_partition_id())
    dealt = scratch.table(dealt, name)
    before = lambda by: Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(at))
    sizes = sizes.withColumn(base, F.coalesce(F.sum(at).over(before(keys)), F.lit(0))).drop(at)
    within = dealt.withColumn(at, F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order)) - 1)
    if total:
        column, name_as, by = total
        own = Window.partitionBy(*by, part).orderBy(*[k for k in keys if k not in by], at).rowsBetween(Window.unboundedPreceding, -1)
        within = within.withColumn(sum_at, F.coalesce(F.sum(column).over(own), F.lit(0)))
        sums = dealt.groupBy(*by, part).agg(F.sum(column).alias(sum_base))
        sums = sums.withColumn(sum_base, F.coalesce(F.sum(sum_base).over(before(by)), F.lit(0)))
        within = within.join(sums, [*by, part]).withColumn(name_as, (F.col(sum_at) + F.col(sum_base)).cast("long")).drop(sum_at, sum_base)
    joined = within.join(sizes, [*keys, part])
    return joined.withColumn(rank, (F.col(base) + F.col(at)).cast("long")).drop(part, at, base)


def trim() -> None:
    """Gives memory that a worker has freed back to the system; the worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another libc
            ctypes.CDLL(None).malloc_trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, fill: bool = True) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about limit bytes of text each; a longer text is a slice of its own. Nulls become empty, or
    stay without fill."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        texts = batch.column(i)
        if fill and texts.null_count:
            texts = texts.fill_null("")
            batch = batch.set_column(i, column, texts)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) if len(texts) else []
        start = total = 0
        for k, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)
    trim()


def text_udf(make: Callable[[list[str]], pa.Array], returns: str):
    """A column function of one text column (null: empty). make turns some texts into as many values.

    Workers get the texts alone and send the values back; the other columns stay in the JVM. It counts as nondeterministic,
    so that no optimizer rule evaluates it a second time.
    """

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            made = [make(x.column(0).to_pylist()) for x in text_slices(iter([pa.record_batch([texts], names=["text"])]))]
            yield pa.concat_arrays(made) if made else make([])
        trim()

    return run.asNondeterministic()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str | Column = "text") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


LONG, STRING, BINARY = T.LongType(), T.StringType(), T.BinaryType()
