"""Tables that cut lineage: written to a folder that driver and executors share, and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

GROUP_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset: on one machine a temporary folder, else the warehouse."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] == "local":
            found = "file://" + tempfile.mkdtemp(prefix="cambium-checkpoint-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/cambium-scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows dealt by keys to two tasks a core, for work in Python whose share a few small files don't tell."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, sc = spark._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session is gone; the folder is the cluster's to clean
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there and outlives lost executors. The table goes
    when the program ends, or with free.

    Tables of arrays are in row groups of GROUP_ROWS, which bound what a reader holds. No join broadcasts the table by the
    size of its files: like rows take a hundredth of their memory there, and the driver would hold them all.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    write = df.write.option("compression", "zstd")
    if any(isinstance(f.dataType, T.ArrayType) for f in df.schema):
        write = write.option("parquet.block.row.count.limit", GROUP_ROWS)
    write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path).hint("merge")
    out._cut_path = path
    atexit.register(_forget, spark, path)
    return out


def free(*tables: DataFrame | None) -> None:
    """Deletes tables of cut that nothing reads any more."""
    for t in tables:
        if t is not None and getattr(t, "_cut_path", None):
            _delete(t.sparkSession, t._cut_path)
            t._cut_path = None
