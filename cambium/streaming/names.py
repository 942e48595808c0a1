"""Reviewed names from a stream of requests. The log is a folder with one part for each micro-batch."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cambium.operators import names
from cambium.operators.scratch import cut, free


def read_log(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """Events of the log, those of micro-batches before `before`."""
    log = spark.read.schema(f"{names.EVENT}, batch long").parquet(folder)
    return (log if before is None else log.where(F.col("batch") < before)).drop("batch")


def fold(spark: SparkSession, requests: DataFrame, folder: str, batch: int) -> None:
    """Applies a batch of requests (doc_id, symbol_id, new_state, new_name, origin, actor, at) in the order of at.

    A batch that runs again replaces its own part, so each request counts once. Requests for one symbol follow each other.
    """
    nth = F.row_number().over(Window.partitionBy("doc_id", "symbol_id").orderBy("at", "new_state", "new_name"))
    requests = cut(requests.withColumn("nth", nth), "requests")
    events, made = read_log(spark, folder, batch), []
    for k in range(1, (requests.agg(F.max("nth")).first()[0] or 0) + 1):
        new = cut(names.apply_requests(events, requests.where(F.col("nth") == k).drop("nth", "at")), "added")
        events = events.unionByName(new)
        made.append(new)
    if made:
        functools.reduce(DataFrame.unionByName, made).write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    free(requests, *made)


def start(spark: SparkSession, requests: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the log at folder up to date with a stream of requests."""
    if not requests.isStreaming:
        raise ValueError("requests must be a stream")
    spark.createDataFrame([], names.EVENT).withColumn("batch", F.lit(-1).cast("long")).write.mode("ignore").partitionBy("batch").parquet(folder)
    return requests.writeStream.foreachBatch(lambda df, k: fold(df.sparkSession, df, folder, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
