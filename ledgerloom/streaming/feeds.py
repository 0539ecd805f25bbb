"""Arrivals as streams: keyed saving, running figures, unique keys, append-only audit.

The store is written as one folder per micro-batch and read as the latest row per key, so a batch costs what
it holds, not what the store holds, and a repeated batch replaces its own folder only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.ordered import latest

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def arrivals(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet", files: int = 100) -> DataFrame:
    """New files of a folder with a stated schema."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


def save(stream: DataFrame, path: str, state: str) -> StreamingQuery:
    """Saves each micro-batch under its number; a batch that runs again overwrites itself."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    )


def current(spark: SparkSession, path: str, schema: str, keys: list[str], order: str) -> DataFrame:
    """The latest row per key over all batches."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    return latest(rows, keys, order).drop("batch")


def running_totals(stream: DataFrame, path: str, state: str, key: str, value: str) -> StreamingQuery:
    """Counts and sums per key over everything seen, a new version after each arrival.

    A version is written whole under the number of its batch, so a failure leaves the versions before it.
    """
    totals = stream.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).alias("total"))

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/after_batch={batch}")

    return (
        totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )


def current_totals(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the running totals."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("after_batch").alias("after_batch"))
    return versions.join(F.broadcast(newest), "after_batch", "left_semi")


def first_of_key(stream: DataFrame, path: str, state: str, key: str, time: str, delay: str) -> StreamingQuery:
    """Appends the first arrival of each key; the state of a key is kept for the delay."""
    unique = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return (
        unique.writeStream.format("parquet").option("path", path).option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )


def append_audit(stream: DataFrame, path: str, state: str) -> StreamingQuery:
    """Appends audit rows as they come."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )
