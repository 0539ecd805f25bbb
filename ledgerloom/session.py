"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that a running session takes. Reading texts costs much time per byte, so partitions may be small
# as long as cores are idle; on large inputs the advisory size decides as usual.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A task's share must not grow with the tables, or sorts and lists spill: shuffles start with many parts, whatever the
    # session's own number, and are put together up to the advisory size; map tasks read little enough to hold it.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
    "spark.sql.files.maxPartitionBytes": "32m",
    # Lists are collected from rows that lie sorted by their key without a second sort.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
}
CONF = {
    **RUNTIME,
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; cluster settings given from outside win."""
    builder = SparkSession.builder.appName("ledgerloom")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder named by ``spark.checkpoint.dir``.

    The setting is read from the session. Only a local master without the setting gets a folder of
    its own; a cluster without it is an error, because executors do not share local disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"


def stored(rows: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows written to the shared folder and read back: a cut in the lineage that outlives executors.

    Texts take ``zstd``: they fill most of the folder and shrink to about half of what snappy leaves.
    """
    spark = rows.sparkSession
    path = work_dir(spark, name)
    rows.write.parquet(path, compression=compression)
    return spark.read.schema(rows.schema).parquet(path)
