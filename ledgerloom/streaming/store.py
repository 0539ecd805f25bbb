"""A keyed store of arrivals: a compacted base and the batches since, read as one table.

    path/base/upto=N     every key as of batch N, one row each
    path/log/batch=N     the keys of batch N, one row each

A row holds the columns of the first save of its key, those of the latest, and the marks of both. Folding rows of one
key takes the least and the greatest mark, so it does not matter in which order, how often or through which base a
save is folded. A batch costs what it holds; every ``every`` batches the log is folded into a new base.

Only folders that were written to the end (``_SUCCESS``) count. The base before the newest and the batches it lacks stay
until the next compaction, for readers that have begun with them, so a store holds two bases and at most twice
``every`` batches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerloom.operators.changes import KEPT


def _place(spark: SparkSession, path: str):
    """The folder and its file system, as Hadoop objects: any store that Spark writes to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the whole folders ``path/name=N``, in order."""
    root, files = _place(spark, path)
    if not files.exists(root):
        return []
    out = []
    for status in files.listStatus(root):
        child = status.getPath()
        whole = files.exists(_place(spark, f"{child.toString()}/_SUCCESS")[0])
        if whole and child.getName().startswith(f"{name}="):
            out.append(int(child.getName().partition("=")[2]))
    return sorted(out)


def _remove(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)


@dataclass(frozen=True)
class Store:
    """Where a store lies and how its rows are saved.

    ``schema`` is that of the arrivals; ``key`` names the row that a save replaces, ``order`` (a whole number) says which
    of two saves is later. Columns of ``kept`` stay as the first save left them, all others are as the latest left
    them. Saves of equal order are told apart by a hash of their columns; one without an order counts as the earliest.
    Rows without a key cannot be addressed and are left out. Map columns are not allowed.
    """

    path: str
    schema: StructType
    key: str = "invoice_id"
    order: str = "change_seq"
    kept: tuple[str, ...] = KEPT
    every: int = 16

    def _folded(self, rows: DataFrame) -> DataFrame:
        """One row a key, reduced before the shuffle."""
        return rows.groupBy(self.key).agg(
            F.min_by("first", "since").alias("first"), F.max_by("last", "until").alias("last"),
            F.min("since").alias("since"), F.max("until").alias("until"),
        )

    def _marked(self, rows: DataFrame) -> DataFrame:
        """Arrivals as rows of the store."""
        names = self.schema.names
        earliest = F.lit(-(1 << 63)).cast("long")
        mark = F.struct(
            F.coalesce(F.col(self.order).cast("long"), earliest).alias("n"), F.xxhash64(*names).alias("h")
        )
        first = F.struct(*[n for n in names if n in self._held()], F.lit(True).alias("_"))
        last = F.struct(*[n for n in names if n not in self._held() and n != self.key], F.lit(True).alias("_"))
        shaped = rows.select(
            self.key, first.alias("first"), last.alias("last"), mark.alias("since"), mark.alias("until")
        )
        return self._folded(shaped.where(F.col(self.key).isNotNull()))

    def _held(self) -> set[str]:
        return {n for n in self.kept if n != self.key}

    def _read(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        shape = self._marked(spark.createDataFrame([], self.schema)).schema
        return spark.read.schema(shape).parquet(*paths) if paths else spark.createDataFrame([], shape)

    def _parts(self, spark: SparkSession) -> tuple[int, list[str], int]:
        """Number of the newest base (-1: none), the folders that make up the store now, the newest batch in them."""
        bases = _numbers(spark, f"{self.path}/base", "upto")
        base = bases[-1] if bases else -1
        since = [n for n in _numbers(spark, f"{self.path}/log", "batch") if n > base]
        paths = [f"{self.path}/base/upto={base}"] if bases else []
        return base, paths + [f"{self.path}/log/batch={n}" for n in since], max([base, *since])

    def save(self, stream: DataFrame, state: str) -> StreamingQuery:
        """Saves each micro-batch; one that runs again replaces itself and changes nothing.

        ``state`` is the checkpoint that numbers the batches and belongs to the store for good.
        """

        def write(rows: DataFrame, batch: int) -> None:
            self.save_batch(rows, batch)

        return (
            stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
        )

    def save_batch(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        base = self._parts(spark)[0]
        if batch < base:
            raise ValueError(f"batch {batch} comes after the store was compacted up to {base}: the state is another's")
        if batch > base:  # else the base holds it
            self._marked(rows).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")
        if batch - base >= self.every:
            self.compact(spark)

    def compact(self, spark: SparkSession) -> None:
        """Folds the log into a new base, then removes what the base before it had already replaced."""
        base, paths, newest = self._parts(spark)
        if newest == base:
            return
        self._folded(self._read(spark, paths)).write.mode("overwrite").parquet(f"{self.path}/base/upto={newest}")
        for n in _numbers(spark, f"{self.path}/base", "upto"):
            if n < base:
                _remove(spark, f"{self.path}/base/upto={n}")
        for n in _numbers(spark, f"{self.path}/log", "batch"):
            if n <= base:
                _remove(spark, f"{self.path}/log/batch={n}")

    def current(self, spark: SparkSession) -> DataFrame:
        """Every saved key once, with the columns of the arrivals; no rows if nothing was saved."""
        rows = self._folded(self._read(spark, self._parts(spark)[1]))
        side = {n: "first" if n in self._held() else "last" for n in self.schema.names if n != self.key}
        return rows.select(*[F.col(f"{side[n]}.`{n}`").alias(n) if n in side else F.col(n) for n in self.schema.names])


def first_rows(path: str, schema: StructType, key: str, order: str, every: int = 16) -> Store:
    """A store that keeps the whole first row of each key, however late the key comes back: no streaming state at all."""
    return Store(path, schema, key, order, tuple(schema.names), every)
