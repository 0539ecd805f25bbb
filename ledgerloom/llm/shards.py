"""Sharding by proportional stratified interleaving, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _numbered(rows: DataFrame, strata: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with their number from 0 in each stratum by bucket and ``order``.

    Counts per stratum and bucket are made before the shuffle; a window sees one bucket of a stratum at a time.
    """
    before = Window.partitionBy(*strata).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*strata, bucket).agg(F.count("*").alias("_n"))
    starts = counts.withColumns(
        {"_start": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_size": F.sum("_n").over(Window.partitionBy(*strata))}
    ).drop("_n")
    local = F.row_number().over(Window.partitionBy(*strata, bucket).orderBy(*order)) - 1
    return rows.withColumn("_local", local).join(starts, [*strata, bucket]).withColumn(name, F.col("_start") + F.col("_local"))


def shard(docs: DataFrame, shards: int = 40, stratum: str = "source", seed: int = 7, target: int = 1 << 20) -> DataFrame:
    """Every document's doc_id, size, text_crc32, law, shard (from 0), slot (gapless from 0) and grown_shard (null).

    Rows are shuffled by a seeded hash and ranked within their stratum; rank r of n rows stands at the fraction
    (r + 1/2) / n; the order of all fractions interleaves the strata in proportion and is cut into ``shards`` runs
    whose row counts differ by one at most (law ``rows``), so every shard has the mixture of the whole to within
    a row or so per stratum. A stratum may hold any share of the rows: ranks and places are counted per bucket of
    the hash and of the fraction (about ``target`` rows each, at least 256) and shifted by the buckets before.

    Size is the UTF-8 bytes of the text plus 16. A null text has 16 bytes and checksum 0, a null stratum is one
    of its own, a null doc_id is a row like any other, rows that repeat are placed each, ties of the hash go by id
    and checksum. Other columns are not used; an empty table gives an empty result. Texts are not shuffled.
    """
    buckets = max(256, -(-docs.count() // target))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{stratum}`").cast("string")), F.lit("")).alias("_stratum"),
    )
    slim = slim.withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    high = F.shiftrightunsigned("_hash", 33).cast("double") / float(1 << 31)
    slim = slim.withColumn("_order", F.shiftrightunsigned("_hash", 33)).withColumn("_bucket", F.floor(high * buckets).cast("long"))
    order = ["_order", "_hash", "doc_id", "text_crc32", "size"]
    ranked = _numbered(slim, ["_stratum"], "_bucket", order, "_rank").drop("_bucket", "_start", "_local")
    ranked = ranked.withColumn("_share", (F.col("_rank") + 0.5) / F.col("_size")).drop("_size")
    placed = ranked.withColumn("_part", F.floor(F.col("_share") * buckets).cast("long")).withColumn("_all", F.lit(0))
    placed = _numbered(placed, ["_all"], "_part", ["_share", "_hash", "_stratum", "doc_id", "text_crc32", "size"], "_place")
    run = F.expr(f"_place * {shards} div _size")
    first = F.expr(f"(_shard * _size + {shards - 1}) div {shards}")
    return placed.withColumn("_shard", run).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"),
        (F.col("_place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
