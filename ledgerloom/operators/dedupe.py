"""Duplicate invoices in linear form: groups, links to the first of a group, flags and pair counts.

Every rule compares keys for equality, so a group of n equal rows stands for its n(n-1)/2 pairs. Pairs are
counted, never listed: each later member is linked to the first one. Groups of two and more are written before rows
meet them, so that the join has a plain table on either side and adaptive execution can split the rows of a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stored

EXACT = ["supplier_tax_id", "issue_date", "total_gross"]
ROW = ["file_id", "seq"]


def _present(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def exact_duplicates(invoices: DataFrame) -> DataFrame:
    """Links first_id -> invoice_id among invoices of equal supplier, issue date and gross."""
    rows = invoices.where(_present(EXACT + ["invoice_id"])).select(*EXACT, "invoice_id")
    groups = (
        rows.groupBy(*EXACT)
        .agg(F.count("*").alias("n"), F.min("invoice_id").alias("first_id"), F.max("invoice_id").alias("last_id"))
        .where(F.col("first_id") < F.col("last_id"))
        .drop("last_id")
    )
    linked = rows.join(stored(groups, "groups"), EXACT)
    return linked.where(F.col("invoice_id") > F.col("first_id")).select("first_id", "invoice_id", "n", *EXACT)


def exact_pair_count(invoices: DataFrame) -> DataFrame:
    """Number of pairs of different invoice ids with equal supplier, date and gross."""
    per_id = (
        invoices.where(_present(EXACT + ["invoice_id"]))
        .groupBy(*EXACT, "invoice_id")
        .agg(F.count("*").cast("decimal(38,0)").alias("n"))
    )
    per_key = per_id.groupBy(*EXACT).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    pairs = (F.col("s") * F.col("s") - F.col("q")) / 2
    return per_key.agg(
        F.sum(F.when(F.col("s") * F.col("s") > F.col("q"), 1).otherwise(0)).alias("groups"),
        F.sum(pairs).cast("long").alias("pairs"),
    )


def _keyed(invoices: DataFrame) -> DataFrame:
    """Each row once per rule, under the rule's key; rows without a full key drop out of that rule."""
    none = F.lit(None)
    by_id = F.struct(
        F.lit("id").alias("rule"), F.col("invoice_id").alias("key"),
        none.cast("date").alias("day"), none.cast("decimal(18,2)").alias("amount"),
    )
    by_amount = F.struct(
        F.lit("amount").alias("rule"), F.col("supplier_tax_id").alias("key"),
        F.col("issue_date").alias("day"), F.col("total_gross").alias("amount"),
    )
    rules = F.array(
        F.when(F.col("invoice_id").isNotNull(), by_id), F.when(_present(EXACT), by_amount)
    )
    return (
        invoices.select(*ROW, F.explode(rules).alias("k"))
        .where(F.col("k").isNotNull())
        .select(
            *ROW, "k.rule", "k.key",
            F.coalesce("k.day", F.lit("0001-01-01").cast("date")).alias("day"),
            F.coalesce("k.amount", F.lit(0).cast("decimal(18,2)")).alias("amount"),
        )
    )


KEY = ["file_id", "rule", "key", "day", "amount"]


def near_duplicates(invoices: DataFrame) -> DataFrame:
    """Links first_seq -> seq within a file: equal number, or equal supplier, date and amount.

    Amounts have two decimals, so a difference below 0.01 means equal.
    """
    rows = _keyed(invoices)
    groups = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).where("n > 1")
    linked = rows.join(stored(groups, "groups"), KEY).where(F.col("seq") > F.col("first_seq"))
    return linked.select("file_id", "first_seq", "seq").distinct()


def near_pair_count(invoices: DataFrame) -> DataFrame:
    """Pairs per file: both rules added, pairs that fit both counted once."""
    def pairs(keys: list[str], sign: int) -> DataFrame:
        sizes = invoices.where(_present(keys)).groupBy(*keys).agg(F.count("*").cast("decimal(38,0)").alias("n"))
        return sizes.groupBy("file_id").agg((F.sum(F.col("n") * (F.col("n") - 1) / 2) * sign).alias("p"))

    both = pairs(["file_id", "invoice_id"], 1)
    both = both.unionByName(pairs(["file_id", *EXACT], 1)).unionByName(pairs(["file_id", "invoice_id", *EXACT], -1))
    return both.groupBy("file_id").agg(F.sum("p").cast("long").alias("duplicate_pairs"))


def duplicate_rows(invoices: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """(file_id, seq) of every row that is an end of some pair; any amount tolerance.

    Amounts fall into buckets as wide as the tolerance: two rows of one bucket always pair, and a row can
    otherwise pair only with the largest amount of the bucket below or the smallest of the bucket above. Both rules
    share one pass: a row goes once to each rule's key, a rule by number being one bucket.
    """
    tol = F.lit(tolerance).cast("decimal(18,2)")
    bucket = F.floor(F.col("amount") / tol).cast("long")
    rows = _keyed(invoices).withColumn("bucket", bucket)
    key = ["file_id", "rule", "key", "day", "bucket"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("amount").alias("low"), F.max("amount").alias("high"))
    shifts = F.when(F.col("rule") == "id", F.array(F.lit(0))).otherwise(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    shifted = sizes.withColumn("shift", F.explode(shifts)).withColumn("bucket", F.col("bucket") + F.col("shift"))
    here, below, above = F.col("shift") == 0, F.col("shift") == 1, F.col("shift") == -1
    around = shifted.groupBy(*key).agg(
        F.max(F.when(here, F.col("n"))).alias("n"),
        F.max(F.when(here, F.col("low"))).alias("low"),
        F.max(F.when(here, F.col("high"))).alias("high"),
        F.max(F.when(below, F.col("high"))).alias("prev"),
        F.min(F.when(above, F.col("low"))).alias("next"),
    )
    near = around.where(
        F.col("n").isNotNull()
        & ((F.col("n") > 1) | (F.col("low") - F.col("prev") < tol) | (F.col("next") - F.col("high") < tol))
    ).drop("low", "high")
    hits = rows.join(stored(near, "groups"), key).where(
        (F.col("n") > 1) | (F.col("amount") - F.col("prev") < tol) | (F.col("next") - F.col("amount") < tol)
    )
    return hits.select(*ROW).distinct()


def mark_duplicates(invoices: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Adds ``is_duplicate``; texts and items stay out of the duplicate search."""
    flagged = duplicate_rows(invoices, tolerance).withColumn("is_duplicate", F.lit(True))
    return invoices.join(flagged, ROW, "left").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))
