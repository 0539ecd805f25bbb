"""Keyed changes on the invoice store as pure functions, with audit rows.

Each function returns a new version of the table; a caller writes it next to the old one and swaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.dims import PAID
from ledgerloom.functions.money import MONEY
from ledgerloom.operators.joins import cascade_delete
from ledgerloom.operators.ordered import latest, number_within

# Columns an update leaves as they are.
KEPT = ("file_path", "file_hash", "page_range", "raw_text", "processed_by", "notes", "created_at")


# The time of a change: a column of the change table, else the present; the store's column that takes it, if it has one.
AT, UPDATED = "changed_at", "updated_at"


def _stamped(rows: DataFrame, hit: Column) -> DataFrame:
    """Rows with the time of the change where it hit them; the time itself is taken out."""
    if UPDATED in rows.columns:
        rows = rows.withColumn(UPDATED, F.when(hit, F.col("_at")).otherwise(F.col(UPDATED)))
    return rows.drop("_at")


def _at(changes: DataFrame, prefix: str = "") -> Column:
    given = [F.col(f"{prefix}{AT}")] if AT in changes.columns else []
    return F.coalesce(*given, F.current_timestamp())


def upsert(base: DataFrame, changes: DataFrame, key: str = "invoice_id", order: str | None = "change_seq") -> DataFrame:
    """Base with changed rows replaced and new rows added; kept columns survive an update.

    The change table holds each key once after ``latest``. Rows without a key cannot be addressed and are
    passed through. A column ``updated_at`` of the base takes the time of the change.
    """
    new = latest(changes.where(F.col(key).isNotNull()), [key], order).drop(order) if order else changes
    marked_new = new.select(F.col(key), F.struct(*[c for c in new.columns if c != key]).alias("new"))
    old_fields = [c for c in base.columns if c != key]
    keyless = base.where(F.col(key).isNull())
    marked_old = base.where(F.col(key).isNotNull()).select(F.col(key), F.struct(*old_fields).alias("old"))
    joined = marked_old.join(marked_new, key, "full_outer")

    def merged(name: str) -> Column:
        if name == UPDATED:
            return F.when(F.col("new").isNotNull(), _at(new, "new.")).otherwise(F.col(f"old.{name}"))
        if name not in new.columns:
            return F.col(f"old.{name}")
        if name in KEPT:
            return F.when(F.col("old").isNotNull(), F.col(f"old.{name}")).otherwise(F.col(f"new.{name}"))
        return F.when(F.col("new").isNotNull(), F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))

    return joined.select(key, *[merged(n).alias(n) for n in old_fields]).unionByName(keyless.select(key, *old_fields))


def replace_items(items: DataFrame, new_items: DataFrame, changed: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Items of the changed keys are replaced; positions of the new ones count from 1."""
    fresh = number_within(new_items.withColumnRenamed("position", "given"), [key], ["given"]).drop("given")
    return cascade_delete(items, changed, key).unionByName(fresh.select(*items.columns))


def delete(base: DataFrame, deleted: DataFrame, key: str = "invoice_id") -> DataFrame:
    return cascade_delete(base, deleted, key)


def mark_paid(base: DataFrame, payments: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Sets the status and the amount; without an amount the gross counts as paid."""
    paid = payments.select(key, F.col("amount").alias("_amount"), F.lit(True).alias("_paid"), _at(payments).alias("_at"))
    hit = F.col("_paid").isNotNull()
    marked = (
        base.join(paid, key, "left")
        .withColumn("payment_status", F.when(hit, PAID).otherwise(F.col("payment_status")))
        .withColumn(
            "paid_amount",
            F.when(hit, F.coalesce("_amount", "total_gross")).otherwise(F.col("paid_amount")).cast(MONEY),
        )
    )
    return _stamped(marked, hit).drop("_amount", "_paid")


def verify(base: DataFrame, marks: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Sets ``is_verified`` from the marks, a table of key and verified."""
    given = marks.select(key, F.col("verified").alias("_verified"), F.lit(True).alias("_hit"), _at(marks).alias("_at"))
    marked = base.join(given, key, "left").withColumn("is_verified", F.coalesce("_verified", "is_verified"))
    return _stamped(marked, F.col("_hit").isNotNull()).drop("_verified", "_hit")


def audit(feed: DataFrame) -> DataFrame:
    """Audit rows of a change feed: key, action, user, JSON of what changed, time.

    Only payments and marks carry changes; NULL amounts are left out of the JSON.
    """
    detail = F.when(F.col("action") == "PAYMENT", F.to_json(F.struct("amount"))).when(
        F.col("action") == "VERIFY", F.to_json(F.struct(F.lit(True).alias("verified")))
    )
    return feed.select(
        "seq", "invoice_id", "action", F.lit("SYSTEM").alias("user"), detail.alias("changes"), F.col("ts").alias("timestamp")
    )


def error_records(parsed: DataFrame) -> DataFrame:
    """A text without any key field becomes an error record instead of a half-empty invoice."""
    fields = ["invoice_id", "supplier_tax_id", "buyer_tax_id", "supplier_name", "buyer_name"]
    failed = F.col("total_gross").isNull() | (F.col("total_gross") == 0)
    for name in fields:
        failed = failed & F.col(name).isNull()
    return (
        parsed.withColumn("failed", failed)
        .withColumn(
            "invoice_id",
            F.when(F.col("failed"), F.concat(F.lit("ERROR_"), F.col("start_page"))).otherwise(F.col("invoice_id")),
        )
        .withColumn("invoice_type", F.when(F.col("failed"), "BŁĄD").otherwise(F.col("invoice_type")))
        .withColumn("raw_text", F.when(F.col("failed"), F.substring("raw_text", 1, 500)).otherwise(F.col("raw_text")))
    )
