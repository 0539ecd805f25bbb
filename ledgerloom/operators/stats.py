"""Statistics over invoices and items; every result is small or grouped by a small key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.dims import DEFAULT_RATE, INVOICE_TYPES
from ledgerloom.functions.dates import month_key
from ledgerloom.functions.money import MONEY, vat_of

OTHERS = "Pozostali"
BUCKETS = 1 << 20


def _flag(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def general(invoices: DataFrame) -> DataFrame:
    """Counts, sums, mean, extremes, distinct parties, verified and duplicate counts."""
    return invoices.agg(
        F.count("*").alias("total_count"),
        F.sum("total_net").alias("total_net"),
        F.sum("total_vat").alias("total_vat"),
        F.sum("total_gross").alias("total_gross"),
        F.avg("total_gross").alias("avg_gross"),
        F.min("total_gross").alias("min_gross"),
        F.max("total_gross").alias("max_gross"),
        F.countDistinct("supplier_tax_id").alias("unique_suppliers"),
        F.countDistinct("buyer_tax_id").alias("unique_buyers"),
        _flag(F.col("is_verified")).alias("verified_count"),
        _flag(F.col("is_duplicate")).alias("duplicate_count"),
    )


def top_suppliers(invoices: DataFrame, n: int = 10) -> DataFrame:
    """Suppliers by tax id with the largest gross; the name shown is the greatest one."""
    return (
        invoices.groupBy("supplier_tax_id")
        .agg(
            F.max("supplier_name").alias("supplier_name"),
            F.count("*").alias("invoice_count"),
            F.sum("total_gross").alias("total_amount"),
        )
        .orderBy(F.col("total_amount").desc(), F.col("supplier_tax_id").asc_nulls_first())
        .limit(n)
    )


def monthly(invoices: DataFrame) -> DataFrame:
    """Count and gross per month."""
    return invoices.groupBy(month_key(F.col("issue_date")).alias("month")).agg(
        F.count("*").alias("invoice_count"), F.sum("total_gross").alias("total_amount")
    )


def last_months(invoices: DataFrame, n: int = 12) -> DataFrame:
    return monthly(invoices).orderBy(F.col("month").desc()).limit(n)


def exact_median(rows: DataFrame, column: str):
    """Exact median of a two-decimal column, or None without values.

    Counts per amount bucket narrow the range until a bucket is one cent wide. Each round is one scan of one
    column with at most 2**20 counters; a decimal(18,2) needs three rounds at most. Only single numbers
    come back to the driver.
    """
    cents = rows.where(F.col(column).isNotNull()).select((F.col(column) * 100).cast("long").alias("c"))
    low, high, n = cents.agg(F.min("c"), F.max("c"), F.count("*")).first()
    if not n:
        return None
    rank, upper_rank, seen = (n + 1) // 2, n // 2 + 1, 0
    while True:
        width = -(-(high - low + 1) // BUCKETS)
        counts = (
            cents.where(F.col("c").between(low, high))
            .groupBy(F.expr(f"(c - {low}L) div {width}L").alias("b"))
            .agg(F.count("*").alias("m"))
            .withColumn("upto", F.sum("m").over(Window.orderBy("b")) + F.lit(seen))
        )
        hit = counts.where(F.col("upto") >= rank).orderBy("b").first()
        seen = hit.upto - hit.m
        low, high = low + hit.b * width, min(high, low + (hit.b + 1) * width - 1)
        if width == 1:
            break
    value = low
    upper = value if hit.upto >= upper_rank else cents.where(F.col("c") > value).agg(F.min("c")).first()[0]
    from decimal import Decimal

    return Decimal(value + upper) / 200


def report(invoices: DataFrame) -> DataFrame:
    """Report statistics: one row, with the exact median and parties counted by name."""
    median = exact_median(invoices, "total_gross")
    has_errors, has_warnings = F.size("errors") > 0, F.size("warnings") > 0
    return invoices.agg(
        F.count("*").alias("total_count"),
        F.sum("total_net").alias("total_net"),
        F.sum("total_vat").alias("total_vat"),
        F.sum("total_gross").alias("total_gross"),
        F.avg("total_gross").alias("avg_invoice_value"),
        F.lit(median).cast("decimal(20,3)").alias("median_invoice_value"),
        F.max("total_gross").alias("max_invoice_value"),
        F.min("total_gross").alias("min_invoice_value"),
        F.countDistinct("supplier_name").alias("unique_suppliers"),
        F.countDistinct("buyer_name").alias("unique_buyers"),
        _flag(F.col("is_verified")).alias("valid_invoices"),
        _flag(has_errors).alias("error_invoices"),
        _flag(has_warnings & ~has_errors).alias("warning_invoices"),
    )


def top_names(invoices: DataFrame, n: int = 20) -> DataFrame:
    """Suppliers by name with the largest gross."""
    return (
        invoices.groupBy("supplier_name")
        .agg(F.count("*").alias("invoice_count"), F.sum("total_gross").alias("total_amount"))
        .orderBy(F.col("total_amount").desc(), F.col("supplier_name").asc_nulls_first())
        .limit(n)
    )


def pie(invoices: DataFrame) -> DataFrame:
    """The five largest suppliers and the rest of the twenty largest, left out when it is not positive."""
    order = Window.orderBy(F.col("total_amount").desc(), F.col("supplier_name").asc_nulls_first())
    ranked = top_names(invoices).withColumn("rank", F.row_number().over(order))
    part = F.least("rank", F.lit(6))
    return (
        ranked.groupBy(part.alias("slice"))
        .agg(F.max(F.when(F.col("rank") <= 5, F.col("supplier_name"))).alias("name"), F.sum("total_amount").alias("value"))
        .withColumn("name", F.when(F.col("slice") == 6, OTHERS).otherwise(F.col("name")))
        .where((F.col("slice") < 6) | (F.col("value") > 0))
    )


def pivot(invoices: DataFrame, types: list[str] = INVOICE_TYPES) -> DataFrame:
    """Months by invoice type with sums of net, VAT and gross; the type list spares a pass over the data."""
    return (
        invoices.groupBy(month_key(F.col("issue_date")).alias("month"))
        .pivot("invoice_type", types)
        .agg(F.sum("total_net").alias("net"), F.sum("total_vat").alias("vat"), F.sum("total_gross").alias("gross"))
        .na.fill(0)
    )


def with_total(invoices: DataFrame, columns: list[str]) -> DataFrame:
    """Detail rows and one row of sums; the sums are partly added up before they meet."""
    detail = invoices.select("file_id", "seq", "invoice_id", *columns, F.lit(False).alias("is_total"))
    none = F.lit(None)
    total = invoices.agg(*[F.sum(c).cast("decimal(28,2)").alias(c) for c in columns]).select(
        none.cast("long").alias("file_id"), none.cast("int").alias("seq"), F.lit("SUMA:").alias("invoice_id"),
        *columns, F.lit(True).alias("is_total"),
    )
    return detail.unionByName(total)


def vat_summary(items: DataFrame) -> DataFrame:
    """Net, VAT (rounded per item) and gross per rate; needs rate and net_amount."""
    rate = F.coalesce("vat_rate", F.lit(DEFAULT_RATE).cast("decimal(5,2)"))
    vat = vat_of(F.col("net_amount"), rate)
    return items.groupBy(rate.alias("vat_rate")).agg(
        F.sum("net_amount").alias("net"),
        F.sum(vat).alias("vat"),
        F.sum(F.col("net_amount") + vat).alias("gross"),
    )


def item_sums(invoices: DataFrame) -> DataFrame:
    """Sum of item totals beside the invoice gross, per invoice, without a shuffle."""
    zero = F.lit(0).cast(MONEY)
    total = F.aggregate("line_items", zero, lambda acc, i: (acc + i["total"]).cast(MONEY))
    return invoices.select(
        "file_id", "seq", total.alias("items_total"), "total_gross",
        (F.abs(total - F.col("total_gross")) > F.lit("0.05").cast(MONEY)).alias("differs"),
    )


def batch(pages: DataFrame, boundaries: DataFrame, invoices: DataFrame) -> DataFrame:
    """Statistics per document; each input is summed up per document before the join."""
    from ledgerloom.operators.dedupe import near_pair_count

    per_page = pages.groupBy(F.col("doc_id").alias("file_id")).agg(F.count("*").alias("total_pages"))
    found = boundaries.groupBy(F.col("doc_id").alias("file_id")).agg(F.count("*").alias("invoices_detected"))
    parsed = invoices.groupBy("file_id").agg(
        F.count("*").alias("invoices_parsed"),
        _flag(F.col("is_verified")).alias("invoices_valid"),
        _flag(F.size("errors") > 0).alias("invoices_with_errors"),
        F.sum("total_gross").alias("total_amount"),
    )
    out = per_page.join(found, "file_id", "left").join(parsed, "file_id", "left")
    out = out.join(near_pair_count(invoices), "file_id", "left")
    counts = ["invoices_detected", "invoices_parsed", "invoices_valid", "invoices_with_errors", "duplicate_pairs"]
    return out.na.fill(0, counts)


def panel(invoices: DataFrame) -> DataFrame:
    """The table panel: total, valid, errors, warning-only, duplicates, amount."""
    has_errors, has_warnings = F.size("errors") > 0, F.size("warnings") > 0
    return invoices.agg(
        F.count("*").alias("total"),
        _flag(F.col("is_verified")).alias("valid"),
        _flag(has_errors).alias("errors"),
        _flag(has_warnings & ~has_errors).alias("warnings"),
        _flag(F.col("is_duplicate")).alias("duplicates"),
        F.sum("total_gross").alias("total_amount"),
    )


def run_record(pages: DataFrame, invoices: DataFrame, engine: str, language: str) -> DataFrame:
    """One row about a run: documents, pages, invoices, engine, language."""
    seen = pages.groupBy("doc_id").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("files"), F.sum("n").alias("total_pages")
    )
    return seen.select(
        "files",
        "total_pages",
        invoices.agg(F.count("*")).scalar().alias("invoices_count"),
        F.lit(engine).alias("ocr_engine"),
        F.lit(language).alias("language"),
    )
