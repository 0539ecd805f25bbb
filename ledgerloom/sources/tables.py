"""Readers for the input tables and the schemas of the engine's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.session import stored

MONTH = "month"  # of the issue date, the folders of the invoice table
PAGES = "doc_id long, page_no int, engine string, text string, confidence double, language string"
WORDS = (
    "doc_id long, page_no int, engine string, text string, left int, top int, width int, height int, confidence double"
)
ITEM = (
    "struct<position:int,description:string,quantity:int,unit_price:decimal(18,2),"
    "total:decimal(18,2),vat_rate:decimal(5,2)>"
)
INVOICES = (
    "file_id long, seq int, language string, invoice_id string, invoice_type string, issue_date date, sale_date date, "
    "due_date date, supplier_name string, supplier_tax_id string, supplier_address string, "
    "supplier_accounts array<string>, buyer_name string, buyer_tax_id string, buyer_address string, currency string, "
    "total_net decimal(18,2), total_vat decimal(18,2), total_gross decimal(18,2), payment_method string, "
    f"payment_status string, paid_amount decimal(18,2), line_items array<{ITEM}>"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_invoices(rows: DataFrame, path: str) -> None:
    """The invoice table: a folder for each month of issue, a range of suppliers in each file.

    Rows are dealt by ranges of month, supplier and number, so neither a full month nor a large supplier is one task.
    Invoices without an issue date have a folder of their own. They are written before the ranges are drawn from a sample
    of them, so that they are put together once and not once more for the sample.
    """
    names = StructType.fromDDL(INVOICES).names
    by = [MONTH, "supplier_tax_id", "invoice_id"]
    cut = stored(rows.select(*names, F.date_format("issue_date", "yyyy-MM").alias(MONTH)), "uncut")
    cut.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy(MONTH).parquet(path)


def scan_invoices(spark: SparkSession, path: str) -> DataFrame:
    """A stored invoice table, read with its stated schema and the month it is cut by."""
    return spark.read.schema(f"{INVOICES}, {MONTH} string").parquet(path)


def write_pages(rows: DataFrame, path: str) -> None:
    """Recognised pages, those of a document side by side: a file holds a range of documents."""
    by = ["doc_id", "page_no"]
    names = StructType.fromDDL(PAGES).names
    rows.select(*names).repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(path)


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Recognised pages; the order of pages is the column ``page_no``."""
    return spark.read.schema(PAGES).parquet(path)
