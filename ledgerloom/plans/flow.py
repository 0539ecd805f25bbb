"""The way from recognised pages to checked invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.operators import changes, dedupe, extract, pages, quality


def boundaries(page_rows: DataFrame, auto: bool = True) -> DataFrame:
    return pages.segment(pages.page_features(page_rows), auto)


def merged(page_rows: DataFrame, auto: bool = True) -> DataFrame:
    """One text per invoice; the boundaries are a small table, so that pages are searched for marks once."""
    return pages.merge_pages(page_rows, session.stored(boundaries(page_rows, auto), "boundaries"))


def stored(texts: DataFrame) -> DataFrame:
    """Merged texts as a table in the shared folder.

    Reading the texts takes most of the time of a run. With the cut a lost executor costs its part of that
    work only, not the shuffles before it, and the long expressions are planned once over a plain scan.
    """
    return session.stored(texts, "texts", "zstd")


def invoices(
    page_rows: DataFrame, as_of: str, my_tax_id: str | None = None, auto: bool = True, detect: bool = False
) -> DataFrame:
    """Extracted and checked invoices of the pages; texts without any key field become error records.

    Pages without a language column, or all with ``detect``, get the language of their document's first page.
    """
    if detect or "language" not in page_rows.columns:
        page_rows = pages.label_language(page_rows)
    parsed = extract.extract(stored(merged(page_rows, auto)), as_of, my_tax_id)
    return quality.validate(changes.error_records(parsed), as_of)


def supplier_totals(checked: DataFrame) -> DataFrame:
    """Invoices, valid invoices, errors and gross per supplier."""
    return checked.groupBy("supplier_tax_id").agg(
        F.count("*").alias("invoices"),
        F.count_if("is_verified").alias("valid"),
        F.sum(F.size("errors")).alias("errors"),
        F.sum("total_gross").alias("total_gross"),
    )


def mark(checked: DataFrame) -> DataFrame:
    return dedupe.mark_duplicates(checked)
