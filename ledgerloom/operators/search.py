"""Invoice search: a conjunction of Column predicates, ordered and limited."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import MONEY
from ledgerloom.sources.tables import MONTH

ORDERABLE = (
    "invoice_id", "invoice_type", "issue_date", "sale_date", "due_date", "supplier_name", "supplier_tax_id",
    "buyer_name", "buyer_tax_id", "total_net", "total_vat", "total_gross", "currency", "payment_status",
    "paid_amount", "language", "confidence",
)


def contains(name: str, part: str) -> Column:
    """Literal part anywhere in the column, any case."""
    return F.contains(F.lower(F.col(name)), F.lower(F.lit(part)))


def predicate(
    *,
    invoice_id: str | None = None,
    supplier_name: str | None = None,
    supplier_tax_id: str | None = None,
    buyer_tax_id: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    min_amount: float | str | None = None,
    max_amount: float | str | None = None,
    payment_status: str | None = None,
    is_verified: bool | None = None,
) -> Column:
    """All given criteria; a criterion left out adds nothing."""
    parts: list[Column] = []
    if invoice_id:
        parts.append(contains("invoice_id", invoice_id))
    if supplier_name:
        parts.append(contains("supplier_name", supplier_name))
    if supplier_tax_id:
        parts.append(F.col("supplier_tax_id") == supplier_tax_id)
    if buyer_tax_id:
        parts.append(F.col("buyer_tax_id") == buyer_tax_id)
    parts += between_dates(date_from, date_to)
    if min_amount is not None:
        parts.append(F.col("total_gross") >= F.lit(str(min_amount)).cast(MONEY))
    if max_amount is not None:
        parts.append(F.col("total_gross") <= F.lit(str(max_amount)).cast(MONEY))
    if payment_status:
        parts.append(F.col("payment_status") == payment_status)
    if is_verified is not None:
        parts.append(F.col("is_verified") == is_verified)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def between_dates(date_from: str | None, date_to: str | None) -> list[Column]:
    """Inclusive bounds on the issue date."""
    out = []
    if date_from:
        out.append(F.col("issue_date") >= F.lit(date_from).cast("date"))
    if date_to:
        out.append(F.col("issue_date") <= F.lit(date_to).cast("date"))
    return out


def in_months(invoices: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """The months of a stored table that a period touches, so that the others are not read; other tables as they are."""
    if MONTH not in invoices.columns:
        return invoices
    if date_from:
        invoices = invoices.where(F.col(MONTH) >= F.date_format(F.lit(date_from).cast("date"), "yyyy-MM"))
    if date_to:
        invoices = invoices.where(F.col(MONTH) <= F.date_format(F.lit(date_to).cast("date"), "yyyy-MM"))
    return invoices


def in_period(invoices: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    invoices = in_months(invoices, date_from, date_to)
    return invoices.where(reduce(lambda a, b: a & b, between_dates(date_from, date_to), F.lit(True)))


def search(
    invoices: DataFrame, *, order_by: str = "issue_date", descending: bool = True, limit: int | None = None, **criteria
) -> DataFrame:
    """Matching invoices in order; NULLs sort first ascending and last descending, ties by number."""
    if order_by not in ORDERABLE:
        raise ValueError(f"cannot order by {order_by!r}")
    column = F.col(order_by)
    order = column.desc_nulls_last() if descending else column.asc_nulls_first()
    ties = [F.col(c) for c in ("invoice_id", "file_id", "seq") if c in invoices.columns]
    months = in_months(invoices, criteria.get("date_from"), criteria.get("date_to"))
    found = months.where(predicate(**criteria)).orderBy(order, *ties)
    return found.limit(limit) if limit else found


def confident(rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Rows whose confidence reaches the threshold."""
    return rows.where(F.col("confidence") >= threshold)
