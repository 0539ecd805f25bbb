"""How the table that the reports read is written."""

from __future__ import annotations

import __spark_entry__  # noqa: F401
from ledgerloom.plans import relational


def test_processed_invoices_are_stored_small(spark, folder):
    files = relational.ready(spark, folder).inputFiles()
    assert files and all(".zstd." in f for f in files)
