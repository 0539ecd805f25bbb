"""What the reports read, and how rules and accounts are worked out."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from ledgerloom.functions import checksum
from ledgerloom.operators import quality
from ledgerloom.plans import relational
from ledgerloom.sources.tables import INVOICES


def test_reports_read_no_items(spark, folder):
    names = relational.ready(spark, folder).columns
    assert {"errors", "warnings", "is_duplicate", "confidence"} <= set(names)
    assert not {"line_items", "findings", "suggestions"} & set(names)
    assert "line_items" in relational.ready(spark, folder, True).columns


def test_rules_are_joined_not_filtered(spark):
    """A filter over the list of all rules has every rule interpreted for every row."""
    empty = spark.createDataFrame([], INVOICES).select(quality.findings("2001-01-01").alias("f"))
    root = empty._jdf.queryExecution().optimizedPlan().expressions().head().child()
    assert root.nodeName() == "Concat"


def test_remainders_agree_with_whole_numbers(spark):
    accounts = [
        "PL61109010140000071219812874", "DE89370400440532013000", "GB82WEST12345698765432", "NL91ABNA0417164300", "XX001",
        "AB12" + "9" * 32, "AB12" + "9" * 33, "ZZ99" + "0" * 31 + "7", "XX00" + "1" * 30 + "A",
    ]
    frame = spark.createDataFrame([(a,) for a in accounts], "a string")
    got = {r.a: r.m for r in frame.select("a", checksum.iban_mod97(F.col("a")).alias("m")).collect()}
    for a in accounts:
        assert got[a] == int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97


def test_accounts_with_blanks_and_small_letters(spark):
    rows = ["pl61 1090 1014 0000 0712 1981 2874", "PL61 1090 1014 0000 0712 1981 2874", "PL6110901014000007121981287", "", None]
    frame = spark.createDataFrame([(i, a) for i, a in enumerate(rows)], "i int, a string").orderBy("i")
    assert [r.v for r in frame.select(checksum.iban_valid(F.col("a")).alias("v")).collect()] == [True, True, False, False, False]
    texts = [r.v for r in frame.select(checksum.format_iban(F.col("a")).alias("v")).collect()]
    assert texts == ["PL61 1090 1014 0000 0712 1981 2874"] * 2 + ["PL61 1090 1014 0000 0712 1981 287", "", None]
