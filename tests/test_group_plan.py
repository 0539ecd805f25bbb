"""Items of grouped lines are found without a list that grows by one copy for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import extract


def test_items_are_not_folded(spark):
    frame = spark.createDataFrame([(["Long name", "12,50"],)], "l array<string>")
    found = frame.select(extract.grouped_items(F.col("l")).alias("x"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_append" not in plan and "aggregate(" not in plan
    assert [(i.position, i.description, float(i.total)) for i in found.first().x] == [(1, "Long name", 12.5)]


def test_items_of_odd_lists(spark):
    """Numbers before the first name, names without numbers, missing lines, and lines after the total line."""
    lists = [
        ["7", "First thing", "1", "9,50", "3", "Second thing", "NIP 5", "Third thing", None, "4", "SUMA", "Fourth thing", "8"],
        ["Only a name"], ["SUMA", "First thing", "1"], [], None, ["First thing", "short", "2", "BANK of things", "5"],
    ]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, l array<string>")
    rows = frame.select("i", extract.grouped_items(F.col("l")).alias("x")).orderBy("i").collect()
    got = [None if r.x is None else [(i.description, float(i.total)) for i in r.x] for r in rows]
    assert got == [
        [("First thing", 9.5), ("Second thing", 5.0), ("Third thing", 4.0)], [], [], [], None, [("First thing", 5.0)],
    ]


def test_texts_without_digits_hold_no_numbers(spark):
    frame = spark.createDataFrame([("no number",), ("",), (None,), ("a 1 234,50 b 7 c 1.2.2003",)], "t string")
    got = [r.n and [float(x) for x in r.n] if r.n is not None else None for r in frame.select(text.extract_numbers(F.col("t")).alias("n")).collect()]
    assert got == [[], [], None, [1234.5, 7.0]]
