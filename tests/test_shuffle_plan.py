"""A task's share of a shuffle does not follow the session's number of parts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ledgerloom.session import RUNTIME
from ledgerloom.sources import fixtures, tables


def test_shuffles_start_with_many_parts(spark, folder):
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    plan = fixtures.rendered(spark, folder)._jdf.queryExecution().executedPlan().toString()
    parts = {int(n) for n in re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", plan)}
    assert parts and min(parts) >= 1000


def test_lists_take_the_order_of_their_rows(spark, folder):
    """Items lie sorted by order for their positions; a hashed list would sort them again."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    plan = fixtures.clean_invoices(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert any("SortAggregate" in line and "collect_list" in line for line in plan.split("\n"))
    assert not any("ObjectHashAggregate" in line and "collect_list" in line for line in plan.split("\n"))


def test_invoices_are_put_together_once(spark, folder, tmp_path, monkeypatch):
    """Ranges are drawn from written rows: the sample would otherwise run the joins before it a second time."""
    seen = []
    kept = tables.stored

    def watch(rows, name):
        out = kept(rows, name)
        seen.append(out)
        return out

    monkeypatch.setattr(tables, "stored", watch)
    rows = fixtures.invoices(spark, folder)
    tables.write_invoices(rows, str(tmp_path / "t"))
    assert len(seen) == 1 and "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    back = tables.scan_invoices(spark, str(tmp_path / "t"))
    assert back.count() == rows.count() == seen[0].count()
    first = lambda t: t.agg(F.sum(F.xxhash64("file_id", "seq", "line_items").cast("decimal(38,0)"))).first()[0]
    assert first(back) == first(rows)
