"""Where the rendered pages are shuffled."""

from __future__ import annotations

from ledgerloom.sources import fixtures


def test_pages_are_rendered_beside_their_order(spark):
    """Only counts of lines are dealt by file; orders with their items stay where they were put together."""
    rows = fixtures.rendered(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString().split("\n")
    items = next(i for i, line in enumerate(plan) if "collect_list" in line)
    assert not any("Exchange hashpartitioning(file_id" in line for line in plan[:items])
