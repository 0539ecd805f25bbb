"""Every registered query beside its expected SQL."""

import pytest

import __spark_entry__ as entry
import check


@pytest.fixture(scope="module")
def db(folder):
    return check.database(folder)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, folder, name):
    assert check.compare(spark, db, folder, name) == ""


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["j03_exact_duplicates", "j05_duplicate_flags", "e01_boundaries", "v_by_rule", "a01_general"])
def test_plans_stay_in_the_engine(spark, folder, name):
    plan = entry.queries()[name](spark, folder)._jdf.queryExecution().toString()
    for bad in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "BroadcastNestedLoopJoin"):
        assert bad not in plan
