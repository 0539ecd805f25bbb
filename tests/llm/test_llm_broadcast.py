"""Rows that Spark sizes too low are not broadcast."""

from __future__ import annotations

from ledgerloom.llm import similar, simhash
from ledgerloom.session import stored


def _plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_variants_of_fingerprints_are_not_broadcast(spark):
    """A fingerprint makes 196 variants, but the rows after ``explode`` are sized like those before it."""
    ones = [0, 7, 1 << 40, (1 << 40) + 1, 12345678901, -1, -8]
    pairs = simhash.near_pairs(stored(spark.createDataFrame([(x,) for x in ones], "fp long"), "prints"))
    assert "Generate" in _plan(pairs) and "Broadcast" not in _plan(pairs)
    got = {frozenset((r.a, r.b)) for r in pairs.collect()}
    assert frozenset((0, 7)) in got and frozenset((-1, -8)) in got


def test_places_of_shingles_are_not_broadcast(spark):
    rows = [(t, token, 40, 10, 1, t) for t in range(3) for token in (5, 6)]
    found = spark.createDataFrame(rows, "t long, token long, df long, size long, place long, group long")
    found = stored(found, "prefixes")
    met = similar._meetings(found, found, 0.8)
    assert "Broadcast" not in _plan(met)
    assert {(r.a, r.b) for r in met.collect()} == {(0, 1), (0, 2), (1, 2)}
