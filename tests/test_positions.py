"""Positions in long texts, numbering and hot keys beside plain loops and in the executed plan."""

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.dims import DATE_HITS
from ledgerloom.functions import dates, text
from ledgerloom.operators import dedupe, extract, joins, ordered

TODAY = dt.date(2023, 6, 1)


@pytest.mark.parametrize("run", [3, text.RUN])
def test_every_match_has_its_position(spark, monkeypatch, run):
    monkeypatch.setattr(text, "RUN", run)
    rnd = random.Random(run)
    texts = ["", "x", "ab", "abab", "ąabé ab"] + ["".join(rnd.choice(["ab", "é", " ", "a", "b"]) for _ in range(n)) for n in (10, 100)]
    texts += [("ab" + "-" * (n % 3)) * n for n in (run - 1, run, run + 1, 2 * run, 2 * run + 1, 1000)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [(h.pos, h.raw) for h in r.h] for r in frame.select("i", text.regex_hits("t", "ab").alias("h")).collect()}
    assert got == {i: [(m.start(), m[0]) for m in re.finditer("ab", t)] for i, t in enumerate(texts)}
    assert frame.select("i", text.regex_hits("t", "ab").alias("h")).where("h is null").count() == 0


def dense(rnd, n):
    """A text full of dates, many of which overlap or stand next to each other."""
    out = []
    for _ in range(n):
        day, month, year = rnd.randint(1, 32), rnd.randint(1, 13), rnd.randint(2018, 2024)
        form = rnd.choice(["{:02}.{:02}.{}", "{}.{}.{}", "{:02}-{:02}-{}", "{:02}/{:02}/{}"])
        out.append(rnd.choice([form.format(day, month, year), f"{year}-{month:02}-{day:02}", f"1{day:02}.{month:02}.{year}.{month:02}.{day:02}", "due date", "Pay by", "x" * rnd.randint(1, 90)]))
        out.append(rnd.choice([" ", "", ".", "\n"]))
    return "".join(out)


def plain_hits(value):
    found = []
    for n, (pattern, form) in enumerate(DATE_HITS):
        for m in re.finditer(pattern, value, re.A):
            parts = re.split(r"[-./]", m[0])
            if form == "d-M-yyyy":
                parts.reverse()
            try:
                day = dt.date(*map(int, parts))
            except ValueError:
                continue
            if dt.date(1990, 1, 1) <= day <= TODAY + dt.timedelta(730):
                found.append((n, m.start(), day))
    kept = []
    for hit in found:
        if not any(k[2] == hit[2] and abs(k[1] - hit[1]) < 5 for k in kept):
            kept.append(hit)
    return sorted((pos, n, day) for n, pos, day in kept)


def plain_near(value, hits, labels, reach=150):
    for label in labels:
        for m in re.finditer(re.escape(label.lower()), value.lower()):
            at = m.start()
            for near in ([h for h in hits if at <= h[0] <= at + reach], [h for h in hits if abs(h[0] - at) <= reach]):
                if near:
                    return min((abs(p - at), p, day) for p, _, day in near)[2]
    return None


@pytest.mark.parametrize("together", [1, 3, dates.TOGETHER])
def test_dates_and_labels_beside_plain_loops(spark, monkeypatch, together):
    monkeypatch.setattr(dates, "TOGETHER", together)
    rnd = random.Random(together)
    texts = ["", "due date", "01.02.2020"] + [dense(rnd, rnd.randint(1, 60)) for _ in range(60)] + [dense(rnd, 1500)]
    texts.append("due date " * 300 + "y" * 200 + " pay by 03.04.2021")
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    frame = frame.withColumn("low", F.lower("t")).withColumn("h", dates.drop_repeats(dates.date_hits("t", F.lit(TODAY))))
    labels = ["DUE DATE", "PAY BY"]
    rows = frame.select("i", "h", dates.near_label("low", "h", labels).alias("d")).collect()
    repeats = 0
    for r in rows:
        want = plain_hits(texts[r.i])
        assert [tuple(h) for h in r.h] == want
        assert r.d == plain_near(texts[r.i], want, labels)
        repeats += len(want)
    assert len(rows) == len(texts) and repeats > 800


def test_parties_of_many_ids(spark):
    """Equally near ids and texts without labels: the first seen id counts, as in a plain loop."""
    rnd = random.Random(1)
    rows = []
    for i in range(80):
        ids = [f"{rnd.randint(1, 6):010}" for _ in range(rnd.randint(0, 12))]
        hits = [(x, 10 * rnd.randint(0, 12)) for x in ids]
        rows.append((i, hits, rnd.choice([-1, 40, 60]), rnd.choice([-1, 50, 60])))
    frame = spark.createDataFrame(rows, "i int, hits array<struct<id:string,pos:int>>, s int, b int")
    frame = frame.withColumn("ids", F.array_distinct(F.transform("hits", lambda h: h["id"])))
    got = frame.select("i", extract.party_ids(F.col("hits"), F.col("ids"), F.col("s"), F.col("b")).alias("p")).collect()
    far = extract.FAR
    for r in got:
        _, hits, s, b = rows[r.i]
        ids = list(dict.fromkeys(x for x, _ in hits))
        sides = {True: [], False: []}
        for x, pos in hits:
            ds, db = abs(pos - s) if s >= 0 else far, abs(pos - b) if b >= 0 else far
            sides[ds < db].append((ds if ds < db else db, ids.index(x), pos, x))
        pick = lambda side, *ranks: min(side)[3] if side else next((ids[k] for k in ranks if k < len(ids)), None)
        assert (r.p.supplier, r.p.buyer) == (pick(sides[True], 0), pick(sides[False], 1, 0))


@pytest.mark.parametrize("target", [9, 40, 10_000])
def test_numbers_by_two_columns(spark, target):
    rnd = random.Random(target)
    rows = [(rnd.choice([None, 1, 1, 1, 2]), f"k{rnd.randint(0, 60):02}", i) for i in range(400)]
    frame = spark.createDataFrame(rows, "a int, b string, lp_ int").repartition(7)
    numbered = ordered.number_rows(frame, F.col("a"), F.col("b"), name="no", target=target)
    got = sorted(numbered.collect(), key=lambda r: r.no)
    assert [r.no for r in got] == list(range(1, 401))
    order = [(r.a is not None, r.a or 0, r.b) for r in got]
    assert order == sorted(order) and sorted(r.lp_ for r in got) == list(range(400))
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and len(plan) < 3000  # nothing in the plan grows with the slices
    assert ordered.number_rows(frame.limit(0), F.col("a")).count() == 0


@pytest.fixture
def small_partitions(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rows_of_a_hot_key_are_split(spark, small_partitions):
    """With most rows under one key, the executed join reads that key in several tasks."""
    day = dt.date(2024, 1, 5)
    rows = [(1, i, f"n{i % 9000}", "7530011446", day, Decimal("10.00")) for i in range(12_000)]
    rows += [(1, 50_000 + i, f"m{i // 2}", f"75300{i // 2:05}", day, Decimal("3.00")) for i in range(2000)]
    schema = "file_id long, seq int, invoice_id string, supplier_tax_id string, issue_date date, total_gross decimal(18,2)"
    frame = spark.createDataFrame(rows, schema).repartition(16)
    registry = spark.createDataFrame([("7530011446", "x"), ("7530000007", "y")], "tax_id string, name string")
    counts = {
        "exact": (dedupe.exact_duplicates(frame), 8999 + 0), "near": (dedupe.near_duplicates(frame), 12_000 - 1 + 1000),
        "flags": (dedupe.duplicate_rows(frame), 14_000), "unregistered": (joins.unregistered(frame, registry), 2000 - 2),
    }
    for name, (result, want) in counts.items():
        found = result.collect()
        if name == "exact":
            assert len({r.invoice_id for r in found}) == want
        elif name == "near":
            assert len({r.seq for r in found}) == want
        else:
            assert len(found) == want
        assert "skew=true" in result._jdf.queryExecution().executedPlan().toString(), name
