"""The keyed store beside a plain loop over the saves, and what a stored invoice table reads."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators import search
from ledgerloom.operators.changes import KEPT
from ledgerloom.session import work_dir
from ledgerloom.sources import fixtures, tables
from ledgerloom.streaming.store import Store, first_rows

SCHEMA = StructType().add("change_seq", "long").add("invoice_id", "string").add("total_gross", "double").add("payment_status", "string")
for _name in KEPT:
    SCHEMA = SCHEMA.add(_name, "string")


def saves(n, seed, keys=8):
    rng = random.Random(seed)
    numbers = rng.sample(range(10 * n), n)
    return [
        (numbers[i], rng.choice([None, *map(str, range(keys))]), float(rng.randint(0, 99)), rng.choice(["a", None]), *[f"{c}{i}" for c in KEPT])
        for i in range(n)
    ]


def replayed(rows):
    """The saves one by one, earliest first."""
    table = {}
    for row in sorted(rows, key=lambda r: r[0]):
        if row[1] is not None:
            table[row[1]] = row[:4] + (table[row[1]][4:] if row[1] in table else row[4:])
    return sorted(table.values(), key=repr)


def got(store, spark):
    return sorted((tuple(r) for r in store.current(spark).collect()), key=repr)


def whole(path, part):
    return sorted(os.listdir(f"{path}/{part}")) if os.path.isdir(f"{path}/{part}") else []


@pytest.mark.parametrize("every", [1, 3, 100])
def test_store_equals_saves_one_by_one(spark, every):
    store = Store(work_dir(spark, "store"), SCHEMA, every=every)
    assert got(store, spark) == []
    rows, seen = saves(60, 4), []
    for batch in range(6):
        part = rows[10 * batch : 10 * batch + 10]
        seen += part
        frame = spark.createDataFrame(part, SCHEMA)
        store.save_batch(frame, batch)
        store.save_batch(frame, batch)  # as after a failure
        assert got(store, spark) == replayed(seen)
        assert len(whole(store.path, "base")) <= 2 and len(whole(store.path, "log")) <= 2 * every
    store.compact(spark)
    store.compact(spark)
    assert got(store, spark) == replayed(rows)


def test_two_batches_on_one_key_keep_the_first_columns(spark):
    store = Store(work_dir(spark, "store"), SCHEMA, every=1)
    one = (1, "x", 1.0, "a", *[f"first {c}" for c in KEPT])
    two = (2, "x", 2.0, None, *[f"second {c}" for c in KEPT])
    for batch, row in enumerate([two, one]):  # the later one comes first
        store.save_batch(spark.createDataFrame([row], SCHEMA), batch)
    assert got(store, spark) == [(2, "x", 2.0, None, *[f"first {c}" for c in KEPT])]


def test_broken_folders_do_not_count(spark):
    store = Store(work_dir(spark, "store"), SCHEMA, every=100)
    rows = saves(20, 9)
    store.save_batch(spark.createDataFrame(rows[:10], SCHEMA), 0)
    store.save_batch(spark.createDataFrame(rows[10:], SCHEMA), 1)
    os.remove(f"{store.path}/log/batch=1/_SUCCESS")
    os.makedirs(f"{store.path}/base/upto=1")
    assert got(store, spark) == replayed(rows[:10])
    store.save_batch(spark.createDataFrame(rows[10:], SCHEMA), 1)
    store.compact(spark)
    assert got(store, spark) == replayed(rows)


def test_rows_without_order_ties_and_another_state(spark):
    store = Store(work_dir(spark, "store"), SCHEMA, every=2)
    tail = [None] * len(KEPT)
    rows = [(None, "x", 1.0, "a", *tail), (5, "x", 2.0, "b", *tail), (None, "y", 3.0, "c", *tail), (7, "z", 4.0, "d", *tail), (7, "z", 5.0, "e", *tail)]
    for batch, part in enumerate([rows, rows[::-1], rows[:1]]):
        store.save_batch(spark.createDataFrame(part, SCHEMA), batch)
    found = {r[1]: r[2] for r in got(store, spark)}
    assert found["x"] == 2.0 and found["y"] == 3.0 and found["z"] in (4.0, 5.0)
    with pytest.raises(ValueError):
        store.save_batch(spark.createDataFrame(rows, SCHEMA), 0)


def test_streamed_first_rows(spark):
    source = work_dir(spark, "source")
    schema = StructType.fromDDL("event_id long, user_id long, what string")
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 20), f"w{i}") for i in range(200)]
    spark.createDataFrame(rows, schema).repartition(7).write.parquet(source)
    store = first_rows(work_dir(spark, "firsts"), schema, "user_id", "event_id", every=3)
    state = work_dir(spark, "state")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    store.save(stream, state).awaitTermination()
    want = {}
    for row in rows:
        want.setdefault(row[1], row)
    assert got(store, spark) == sorted(want.values(), key=repr)
    later = [(500 + i, i % 25, "again") for i in range(25)]  # keys that come back, and four new ones
    spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(source)
    store.save(stream, state).awaitTermination()
    for row in later:
        want.setdefault(row[1], row)
    assert got(store, spark) == sorted(want.values(), key=repr)


def scanned(frame):
    """What the scan of an executed plan says of its filters."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return next(line for line in plan.splitlines() if "FileScan" in line)


def test_stored_invoices_are_read_with_pruning(spark, folder):
    path = work_dir(spark, "invoices")
    rows = fixtures.invoices(spark, folder)
    tables.write_invoices(rows, path)
    stored = tables.scan_invoices(spark, path)
    assert stored.count() == rows.count()
    period = dict(date_from="1995-03-05", date_to="1995-05-20")
    want = sorted((r.file_id, r.seq) for r in rows.where(search.predicate(**period)).collect())
    found = search.search(stored, **period).select("file_id", "seq")
    scan = scanned(found)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 5
    assert "PartitionFilters: [isnotnull(month" in scan and "GreaterThanOrEqual(issue_date,1995-03-05)" in scan
    assert "line_items" not in scan.split("ReadSchema")[1]
    parts = search.in_months(stored, "1995-03-05", "1995-05-20").select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("month=")[1][:7] for r in parts} == {"1995-03", "1995-04", "1995-05"}
    one = stored.where(search.predicate(supplier_tax_id="1000000006")).select("invoice_id")
    assert "EqualTo(supplier_tax_id,1000000006)" in scanned(one)


def test_invoices_without_a_date_and_empty_tables(spark):
    names = StructType.fromDDL(tables.INVOICES)
    values = {"file_id": 1, "seq": 1, "invoice_id": "a"}
    undated = spark.createDataFrame([tuple(values.get(n) for n in names.names)], names)
    for rows, n in ((undated, 1), (undated.where("false"), 0)):
        path = work_dir(spark, "invoices")
        tables.write_invoices(rows, path)
        stored = tables.scan_invoices(spark, path)
        assert stored.count() == n
        assert search.in_period(stored, "1990-01-01", None).count() == 0


def test_pages_come_back_with_their_schema(spark):
    rows = [(2, 1, "a", "x", 0.5, "Polski"), (1, 2, "a", None, None, None), (1, 1, "b", "y", 1.0, "Angielski")]
    path = work_dir(spark, "pages")
    frame = spark.createDataFrame([(*r, dt.date(2024, 1, 1)) for r in rows], tables.PAGES + ", extra date")
    tables.write_pages(frame, path)
    back = tables.scan_pages(spark, path)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    assert "GreaterThan(doc_id,1)" in scanned(back.where(F.col("doc_id") > 1))
