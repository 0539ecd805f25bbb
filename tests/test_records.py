"""Duplicates, rules, statistics, numbering, changes and streams beside plain restatements."""

import datetime as dt
import itertools
import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.operators import changes, dedupe, extract, joins, ordered, quality, search, stats
from ledgerloom.session import work_dir
from ledgerloom.sources.tables import INVOICES
from ledgerloom.streaming import feeds

NARROW = "file_id long, seq int, invoice_id string, supplier_tax_id string, issue_date date, total_gross decimal(18,2)"


def narrow(spark, n=300, seed=5):
    rng = random.Random(seed)
    rows = [
        (
            rng.randint(0, 3), i, rng.choice([None, *map(str, range(40))]), rng.choice([None, "a", "b"]),
            dt.date(2024, 1, rng.randint(1, 3)), Decimal(rng.randint(0, 400)) / 100,
        )
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, NARROW)


def pairs(rows, tol):
    out = []
    for a, b in itertools.combinations(rows, 2):
        same_id = a[2] is not None and a[2] == b[2]
        near = a[3] is not None and a[3] == b[3] and a[4] == b[4] and abs(a[5] - b[5]) < Decimal(tol)
        if a[0] == b[0] and (same_id or near):
            out.append((a[0], a[1], b[1]))
    return out


@pytest.mark.parametrize("tol", ["0.01", "0.05", "0.30"])
def test_duplicate_rows_are_the_ends_of_pairs(spark, tol):
    rows, frame = narrow(spark)
    want = sorted({(f, x) for f, a, b in pairs(rows, tol) for x in (a, b)})
    got = sorted((r.file_id, r.seq) for r in dedupe.duplicate_rows(frame, tol).collect())
    assert got == want and len(want) > 20


def test_pair_counts(spark):
    rows, frame = narrow(spark)
    want = {f: sum(1 for p in pairs(rows, "0.01") if p[0] == f) for f in range(4)}
    got = {r.file_id: r.duplicate_pairs for r in dedupe.near_pair_count(frame).collect()}
    assert got == want
    exact = [
        (a, b) for a, b in itertools.permutations(rows, 2)
        if a[3] is not None and a[3:] == b[3:] and a[2] is not None and b[2] is not None and a[2] < b[2]
    ]
    assert dedupe.exact_pair_count(frame).first().pairs == len(exact)


def test_links_of_a_key_that_holds_most_rows(spark):
    day = dt.date(2024, 1, 5)
    rows = [(1, i, f"n{i}", "7530011446", day, Decimal("10.00")) for i in range(3000)]
    rows += [(1, 3000 + i, f"n{i}", "7530011447", day, Decimal(i)) for i in range(50)]
    frame = spark.createDataFrame(
        rows, "file_id long, seq int, invoice_id string, supplier_tax_id string, issue_date date, total_gross decimal(18,2)"
    )
    assert dedupe.exact_duplicates(frame).count() == 2999
    assert dedupe.duplicate_rows(frame).count() == 3050


@pytest.mark.parametrize("values", [[1], [1, 2], [5, 5, 5, 9], list(range(-50, 51)), [10**12, -(10**12), 3, 4]])
def test_exact_median(spark, values):
    cents = [Decimal(v * 100 + 7) / 100 for v in values]
    frame = spark.createDataFrame([(c,) for c in cents], "v decimal(18,2)")
    assert stats.exact_median(frame, "v") == statistics.median(cents)
    assert stats.exact_median(frame.where("false"), "v") is None


@pytest.mark.parametrize("target", [7, 31, 10_000])
def test_number_rows(spark, target):
    values = random.Random(2).sample(range(-1000, 1000), 500)
    frame = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    got = sorted((r.lp, r.v) for r in ordered.number_rows(frame, F.col("v"), target=target).collect())
    assert got == list(enumerate(sorted(values), 1))


GOOD = dict(
    file_id=1, seq=1, language="Polski", invoice_id="FV/1/01/2024", invoice_type="VAT", issue_date=dt.date(2024, 1, 5),
    sale_date=dt.date(2024, 1, 5), due_date=dt.date(2024, 1, 19), supplier_name="A", supplier_tax_id="7530011446",
    supplier_address="x", supplier_accounts=["PL61109010140000071219812874"], buyer_name="B", buyer_tax_id="5260001246",
    buyer_address="y", currency="PLN", total_net=Decimal("100.00"), total_vat=Decimal("23.00"), total_gross=Decimal("123.00"),
    payment_method="przelew", payment_status="nieopłacona", paid_amount=Decimal(0),
    line_items=[(1, "thing", 1, Decimal("123.00"), Decimal("123.00"), Decimal("23.00"))],
)


def item(**kw):
    base = dict(position=1, description="thing", quantity=1, unit_price=Decimal("123.00"), total=Decimal("123.00"), vat_rate=Decimal("23.00"))
    return [tuple({**base, **kw}.values())]


money = Decimal
CASES = [
    ({}, []),
    ({"invoice_id": None}, ["V01", "V02", "V05"]),
    ({"supplier_name": None, "supplier_tax_id": None, "supplier_address": None}, ["V01", "V06", "V09"]),
    ({"invoice_id": "UNKNOWN"}, ["V02", "V05"]),
    ({"invoice_id": "1/"}, ["V03", "V05"]),
    ({"invoice_id": "ABCD"}, ["V04", "V05"]),
    ({"supplier_name": None}, ["V06"]),
    ({"supplier_tax_id": "7530011447"}, ["V07"]),
    ({"language": "Rumuński", "supplier_tax_id": "123"}, ["V08"]),
    ({"supplier_tax_id": None}, ["V09"]),
    ({"buyer_name": None}, ["V10"]),
    ({"buyer_tax_id": "1"}, ["V11"]),
    ({"supplier_accounts": ["PL00109010140000071219812874"]}, ["V12"]),
    ({"issue_date": dt.date(2030, 1, 1), "due_date": dt.date(2030, 1, 2)}, ["V13"]),
    ({"due_date": dt.date(2024, 1, 1)}, ["V14", "V16"]),
    ({"due_date": dt.date(2024, 6, 1)}, ["V15"]),
    ({"due_date": None}, ["V17"]),
    ({"total_net": money("-1.00"), "total_vat": money("124.00")}, ["V18"]),
    ({"total_net": money(0), "total_vat": money(0), "total_gross": money(0), "line_items": []}, ["V19", "V22"]),
    ({"total_gross": money("123.03")}, ["V20"]),
    ({"total_net": money("90.00"), "total_vat": money("33.00")}, ["V21"]),
    ({"line_items": []}, ["V22"]),
    ({"line_items": item(description="")}, ["V23"]),
    ({"line_items": item(quantity=0)}, ["V24", "V27"]),
    ({"line_items": item(unit_price=money("-123.00"), quantity=-1)}, ["V24", "V25"]),
    ({"line_items": item(total=money("-123.00"))}, ["V26", "V27", "V28"]),
    ({"line_items": item(unit_price=money("122.97"))}, ["V27"]),
    ({"line_items": item(total=money("123.06"), unit_price=money("123.06"))}, ["V28"]),
    ({"line_items": item(vat_rate=money("7.00"))}, ["V29"]),
    ({"language": "Niemiecki"}, ["V29"]),
    ({"buyer_tax_id": "7530011446"}, ["V30"]),
    (
        {"total_gross": money("1230000.00"), "total_net": money("1000000.00"), "total_vat": money("230000.00"),
         "line_items": item(total=money("1230000.00"), unit_price=money("1230000.00"))}, ["V31"],
    ),
]


def test_rules(spark):
    rows = [tuple({**GOOD, **change, "seq": i}.values()) for i, (change, _) in enumerate(CASES)]
    out = quality.validate(spark.createDataFrame(rows, INVOICES), "2024-12-31").orderBy("seq").collect()
    for (change, want), row in zip(CASES, out):
        assert [f.rule for f in row.findings] == want, change
        errors = sum(f.severity == "error" for f in row.findings)
        warnings = sum(f.severity == "warning" for f in row.findings)
        assert row.confidence == pytest.approx(max(0, min(1, 1 - 0.15 * errors - 0.05 * warnings)))
        assert row.is_verified == (errors == 0)


def test_confidence_has_a_floor(spark):
    got = spark.range(1).select(quality.confidence(F.lit(7), F.lit(0)).alias("a"), quality.confidence(F.lit(0), F.lit(25)).alias("b")).first()
    assert (got.a, got.b) == (0.0, 0.0)


def test_search_rejects_unknown_order(spark):
    _, frame = narrow(spark, 5)
    with pytest.raises(ValueError):
        search.search(frame, order_by="1; drop table invoices")


def test_like_signs_are_literal(spark):
    frame = spark.createDataFrame([("a%b",), ("axb",)], "invoice_id string")
    assert frame.where(search.predicate(invoice_id="A%B")).count() == 1


def test_upsert_keeps_what_an_update_may_not_touch(spark):
    base = spark.createDataFrame([("1", 5, "old"), ("2", 6, "old"), (None, 7, "old")], "invoice_id string, total int, notes string")
    new = spark.createDataFrame(
        [("1", 50, "new", 1), ("1", 51, "new", 2), ("3", 9, "new", 1)], "invoice_id string, total int, notes string, change_seq int"
    )
    got = sorted(map(tuple, changes.upsert(base, new).collect()), key=str)
    assert got == sorted([("1", 51, "old"), ("2", 6, "old"), ("3", 9, "new"), (None, 7, "old")], key=str)


TEXT = "\n".join([
    "FAKTURA VAT NR FV/9/02/2024", "SPRZEDAWCA: Alfa Sp. z o.o.", "NIP: 753-001-14-46", "00-950 Warszawa",
    "NABYWCA:", "Beta SA", "NIP: 5260001246", "DATA WYSTAWIENIA: 05.02.2024", "LP NAZWA ILOŚĆ CENA WARTOŚĆ",
    "śruba  2  10,00  20,00", "LP NAZWA ILOŚĆ CENA WARTOŚĆ", "nakrętka  3  1 000,00  3 000,00", "SUMA",
    "NETTO 23%: 2 455,28", "VAT 23%: 564,72", "RAZEM DO ZAPŁATY: 3 020,00 PLN", "nieopłacona, KARTA",
])


def read(spark, value, mine=None, language="Polski"):
    rows = spark.createDataFrame([(1, 1, 1, value, language)], "doc_id long, start_page int, end_page int, text string, language string")
    return extract.extract(rows, "2024-12-31", mine).first()


def test_extract_one_text(spark):
    got = read(spark, TEXT, "526-000-12-46")
    assert got.invoice_id == "FV/9/02/2024"
    assert (got.supplier_name, got.supplier_tax_id, got.supplier_address) == ("Alfa Sp. z o.o.", "7530011446", "00-950 Warszawa")
    assert (got.buyer_name, got.buyer_tax_id, got.belongs_to_user) == ("Beta SA", "5260001246", True)
    assert (got.issue_date, got.sale_date, got.due_date) == (dt.date(2024, 2, 5), dt.date(2024, 2, 5), dt.date(2024, 2, 19))
    assert [(i.description, i.quantity, i.total) for i in got.line_items] == [
        ("śruba", 2, Decimal("20.00")), ("nakrętka", 3, Decimal("3000.00")),
    ]
    assert (got.total_net, got.total_vat, got.total_gross) == (Decimal("2455.28"), Decimal("564.72"), Decimal("3020.00"))
    assert (got.currency, got.payment_method, got.payment_status) == ("PLN", dims.CARD, dims.UNPAID)


def test_section_can_restart_at_a_repeated_header(spark):
    lines = spark.createDataFrame([(TEXT.split("\n"),)], "l array<string>")
    marks = lines.withColumn("m", extract.table_marks(F.col("l")))
    ends = marks.withColumn("e", extract.table_end(F.col("m"), F.col("l")))
    got = ends.select(extract.table_section(F.col("l"), F.col("m"), F.col("e"), restart=True).alias("s")).first().s
    assert got == ["nakrętka  3  1 000,00  3 000,00"]


@pytest.mark.parametrize("lines, want", [
    (["5", "długi opis", "krótk", "7", "9", "NIP tekst", "4", "drugi opis", "trzeci opis", "8", "SUMA", "99"],
     [("długi opis", 9), ("trzeci opis", 8)]),
    (["opis bez liczby", "razem", "4"], []),
    ([], []),
])
def test_grouped_items(spark, lines, want):
    frame = spark.createDataFrame([(lines,)], "l array<string>")
    got = frame.select(extract.grouped_items(F.col("l")).alias("x")).first().x
    assert [(i.description, int(i.total)) for i in got] == want


def test_totals_follow_from_each_other(spark):
    row = spark.sql("select cast(123 as decimal(18,2)) g, cast(100 as decimal(18,2)) n, cast(23 as decimal(18,2)) v, cast(null as decimal(18,2)) z")
    c = F.col
    got = row.select(
        extract.totals(c("g"), c("z"), c("z")).alias("a"), extract.totals(c("z"), c("n"), c("v")).alias("b"),
        extract.totals(c("g"), c("n"), c("z")).alias("c"),
    ).first()
    for one in got:
        assert (one.gross, one.net, one.vat) == (Decimal("123.00"), Decimal("100.00"), Decimal("23.00"))


def test_stream_equals_batch(spark, folder):
    source, path = work_dir(spark, "source"), work_dir(spark, "saved")
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.repartition(4).write.parquet(source)
    state, totals, seen = (work_dir(spark, n) for n in ("state", "totals", "unique"))

    def stream():
        return feeds.arrivals(spark, source, feeds.EVENTS, files=1)

    feeds.save(stream(), path, state).awaitTermination()
    got = feeds.current(spark, path, feeds.EVENTS, ["user_id"], "event_id").select("user_id", "event_id")
    want = events.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    feeds.running_totals(stream(), totals, work_dir(spark, "state"), "event_type", "value").awaitTermination()
    once = events.groupBy("event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, feeds.current_totals(spark, totals).select("event_type", "n").collect())) == sorted(map(tuple, once.collect()))

    feeds.first_of_key(stream(), seen, work_dir(spark, "state"), "user_id", "ts", "3650 days").awaitTermination()
    keys = [r.user_id for r in spark.read.parquet(seen).collect()]
    assert len(keys) == len(set(keys)) == events.select("user_id").distinct().count()


def test_changes_leave_their_time(spark):
    base = spark.sql(
        "select x as invoice_id, 'u' as payment_status, cast(0 as decimal(18,2)) as paid_amount, cast(9 as decimal(18,2)) as total_gross, "
        "false as is_verified, timestamp'2020-01-01 00:00:00' as updated_at from values ('a'), ('b'), (null) t(x)"
    )
    at = "timestamp'2024-05-06 07:08:09'"
    later, old = dt.datetime(2024, 5, 6, 7, 8, 9), dt.datetime(2020, 1, 1)
    paid = changes.mark_paid(base, spark.sql(f"select 'a' as invoice_id, cast(null as decimal(18,2)) as amount, {at} as changed_at"))
    marked = changes.verify(base, spark.sql(f"select 'b' as invoice_id, false as verified, {at} as changed_at"))
    saved = changes.upsert(base, base.where("invoice_id = 'a'").withColumns({"change_seq": F.lit(1), "changed_at": F.expr(at)}))
    for rows, hit in ((paid, "a"), (marked, "b"), (saved, "a")):
        assert rows.columns == base.columns
        assert {r.invoice_id: r.updated_at for r in rows.collect()} == {x: later if x == hit else old for x in ("a", "b", None)}
    now = changes.verify(base, spark.sql("select 'b' as invoice_id, true as verified"))
    assert {r.invoice_id: r.updated_at > later for r in now.collect()} == {"a": False, "b": True, None: False}
    without = changes.mark_paid(base.drop("updated_at"), spark.sql("select 'a' as invoice_id, cast(1 as decimal(18,2)) as amount"))
    assert "updated_at" not in without.columns and without.where("paid_amount = 1").count() == 1
