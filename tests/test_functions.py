"""Literal cases of the Column functions."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import checksum, dates, labels, money, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None else kind(v)}" for k, v in values.items())
    row = spark.createDataFrame([tuple(values.values())], schema)
    return row.select(column.alias("x")).first().x


def kind(value):
    return {str: "string", int: "int", Decimal: "decimal(18,2)", dt.date: "date", float: "double"}[type(value)]


@pytest.mark.parametrize("nip, ok", [
    ("7530011446", True), ("753-001-14-46", True), ("7530011447", False), ("753001144", False), ("", False), (None, False),
])
def test_nip(spark, nip, ok):
    assert one(spark, checksum.nip_valid(F.col("t")), t=nip) is ok


def cui(value):
    d = "".join(c for c in value if c.isdigit())
    if not 2 <= len(d) <= 10:
        return False
    if len(d) == 10:
        return True
    rest = sum(int(a) * int(b) for a, b in zip(d[:-1], "753217532")) * 10 % 11 % 10
    return rest == int(d[-1])


@pytest.mark.parametrize("value", ["1", "12", "18", "RO 123", "1234567", "14399840", "159071543", "1234567890", "12345678901"])
def test_cui(spark, value):
    assert one(spark, checksum.cui_valid(F.col("t")), t=value) is cui(value)


@pytest.mark.parametrize("iban, ok", [
    ("PL61109010140000071219812874", True), ("PL61109010140000071219812875", False), ("PL6110901014000007121981287", False),
    ("pl61 1090 1014 0000 0712 1981 2874", True), ("DE89370400440532013000", True), ("GB82WEST12345698765432", True),
    ("XX00", False), ("", False),
])
def test_iban(spark, iban, ok):
    assert one(spark, checksum.iban_valid(F.col("t")), t=iban) is ok


def test_accounts(spark):
    value = "Konto: PL61 1090 1014 0000 0712 1981 2874\nlub 61109010140000071219812874, PL00109010140000071219812874"
    assert one(spark, checksum.bank_accounts(F.col("t")), t=value) == ["PL61 1090 1014 0000 0712 1981 2874"]


@pytest.mark.parametrize("value, amount", [
    ("1 234,56 zł", "1234.56"), ("1.234,56 EUR", "1234.56"), ("1,234.56 $", "1234.56"), ("1234,56", "1234.56"), ("12", "12.00"),
    ("abc", None), ("RON 5.5", "5.50"), ("1.234.567,8", "1234567.80"),
])
def test_parse_amount(spark, value, amount):
    got = one(spark, money.parse_amount(F.col("t")), t=value)
    assert got == (Decimal(amount) if amount else None)


@pytest.mark.parametrize("value, language, amount", [
    ("1 234,56 zł", "Polski", "1234.56"), ("1234,567", "Polski", "1234.57"), ("12.345", "Polski", "12345.00"),
    ("1.234,56 zł", "Polski", "1234.56"), ("12.34", "Polski", "12.34"), ("12.345", "Niemiecki", "12345.00"),
    ("1.234.567,8 €", "Niemiecki", "1234567.80"), ("12.345", "Angielski", "12.35"), ("1,234.5 $", "Angielski", "1234.50"),
    ("12,345", "Angielski", "12345.00"), ("12,34", "Angielski", "12.34"), ("abc", "Polski", None), ("7", None, "7.00"),
])
def test_parse_amount_of_a_language(spark, value, language, amount):
    got = one(spark, money.parse_amount(F.col("t"), F.lit(language).cast("string")), t=value)
    assert got == (Decimal(amount) if amount else None)


def test_sql_functions_agree_with_the_columns(spark):
    checksum.register_sql(spark)
    ids = ["7530011446", "753-001-14-46", "1", "12", "18547290", "1854729", "123456789", "1234567890", "", None, "RO 18547290", "99"]
    ibans = ["PL61109010140000071219812874", "pl61 1090 1014 0000 0712 1981 2874", "PL61109010140000071219812875", "DE89370400440532013000", "XX00", "", None]
    frame = spark.createDataFrame([(i,) for i in ids + ibans], "t string")
    for name, column in (("nip_valid", checksum.nip_valid), ("cui_valid", checksum.cui_valid), ("iban_valid", checksum.iban_valid)):
        rows = frame.select("t", F.expr(f"{name}(t)").alias("sql"), column(F.col("t")).alias("col")).collect()
        assert [r.sql for r in rows] == [r.col for r in rows] and any(r.sql for r in rows)


def test_vat_rounds_half_up(spark):
    assert one(spark, money.vat_of(F.col("n"), F.lit(Decimal("12.50"))), n=Decimal("1.00")) == Decimal("0.13")
    assert one(spark, money.vat_of(F.col("n"), F.lit(23)), n=Decimal("-10.00")) == Decimal("-2.30")


@pytest.mark.parametrize("language, shown", [
    ("Polski", "1 234 567,80 zł"), ("Niemiecki", "1.234.567,80 €"), ("Angielski", "1,234,567.80 $"), ("Klingon", "1 234 567,80 zł"),
])
def test_format_amount(spark, language, shown):
    assert one(spark, money.format_amount(F.col("n"), F.col("l")), n=Decimal("1234567.80"), l=language) == shown


@pytest.mark.parametrize("value, day", [
    ("18.11.2025", dt.date(2025, 11, 18)), ("1.11.2025", dt.date(2025, 11, 1)), ("18/11/2025", dt.date(2025, 11, 18)),
    ("2025-11-20", dt.date(2025, 11, 20)), ("31-02-2025 i 1-03-2025", dt.date(2025, 3, 1)), ("1.1.1989", None),
    ("5 6 2024", dt.date(2024, 6, 5)), ("brak", None),
])
def test_parse_date(spark, value, day):
    assert one(spark, dates.parse_date(F.col("t"), F.lit("2025-06-01").cast("date")), t=value) == day


def hits(spark, value):
    today = F.lit("2025-06-01").cast("date")
    rows = spark.createDataFrame([(value,)], "t string")
    rows = rows.withColumn("h", dates.drop_repeats(dates.date_hits("t", today))).withColumn("low", F.lower("t"))
    return rows


def test_date_hits_have_positions(spark):
    got = hits(spark, "a 18.11.2024, 2024-11-20 i 31.02.2024; 1.2.2024").first().h
    assert [(h.pos, h.date) for h in got] == [
        (2, dt.date(2024, 11, 18)), (14, dt.date(2024, 11, 20)), (39, dt.date(2024, 2, 1)),
    ]


@pytest.mark.parametrize("value, day", [
    ("01.02.2024 Due date", dt.date(2024, 2, 1)),
    ("Due date 01.02.2024 Due date 02.02.2024", dt.date(2024, 2, 1)),
    ("03.02.2024 due date 04.02.2024", dt.date(2024, 2, 4)),
    ("due date" + " " * 400 + "pay by 05.02.2024", dt.date(2024, 2, 5)),
    ("due date" + " " * 400 + "due date 06.02.2024", dt.date(2024, 2, 6)),
    ("nothing 01.02.2024", None),
])
def test_date_near_label(spark, value, day):
    found = hits(spark, value).select(dates.near_label("low", "h", ["DUE DATE", "PAY BY"]).alias("x"))
    assert found.first().x == day


def test_date_repair(spark):
    row = spark.sql("select date'2024-01-10' i, date'2024-05-10' s, date'2024-01-01' d")
    got = row.select(dates.repair_dates(F.col("i"), F.col("s"), F.col("d"), F.lit(None).cast("date"), F.current_date()).alias("x")).first().x
    assert (got.issue, got.sale, got.due) == (dt.date(2024, 1, 10), dt.date(2024, 1, 10), dt.date(2024, 1, 24))


def test_clean_text(spark):
    assert one(spark, text.clean_text(F.col("t")), t=" 1l2  ■x\n5O6 7S8 a|b 1|2 3!4 l0 ") == "112 x 506 758 a|b 1I2 314 l0"


def test_numbers_keep_text_order(spark):
    got = one(spark, text.extract_numbers(F.col("t")), t="x 12  1 234,56 z 1.234,56 1,234.56 7.5 18.11.2025; 0; 99999999")
    assert [float(x) for x in got] == [12, 1234.56, 1234.56, 1234.56, 7.5]


def test_merge_texts(spark):
    got = one(spark, text.merge_texts(F.col("a"), F.col("b")), a="abc\n12.\nx", b="ab\n123\nyy\nzz")
    assert got == "abc\n123\nyy\nzz"


def test_status_order(spark):
    row = spark.sql("select array('e') e, array('w','v') w, array() n, 0.7D c")
    shown = row.select(
        labels.invoice_status(F.lit(True), F.col("e"), F.col("w"), F.col("c")).alias("a"),
        labels.invoice_status(F.lit(False), F.col("e"), F.col("w"), F.col("c")).alias("b"),
        labels.invoice_status(F.lit(False), F.col("n"), F.col("w"), F.col("c")).alias("d"),
        labels.invoice_status(F.lit(False), F.col("n"), F.col("n"), F.col("c")).alias("f"),
        labels.invoice_status(F.lit(False), F.col("n"), F.col("n"), F.lit(0.9)).alias("g"),
    ).first()
    assert list(shown) == ["🔄 Duplikat", "❌ 1 błędów", "⚠️ 2 ostrzeżeń", "❓ Niska pewność", "✅ OK"]
