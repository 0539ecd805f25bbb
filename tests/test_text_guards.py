"""Guards that spare a search must never lose a hit."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.functions import dates, text
from ledgerloom.operators import extract


def test_dates_of_one_digit_are_still_found(spark):
    texts = ["01.02.2003", "1.02.2003", "01.2.2003", "01.02.20031.02.2004", "x 3-4 01-02-2003", "2003-02-01 2003.02.03", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    hits = dates.drop_repeats(dates.date_hits("t", F.lit("2005-01-01").cast("date")))
    got = {r.i: [(h.pos, h.date) for h in r.h] for r in frame.select("i", hits.alias("h")).collect()}
    day = datetime.date
    assert got[0] == [(0, day(2003, 2, 1))] == got[1] == got[2]
    assert got[3] == [(0, day(2003, 2, 1)), (10, day(2004, 2, 1))]
    assert got[4] == [(6, day(2003, 2, 1))] and [d for _, d in got[5]] == [day(2003, 2, 1), day(2003, 2, 3)]
    assert got[6] == got[7] == []


def test_words_of_odd_case(spark):
    rows = [("podatek: 12,00",), ("PODATEK: 12,00",), ("ZALİCZKA: 12,00",), ("zalıczka: 12,00",), ("vat 3",), (None,)]
    frame = spark.createDataFrame(rows, "text string")
    upper = F.upper("text")
    for words in (dims.VAT_LABELS, dims.ADVANCE_LABELS):
        plain = F.lit(False)
        for w in words:
            plain = plain | F.col("text").rlike(text.word(w))
        out = frame.select(text.may_hold(F.col("text"), upper, words).alias("may"), plain.alias("is")).collect()
        assert all(r.may for r in out if r["is"]) and any(r["is"] for r in out)
    got = [r.v for r in frame.select(extract.amount_after(F.col("text"), upper, dims.VAT_LABELS).alias("v")).collect()]
    assert [None if v is None else float(v) for v in got] == [12.0, 12.0, None, None, 3.0, None]


def test_name_of_each_language(spark):
    rows = [("Polski", ["SPRZEDAWCA:", "Firma A"]), ("Niemiecki", ["VERKÄUFER: Firma B"]), (None, ["Sprzedawca", "Firma C"]), ("Angielski", ["SPRZEDAWCA:", "Firma D"])]
    frame = spark.createDataFrame(rows, "language string, lines array<string>")
    got = [r.n for r in frame.select(extract.company_name(F.col("lines"), "seller").alias("n")).collect()]
    assert got == ["Firma A", "Firma B", "Firma C", None]


def test_payment_words(spark):
    rows = [("zapłacono gotówką",), ("nie zapłacono, Karta",), ("unpaid, deposit by transfer",), ("Zalıczka; KARTA",), ("",)]
    frame = spark.createDataFrame(rows, "t string")
    upper = F.upper("t")
    got = frame.select(extract.payment_method(F.col("t"), upper).alias("m"), extract.payment_status(F.col("t"), upper).alias("s")).collect()
    assert [r.m for r in got] == [dims.CASH, dims.CARD, dims.TRANSFER, dims.CARD, dims.TRANSFER]
    assert [r.s for r in got] == [dims.PAID, dims.UNPAID, dims.PART_PAID, dims.PART_PAID, dims.UNPAID]
