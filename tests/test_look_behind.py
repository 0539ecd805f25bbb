"""Patterns that look back do so behind their first sign, with the same matches."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.functions import dates, text
from ledgerloom.operators import extract

TEXTS = [
    "SELLER: a", "xSELLER: a", "_seller b", "ß seller\nto: bill to", "łTO to", "TO", "RESELLER seller", "\U0001d400SELLER", "sELLER!",
    "1234567890", "x1234567890x", "12345678901", "0 1234567890 12345678901 2234567890", "123-456-78-90", "9123-456-78-90 123 456 78 90",
    "11.1.2020", "1.1.2020", "x1.12.2020", "01.1.20201", "12345.6", "", None,
]


def _same(spark, plain: str, quick: str) -> None:
    assert plain != quick
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").orderBy("i")
    for p in [(plain, quick)]:
        for r in frame.select("t", *[F.regexp_extract_all("t", F.lit(x), F.lit(0)).alias(n) for n, x in zip("ab", p, strict=True)],
                              *[(F.regexp_instr("t", F.lit(x))).alias(n) for n, x in zip("cd", p, strict=True)]).collect():
            assert r.a == r.b and r.c == r.d, r


def test_labels(spark):
    for labels in [w for lang in dims.LANGUAGES for w in dims.KEYWORDS[lang].values()]:
        literal = "|".join(map(text.java_literal, labels))
        _same(spark, rf"(?iuU)(?<!\w)(?:{literal})(?!\w)", extract._words(labels))
    _same(spark, r"(?iuU)(?<!\w)SELLER(?!\w)", text.word("SELLER"))


def test_tax_ids(spark):
    behind = [p for p in dims.TAX_ID_PATTERNS if p.startswith(r"(?<!\d)")]
    assert len(behind) == 2
    for p in behind:
        _same(spark, p, extract._digit_first(p))
    assert all(extract._digit_first(p) == p for p in dims.TAX_ID_PATTERNS if p not in behind)


def test_short_dates(spark):
    plain = r"(?<!\d)\d\.\d{1,2}\.\d{4}|\d\.\d\.\d{4}|\d{5}\.\d"
    assert not re.match(r"\(\?<!", dates.SHORT_DATE)
    frame = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert frame.where(~F.col("t").rlike(plain).eqNullSafe(F.col("t").rlike(dates.SHORT_DATE))).count() == 0
