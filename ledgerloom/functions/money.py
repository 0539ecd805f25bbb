"""Amount parsing, formatting and tax arithmetic as Column expressions on decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.dims import (
    CURRENCY_SYMBOL, DECIMAL_SEP, DEFAULT_LANGUAGE, DEFAULT_RATE, REVERSE_CHARGE, REVERSE_NOTE, THOUSAND_SEP,
)

MONEY = "decimal(18,2)"
AMOUNT = r"\d{1,3}(?:[.,  ]\d{3})+(?:[.,]\d{1,2})?(?!\d)|\d+(?:[.,]\d{1,2})?(?!\d)|\d+"
CURRENCY_WORDS = r"(?iu)zł|PLN|€|EUR|\$|USD|GBP|CZK|lei|RON"  # fixed values


def by_language(language: Column, values: dict[str, str]) -> Column:
    """The value of a language; an unknown or missing language reads as the default one."""
    chosen = None
    for name, value in values.items():
        chosen = F.when(language == name, value) if chosen is None else chosen.when(language == name, value)
    return chosen.otherwise(values[DEFAULT_LANGUAGE])


def amount_value(token: Column) -> Column:
    """Value of one amount token: one or two digits after the last separator are decimals."""
    cents = F.regexp_extract(token, r"[.,](\d{1,2})$", 1)
    whole = F.regexp_replace(F.regexp_replace(token, r"[.,]\d{1,2}$", ""), r"\D", "")
    return F.concat(whole, F.lit("."), F.rpad(cents, 2, "0")).try_cast(MONEY)


def _localized(token: Column, decimal: str, thousand: str) -> Column:
    """Value of a number written with the separators of one language.

    A separator before exactly three digits groups if it isn't the decimal one; the decimal one takes any number of
    decimals (rounded to cents); the other one takes one or two at the end.
    """
    other = "." if decimal == "," else ","
    plain = F.regexp_replace(token, r"[\s\u00a0]", "")
    plain = F.regexp_replace(plain, rf"[{other}](?=\d{{3}}(?!\d))", "")
    plain = F.regexp_replace(plain, rf"[{other}](\d{{1,2}})$", rf"{decimal}$1")
    cents = F.regexp_extract(plain, rf"[{decimal}](\d+)$", 1)
    whole = F.regexp_replace(F.regexp_replace(plain, rf"[{decimal}]\d+$", ""), r"\D", "")
    return F.concat(whole, F.lit("."), F.rpad(cents, 6, "0")).try_cast("decimal(24,6)").cast(MONEY)


NUMBER = r"\d+(?:[.,  ]\d+)*"


def parse_amount(text: Column, language: Column | None = None) -> Column:
    """First amount of a text, currency words removed; NULL when there is none.

    With a language the number is read with its separators, else the last separator before one or two digits is
    the decimal one.
    """
    if language is not None:
        number = F.regexp_extract(F.regexp_replace(text, CURRENCY_WORDS, ""), f"({NUMBER})", 1)
        values = {name: _localized(number, DECIMAL_SEP[name], THOUSAND_SEP[name]) for name in DECIMAL_SEP}
        return F.when(number != "", by_language(language, values))
    token = F.regexp_extract(F.regexp_replace(text, CURRENCY_WORDS, ""), f"({AMOUNT})", 1)
    return F.when(token != "", amount_value(token))


def vat_of(net: Column, rate: Column) -> Column:
    """Tax on a net amount, rounded half up."""
    return F.round(net * rate / 100, 2).cast(MONEY)


def format_amount(amount: Column, language: Column) -> Column:
    """Two decimals, separators and symbol of the language."""
    plain = F.format_number(amount, 2)
    marked = F.translate(plain, ",.", "\u0001\u0002")
    text = F.replace(
        F.replace(marked, F.lit("\u0001"), by_language(language, THOUSAND_SEP)),
        F.lit("\u0002"),
        by_language(language, DECIMAL_SEP),
    )
    return F.concat(text, F.lit(" "), by_language(language, CURRENCY_SYMBOL))


def reverse_charge(net: Column, country: Column) -> Column:
    """Struct applicable, net, vat, gross, note: no tax for the listed countries, else the default rate."""
    applies = F.coalesce(country.isin(REVERSE_CHARGE), F.lit(False))
    vat = F.when(applies, F.lit(0).cast(MONEY)).otherwise(vat_of(net, F.lit(DEFAULT_RATE)))
    return F.struct(
        applies.alias("applicable"),
        net.alias("net"),
        vat.alias("vat"),
        (net + vat).cast(MONEY).alias("gross"),
        F.when(applies, REVERSE_NOTE).alias("note"),
    )


def item_net(total: Column, rate: Column) -> Column:
    """Net part of a gross item total, rounded once."""
    return F.round(total / (1 + F.coalesce(rate, F.lit(DEFAULT_RATE)) / 100), 2).cast(MONEY)
