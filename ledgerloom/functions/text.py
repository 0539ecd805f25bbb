"""Text cleaning, numbers, labels and positions as Column expressions over whole texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Glyphs dropped from recognised text, characters mistaken for digits between digits.
GLYPHS = "[←→↑↓■□▪▫◆◇○●]"
CONFUSED = {"l": "1", "O": "0", "S": "5", "Z": "2", "|": "I", "!": "1", "@": "a", "#": "H"}
DAY_LIKE = r"\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}"
NUMBER = r"\d{1,3}(?: \d{3})+(?:,\d{2})?|\d{1,3}(?:\.\d{3})+(?:,\d{2})?|\d{1,3}(?:,\d{3})+(?:\.\d{2})?|\d+(?:[.,]\d+)?"
BLANKS = " \t\r\n\f\u000b "


def java_literal(text: str) -> str:
    """A literal as a Java regular expression."""
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", text)


def clean_text(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), GLYPHS, "")
    for wrong, right in CONFUSED.items():
        out = F.regexp_replace(out, rf"(?<=\d){java_literal(wrong)}(?=\d)", right)
    return F.trim(out)


def number_value(token: Column) -> Column:
    """Value of a number token: the last separator decides what is decimal."""
    return F.transform(F.array(F.replace(token, F.lit(" "), F.lit(""))), _plain_value)[0]  # blanks go once


def _plain_value(plain: Column) -> Column:
    has_comma, has_dot = F.contains(plain, F.lit(",")), F.contains(plain, F.lit("."))
    comma_last = F.length(F.substring_index(plain, ",", -1)) < F.length(F.substring_index(plain, ".", -1))
    no_dot, no_comma = F.replace(plain, F.lit("."), F.lit("")), F.replace(plain, F.lit(","), F.lit(""))
    as_decimal = F.replace(plain, F.lit(","), F.lit("."))
    text = (
        F.when(has_comma & has_dot & comma_last, F.replace(no_dot, F.lit(","), F.lit(".")))
        .when(has_comma & has_dot, no_comma)
        .when(has_comma & plain.rlike(r"^[^,]*,[^,]{2}$"), as_decimal)
        .when(has_comma, no_comma)
        .when(plain.rlike(r"\..*\."), no_dot)
        .otherwise(plain)
    )
    return text.try_cast("decimal(38,6)")


def extract_numbers(text: Column) -> Column:
    """Numbers between 0 and ten million in text order, dates removed first."""
    tokens = F.regexp_extract_all(F.regexp_replace(text, DAY_LIKE, ""), F.lit(NUMBER), F.lit(0))
    found = F.filter(F.transform(tokens, number_value), lambda x: (x > 0) & (x < 10_000_000))
    return F.when(~text.rlike(r"\d"), F.expr("cast(array() as array<decimal(38,6)>)")).otherwise(found)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def text_lines(text: Column) -> Column:
    """Stripped lines without the empty ones."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


RUN = 128  # array elements that are folded at a time: appending copies what is there


def hits_sql(name: str, pattern: str) -> str:
    """SQL of ``array<struct<pos, raw>>``: every match of the pattern (SQL of a string) in the column with its 0-based
    character position.

    A position is the length of all before it. Sums over runs of ``RUN`` matches are folded one by one, then the runs are
    shifted by the sums before them, so the work follows the number of matches, not its square. There is one gap
    more than matches; it pairs with a missing match and adds nothing.
    """
    one = "struct<pos:int,raw:string>"

    def fold(pairs: str) -> str:
        return f"""aggregate({pairs}, named_struct('off', 0, 'out', cast(array() as array<{one}>)),
          (acc, s) -> case when s.raw is null then acc else named_struct(
            'off', acc.off + s.gap + length(s.raw),
            'out', array_append(acc.out, named_struct('pos', acc.off + s.gap, 'raw', s.raw))) end)"""

    runs = f"""transform(
          sequence(0, cast(ceil(size(every) / {RUN}) as int) - 1), i -> {fold(f"slice(every, i * {RUN} + 1, {RUN})")})"""
    return f"""
      transform(
        array(zip_with(
          regexp_extract_all({name}, {pattern}, 0), split({name}, {pattern}, -1),
          (raw, gap) -> struct(raw, length(gap) as gap))),
        every -> case when size(every) <= {RUN} then {fold("every")}.out else flatten(transform(
          aggregate(
            {runs},
            named_struct('base', 0, 'out', cast(array() as array<struct<base:int,hits:array<{one}>>>)),
            (acc, r) -> named_struct(
              'base', acc.base + r.off, 'out', array_append(acc.out, named_struct('base', acc.base, 'hits', r.out))),
            acc -> acc.out),
          r -> transform(r.hits, h -> named_struct('pos', r.base + h.pos, 'raw', h.raw)))) end)[0]"""


def regex_hits(name: str, pattern: str) -> Column:
    """``array<struct<pos, raw>>`` of a text column; empty without a match."""
    quoted = f"r'{pattern}'"
    hits = f"case when regexp_like({name}, {quoted}) then {hits_sql(name, quoted)} end"
    return F.expr(f"coalesce({hits}, cast(array() as array<struct<pos:int,raw:string>>))")


# Letters whose upper case is not that of the letter they match without regard to case.
ODD_CASE = ["\u0130", "\u212a"]


def may_hold(text: Column, upper: Column, words: list[str]) -> Column:
    """False only if none of the words can be found in the text without regard to case.

    Looking for bytes costs a small part of a pattern, so patterns that need one of the words ask this first.
    """
    out = F.lit(False)
    for word in words:
        out = out | F.contains(upper, F.lit(word.upper()))
    for letter in ODD_CASE:
        out = out | F.contains(text, F.lit(letter))
    return out


def opening(label: str) -> str:
    """A literal that no letter or digit stands before. It is read first, so that only its places look back."""
    return rf"{java_literal(label)}(?<!\w.{{{len(label)}}})"


def word(label: str) -> str:
    """A label as a whole word, any case."""
    return rf"(?iuU){opening(label)}(?!\w)"


def first_label(text: Column, labels: list[str]) -> Column:
    """0-based position of the first of the labels, each matched as a whole word; -1 if none."""
    found = F.array(*[F.regexp_instr(text, F.lit(word(label))) for label in labels])
    first = F.array_min(F.filter(found, lambda p: p > 0))
    return F.coalesce(first - 1, F.lit(-1))


def value_after(text: Column, low: Column, labels: list[str], reach: int = 50) -> Column:
    """First line of the text after the first present label, without a leading colon."""

    def after(label: str) -> Column:
        pos = F.instr(low, label.lower())
        near = strip(F.substr(text, pos + len(label), F.lit(reach)))
        near = F.when(near.startswith(":"), strip(F.substr(near, F.lit(2)))).otherwise(near)
        return F.when(pos > 0, strip(F.split(near, "\n")[0]))

    return F.coalesce(*[after(label) for label in labels])


def first_match(text: Column, patterns: list[str], group: int = 1, must: str | None = None) -> Column:
    """Group of the first pattern that matches; with ``must`` the first match that also fits it."""

    def one(pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        if must:
            found = F.filter(found, lambda x: x.rlike(must))
        return F.get(found, F.lit(0))

    return F.coalesce(*[one(p) for p in patterns])


def keyword_hits(upper: Column, words: list[str]) -> Column:
    """How many of the words the upper-case text contains."""
    return sum((F.contains(upper, F.lit(w.upper())).cast("int") for w in words), F.lit(0))


def longer_line(first: Column, second: Column) -> Column:
    """The longer of two lines; equal length: more letters and digits, then the first."""
    a, b = F.coalesce(first, F.lit("")), F.coalesce(second, F.lit(""))
    alnum_a = F.length(F.regexp_replace(a, r"[^\p{L}\p{N}]", ""))
    alnum_b = F.length(F.regexp_replace(b, r"[^\p{L}\p{N}]", ""))
    take_b = (F.length(b) > F.length(a)) | ((F.length(b) == F.length(a)) & (alnum_b > alnum_a))
    return F.when(take_b, b).otherwise(a)


def merge_texts(first: Column, second: Column) -> Column:
    """Line-wise merge of two readings of a page."""
    lines = F.zip_with(F.split(first, "\n", -1), F.split(second, "\n", -1), longer_line)
    return F.array_join(lines, "\n")
