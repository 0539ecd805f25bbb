"""Date hits in text, label lookup, repair and formatting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.dims import DATE_FORMAT, DATE_HITS, DATE_LABELS
from ledgerloom.functions.money import by_language
from ledgerloom.functions.text import hits_sql, java_literal, regex_hits

FIRST_DAY = "1990-01-01"
NO_DATE = "Brak daty"


def parse_date(text: Column, as_of: Column) -> Column:
    """First valid date of a text: day first, year first, then space separated; at most a year ahead."""
    families = [
        (r"\d{1,2}[\.\-/]\d{1,2}[\.\-/]\d{4}", "d-M-yyyy"),
        (r"\d{4}[\.\-/]\d{1,2}[\.\-/]\d{1,2}", "yyyy-M-d"),
        (r"\d{1,2}\s+\d{1,2}\s+\d{4}", "d-M-yyyy"),
    ]  # fixed values
    last_day = F.date_add(as_of, 365)

    def first(pattern: str, fmt: str) -> Column:
        raw = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        days = F.transform(raw, lambda r: F.try_to_date(F.translate(r, "/. ", "---"), fmt))
        return F.get(F.filter(days, lambda d: d.between(F.lit(FIRST_DAY).cast("date"), last_day)), F.lit(0))

    return F.coalesce(*[first(p, f) for p, f in families])


def date_hits(text: str, as_of: Column) -> Column:
    """Valid dates of a text column with positions, ``array<struct<pat, pos, date>>`` in pattern and text order.

    The last pattern is left out where each of its matches is one of the first pattern, at the same place.
    """
    last_day = F.date_add(as_of, 730)

    def hits(n: int, pattern: str, fmt: str) -> Column:
        def dated(h: Column) -> Column:
            day = F.try_to_date(F.translate(h["raw"], "/.", "--"), fmt)
            return F.struct(F.lit(n).alias("pat"), h["pos"].alias("pos"), day.alias("date"))

        return F.transform(regex_hits(text, pattern), dated)

    found = [hits(n, pattern, fmt) for n, (pattern, fmt) in enumerate(DATE_HITS)]
    none = F.expr("cast(array() as array<struct<pat:int,pos:int,date:date>>)")
    found = [
        found[0], F.when(F.col(text).rlike(RARE_DATE), F.concat(*found[1:-1])).otherwise(none),
        F.when(F.col(text).rlike(SHORT_DATE), found[-1]).otherwise(none),
    ]
    return F.filter(F.concat(*found), lambda h: h["date"].between(F.lit(FIRST_DAY).cast("date"), last_day))


# What a text must hold for the patterns between the first and the last, and for a date that only the last finds.
RARE_DATE = r"\d{2}[-/]\d{2}[-/]\d{4}|\d{4}[-.]\d{2}[-.]\d{2}"
SHORT_DATE = r"\d(?<!\d\d)\.\d{1,2}\.\d{4}|\d\.\d\.\d{4}|\d{5}\.\d"

NEAR = 5  # characters within which hits of one date are the same
TOGETHER = 32  # hits, or clusters of near hits, that are folded at a time


def drop_repeats(hits: Column) -> Column:
    """Keeps a hit unless an earlier kept one has the same date less than ``NEAR`` characters away.

    Earlier means in pattern and text order. Only hits of one cluster, with no gap of ``NEAR`` between neighbours, can
    meet, so the hits are sorted by place, cut between clusters and folded in pieces: the work follows their number.
    """

    def fold(piece: Column) -> Column:
        return F.aggregate(
            F.array_sort(F.transform(piece, lambda h: F.struct(h["pat"].alias("pat"), h["pos"].alias("pos"), h["date"].alias("date")))),
            F.expr("cast(array() as array<struct<pat:int,pos:int,date:date>>)"),
            lambda acc, h: F.when(
                F.exists(acc, lambda k: (k["date"] == h["date"]) & (F.abs(k["pos"] - h["pos"]) < NEAR)), acc
            ).otherwise(F.array_append(acc, h)),
        )

    def pieces(places: Column) -> Column:
        opens = F.filter(
            F.sequence(F.lit(0), F.size(places) - 1),
            lambda i: (i == 0) | (F.get(places, i)["pos"] - F.get(places, i - 1)["pos"] >= NEAR),
        )
        starts = F.filter(opens, lambda i, n: n % TOGETHER == 0)
        return F.transform(
            F.array(starts),  # of one element, so that the starts are found once
            lambda at: F.transform(
                at, lambda start, n: F.slice(places, start + 1, F.coalesce(F.get(at, n + 1), F.size(places)) - start)
            ),
        )[0]

    def sorted_(found: Column) -> Column:
        return F.array_sort(F.transform(found, lambda h: F.struct(h["pos"].alias("pos"), h["pat"].alias("pat"), h["date"].alias("date"))))

    def cut(found: Column) -> Column:
        return F.flatten(F.flatten(F.transform(F.array(sorted_(found)), lambda placed: F.transform(pieces(placed), fold))))

    # one-element array: the hits are found once for both ways
    return F.transform(F.array(hits), lambda found: sorted_(F.when(F.size(found) <= TOGETHER, fold(found)).otherwise(cut(found))))[0]


def near_label(low: str, hits: str, labels: list[str], reach: int = 150) -> Column:
    """Date nearest to a label: first label, first occurrence with a date after it, else around it.

    ``low`` is the column of the lower-case text, ``hits`` that of its dates in text order. In a list of more than
    ``TOGETHER`` dates every occurrence finds those around it by halving the list, so it looks at its neighbours only.
    """
    # The number of hits before a position.
    def before(place: str) -> str:
        return (
            f"aggregate(sequence(1, greatest(1, cast(ceil(log2(size({hits}) + 1)) as int))), named_struct('a', 0, 'b', size({hits})), "
            f"(s, i) -> case when s.a >= s.b then s when get({hits}, (s.a + s.b) div 2).pos < {place} "
            "then named_struct('a', cast((s.a + s.b) div 2 + 1 as int), 'b', s.b) "
            "else named_struct('a', s.a, 'b', cast((s.a + s.b) div 2 as int)) end, s -> s.a)"
        )

    def nearest(near: str) -> str:
        return f"array_min(transform(filter(w, h -> {near}), h -> struct(abs(h.pos - k.pos) as dist, h.pos as pos, h.date as date)))"

    near = (
        f"transform(array({before(f'k.pos - {reach}')}), a -> slice({hits}, a + 1, "
        f"greatest(0, {before(f'k.pos + {reach} + 1')} - a)))[0]"
    )
    window = f"array(case when size({hits}) <= {TOGETHER} then {hits} else {near} end)"
    after, around = f"h.pos >= k.pos and h.pos <= k.pos + {reach}", f"abs(h.pos - k.pos) <= {reach}"
    best = f"transform({window}, w -> coalesce({nearest(after)}, {nearest(around)}))[0]"
    found = f"filter(transform({hits_sql(low, 'q.pattern')}, k -> {best}), x -> x is not null)"
    # One expression for all labels keeps the plan small; each is looked for only while none has a date.
    asked = ", ".join(f"named_struct('label', '{x.lower()}', 'pattern', r'{java_literal(x.lower())}')" for x in labels)
    return F.expr(
        f"aggregate(array({asked}), cast(null as date), (done, q) -> "
        f"case when done is null and contains({low}, q.label) then get({found}, 0).date else done end)"
    )


def label_dates(low: str, hits: str) -> Column:
    """Struct issue, sale, due before repair."""
    return F.struct(*[near_label(low, hits, labels).alias(role) for role, labels in DATE_LABELS.items()])


def repair_dates(issue: Column, sale: Column, due: Column, first_hit: Column, as_of: Column) -> Column:
    """Struct issue, sale, due: missing dates are filled, implausible ones replaced."""
    base = F.coalesce(issue, first_hit)
    base_or_now = F.coalesce(base, as_of)
    sale = F.coalesce(sale, base_or_now)
    due = F.coalesce(due, F.date_add(base_or_now, 14))
    return F.struct(
        base_or_now.alias("issue"),
        F.when(sale > F.date_add(base_or_now, 60), base_or_now).otherwise(sale).alias("sale"),
        F.when(due < base_or_now, F.date_add(base_or_now, 14)).otherwise(due).alias("due"),
    )


def format_day(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "dd.MM.yyyy"), F.lit(NO_DATE))


def format_day_in(day: Column, language: Column) -> Column:
    """First date format of the language."""
    styles = {style: F.date_format(day, style) for style in set(DATE_FORMAT.values())}
    return by_language(language, {name: styles[style] for name, style in DATE_FORMAT.items()})


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")
