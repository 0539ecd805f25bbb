"""Page features, cutting documents into invoices, interval clean-up and merging of page texts.

A document may hold a large share of all pages, so every step works on blocks of pages: running values are
taken within a block and carried over from block to block on one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.functions.text import keyword_hits, may_hold
from ledgerloom.memo import memo

BLOCK = 1 << 16  # pages whose marks one window may hold
MERGE_BLOCK = 256  # pages that meet their boundaries in one group


def _any_case(pattern: str) -> str:
    return "(?iu)" + pattern


def _per_language(values: dict[str, Column]) -> Column:
    chosen = None
    for name, value in values.items():
        test = F.col("language") == name
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    return chosen.otherwise(values[dims.DEFAULT_LANGUAGE])


@memo
def _feature_columns() -> list[dict[str, Column]]:
    text, upper = F.col("text"), F.col("upper")

    def held(pattern: str, words: list[str]) -> Column:
        """Whether the pattern is found; only texts that hold one of the words, if any are given, are searched."""
        hit = text.rlike(_any_case(pattern))
        return may_hold(text, upper, words) & hit if words else hit

    number = None
    index = None
    for i, pattern in enumerate(dims.PAGE_HEADERS):
        hit = held(pattern, dims.PAGE_HEADER_WORDS[i])
        index = F.when(hit, i) if index is None else index.when(hit, i)
        found = F.regexp_extract(text, _any_case(pattern + r"\s*([A-Z0-9/\-\.]+)"), 1)
        number = F.when(F.col("header") == i, found) if number is None else number.when(F.col("header") == i, found)
    starts = _per_language({k: keyword_hits(upper, v) for k, v in dims.START_KEYWORDS.items()})
    ends = _per_language({k: keyword_hits(upper, v) for k, v in dims.END_KEYWORDS.items()})
    indicators = sum(
        (held(p, ws).cast("int") for p, ws in zip(dims.TABLE_INDICATORS, dims.TABLE_INDICATOR_WORDS, strict=True)), F.lit(0)
    )
    summary = F.lit(False)
    for pattern, words in zip(dims.SUMMARY_PATTERNS, dims.SUMMARY_WORDS, strict=True):
        summary = summary | held(pattern, words)
    total = F.regexp_extract(text, _any_case(dims.TOTAL_TEXT), 1)
    points = sum(
        (F.when(F.col(c), p).otherwise(0) for c, p in (
            ("has_header", 30), ("start_keywords", 20), ("end_keywords", 15), ("has_items", 15),
            ("has_summary", 15), ("has_signature", 5),
        )),
        F.when(F.col("header_number").isNotNull(), 10).otherwise(0)
        + F.when(F.col("total_text").isNotNull(), 5).otherwise(0),
    )
    return [
        {
            "header": index,
            "start_keywords": starts >= 2,
            "end_keywords": ends >= 2,
            "has_items": (indicators >= 3) | (F.regexp_count(text, F.lit(dims.PRICE_LIKE)) >= 5),
            "has_summary": summary,
            "has_signature": held(dims.SIGNATURE, dims.SIGNATURE.split("|")),
        },
        {
            "has_header": F.col("header").isNotNull(),
            "header_number": F.when(number.rlike(r"\d"), number),
            "total_text": F.when(F.col("has_summary") & (total != ""), total),
        },
        {"page_confidence": F.least(F.lit(100), points) / F.lit(100.0)},
    ]


def page_features(pages: DataFrame) -> DataFrame:
    """Flags, header number, total text and confidence of every page; no shuffle."""
    out = pages.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("upper", F.upper("text"))
    for columns in _feature_columns():
        out = out.withColumns(columns)
    return out.drop("upper", "header")


def numeric_features(pages: DataFrame, text: str = "text") -> DataFrame:
    """Length, line breaks, digit runs and runs of capitals, for a boundary model of one's own."""
    t = F.col(text)
    return pages.withColumns(
        {
            "n_chars_seen": F.length(t),
            "n_lines": F.regexp_count(t, F.lit("\n")),
            "n_numbers": F.regexp_count(t, F.lit(r"\d+")),
            "n_caps": F.regexp_count(t, F.lit(r"[A-Z]{2,}")),
        }
    )


def failed_pages(pages: DataFrame) -> DataFrame:
    """Pages whose recognition ran out of time or failed; they stay in the table with confidence 0."""
    return pages.where(F.col("engine").isin("timeout", "error", "unknown_error"))


def _boundary(start: Column, end: Column, score: float, kind: str, number: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start_page"), end.cast("int").alias("end_page"),
        F.lit(score).alias("confidence"), F.lit(kind).alias("boundary_type"), number.alias("detected_number"),
    )


def segment(features: DataFrame, auto: bool = True, block: int = BLOCK) -> DataFrame:
    """Invoice boundaries per document.

    A start page closes the open invoice before itself, an end page closes it at itself, the last page of
    the document closes what is left. Each of these three pages looks back for the mark before it.
    """
    if not auto:
        whole = features.groupBy("doc_id").agg(F.max("page_no").alias("n"))
        none = F.lit(None).cast("string")
        return whole.select("doc_id", _boundary(F.lit(1), F.col("n"), 1.0, "SINGLE", none).alias("b")).select("doc_id", "b.*")

    starts = F.col("has_header") | (F.col("start_keywords") & (F.col("page_confidence") > 0.5))
    ends = F.col("end_keywords") | F.col("has_signature")
    kind = F.when(starts, "S").when(ends, "E")
    rows = features.select("doc_id", "page_no", kind.alias("kind"), F.col("header_number").alias("number")).withColumn(
        "block", F.expr(f"(page_no - 1) div {block}")
    )
    mark = F.when(F.col("kind").isNotNull(), F.struct("page_no", "kind", "number"))
    opened = F.when(F.col("kind") == "S", F.col("page_no"))

    inside = Window.partitionBy("doc_id", "block").orderBy("page_no")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    seen = (
        rows.withColumns(
            {
                "before": F.last(mark, ignorenulls=True).over(ahead),
                "at": F.last(mark, ignorenulls=True).over(upto),
                "start_seen": F.last(opened, ignorenulls=True).over(upto),
                "tail": F.lead("page_no").over(inside).isNull(),
            }
        )
        .where(F.col("kind").isNotNull() | F.col("tail"))
        .withColumn("edge", F.col("tail") | (F.col("kind").isNotNull() & F.col("before").isNull()))
        .withColumn("lane", F.when(F.col("edge"), F.lit(-1)).otherwise(F.col("block")))
    )

    # Only the edges of blocks meet here: the first mark and the last page of each block of a document.
    across = Window.partitionBy("doc_id", "lane").orderBy("page_no")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.withColumns(
        {
            "carry": F.last("at", ignorenulls=True).over(earlier),
            "carry_start": F.last("start_seen", ignorenulls=True).over(earlier),
            "final": F.lead("page_no").over(across).isNull() & F.col("tail"),
        }
    )
    edge = F.col("edge")
    known = carried.withColumns(
        {
            "before": F.coalesce("before", F.when(edge, F.col("carry"))),
            "at": F.coalesce("at", F.when(edge, F.col("carry"))),
            "start_seen": F.coalesce("start_seen", F.when(edge, F.col("carry_start"))),
        }
    )
    page, before, at = F.col("page_no"), F.col("before"), F.col("at")
    open_before = before["kind"] == "S"
    none = F.lit(None).cast("string")
    single = F.col("final") & (page == 1)
    found = F.array(
        F.when(single, _boundary(F.lit(1), F.lit(1), 1.0, "SINGLE", none)),
        F.when(
            (F.col("kind") == "S") & open_before,
            _boundary(before["page_no"], page - 1, 0.8, "MULTI_PAGE", before["number"]),
        ),
        F.when(
            (F.col("kind") == "E") & open_before,
            _boundary(before["page_no"], page, 0.9, "STANDARD", before["number"]),
        ),
        F.when(
            F.col("final") & ~single & (at["kind"] == "S"),
            _boundary(at["page_no"], page, 0.7, "INCOMPLETE", at["number"]),
        ),
        F.when(
            F.col("final") & ~single & F.col("start_seen").isNull(), _boundary(F.lit(1), page, 0.5, "UNKNOWN", none)
        ),
    )
    return (
        known.select("doc_id", F.explode_outer(found).alias("b")).where(F.col("b").isNotNull()).select("doc_id", "b.*")
    )


def _running_max(rows: DataFrame, value: Column, name: str, inclusive: bool, block: int) -> DataFrame:
    """Greatest value over the intervals of a document up to (or before) each start."""
    valued = rows.withColumn("_v", value).withColumn("_block", F.expr(f"start_page div {block}"))
    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy("doc_id", "_block").orderBy("start_page").rowsBetween(Window.unboundedPreceding, end)
    sums = valued.groupBy("doc_id", "_block").agg(F.max("_v").alias("_m"))
    earlier = Window.partitionBy("doc_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("doc_id", "_block", F.max("_m").over(earlier).alias("_carry"))
    local = valued.withColumn("_local", F.max("_v").over(inside))
    return (
        local.join(carry, ["doc_id", "_block"])
        .withColumn(name, F.greatest("_local", "_carry"))
        .drop("_v", "_block", "_local", "_carry")
    )


def clean_intervals(boundaries: DataFrame, block: int = BLOCK) -> DataFrame:
    """Drops empty intervals and merges overlapping ones; each merge costs a tenth of the confidence."""
    first = F.struct("end_page", -F.col("confidence"))
    starts = (
        boundaries.where(F.col("end_page") >= F.col("start_page"))
        .groupBy("doc_id", "start_page")
        .agg(
            F.max("end_page").alias("end_page"), F.min_by("confidence", first).alias("confidence"),
            F.count("*").alias("n"),
        )
    )
    reached = _running_max(starts, F.col("end_page"), "reach", False, block)
    opens = F.when(F.col("reach").isNull() | (F.col("start_page") > F.col("reach")), F.col("start_page"))
    island = _running_max(reached, opens, "island", True, block)
    return island.groupBy("doc_id", F.col("island").alias("start_page")).agg(
        F.max("end_page").alias("end_page"),
        (F.min_by("confidence", "start_page") * F.pow(F.lit(0.9), F.sum("n") - 1)).alias("confidence"),
        F.sum("n").alias("merged"),
    )


def merge_pages(pages: DataFrame, boundaries: DataFrame, block: int = MERGE_BLOCK) -> DataFrame:
    """The text of each boundary: its non-empty pages in order, joined by the page-break mark; the language is that
    of the first of them.

    Pages and boundaries meet on (document, block of pages), so page texts are shuffled once and a large
    document spreads over many groups. Only invoices that cross a block edge are put together again.
    """
    keys = ["doc_id", "start_page", "end_page"]
    spans = boundaries.withColumns(
        {
            "first_block": F.expr(f"(start_page - 1) div {block}"),
            "last_block": F.expr(f"(end_page - 1) div {block}"),
        }
    )
    rest = [c for c in boundaries.columns if c not in keys]
    carried = F.struct(*rest) if rest else F.struct(F.lit(None).alias("none"))
    placed = spans.select(
        *keys, carried.alias("info"), (F.col("first_block") < F.col("last_block")).alias("crosses"),
        F.explode_outer(F.sequence("first_block", "last_block")).alias("block"),
    )
    texts = pages.where(F.coalesce("text", F.lit("")) != "").select(
        "doc_id", "page_no", "text", "language", F.expr(f"(page_no - 1) div {block}").alias("block")
    )
    page = F.struct("page_no", "text")

    def pieces(crosses: bool) -> DataFrame:
        side = placed.where(F.col("crosses") == crosses).drop("crosses")
        met = texts.join(side, ["doc_id", "block"]).where(F.col("page_no").between(F.col("start_page"), F.col("end_page")))
        return met.groupBy("doc_id", "block", "start_page", "end_page").agg(
            F.collect_list(page).alias("parts"), F.first("info").alias("info"),
            F.min(F.struct("page_no", "language")).alias("first"),
        )

    crossing = (
        pieces(True)
        .groupBy(*keys)
        .agg(F.flatten(F.collect_list("parts")).alias("parts"), F.first("info").alias("info"), F.min("first").alias("first"))
    )
    every = pieces(False).drop("block").unionByName(crossing)
    text = F.array_join(F.transform(F.array_sort("parts"), lambda p: p["text"]), dims.PAGE_BREAK)
    named = every.select(*keys, text.alias("text"), "first.language", "info")
    return named.select(*keys, "text", "language", *[F.col(f"info.{c}").alias(c) for c in rest])


def segmentation_summary(boundaries: DataFrame) -> DataFrame:
    """Counts per document and the list of issues; messages are fixed values."""
    out = boundaries.groupBy("doc_id").agg(
        F.count("*").alias("total_invoices"),
        F.count_if(F.col("confidence") < 0.6).alias("low"),
        F.count_if(F.col("boundary_type") == "INCOMPLETE").alias("incomplete"),
        (F.count("detected_number") > F.countDistinct("detected_number")).alias("repeated"),
    )
    issues = F.array(
        F.when(
            F.col("low") > 0,
            F.concat(F.lit("Wykryto "), F.col("low"), F.lit(" faktur z niską pewnością (<60%)")),
        ),
        F.when(
            F.col("incomplete") > 0,
            F.concat(F.lit("Wykryto "), F.col("incomplete"), F.lit(" potencjalnie niekompletnych faktur")),
        ),
        F.when(F.col("repeated"), "Wykryto duplikaty numerów faktur"),
    )
    return out.withColumn("issues", F.filter(issues, lambda i: i.isNotNull()))


@memo
def _language_scores() -> Column:
    text, upper = F.col("text"), F.col("upper")
    scores = []
    for i, name in enumerate(dims.LANGUAGES):
        words = sum(
            (F.contains(upper, F.lit(w.upper())).cast("int") for ws in dims.KEYWORDS[name].values() for w in ws), F.lit(0)
        )
        hits = sum(
            (
                text.rlike(p if kind == "bank_account" else "(?i)" + p).cast("int") * 2
                for kind, ps in dims.PATTERNS[name].items()
                for p in ps
            ),
            F.lit(0),
        )
        scores.append(F.struct((words + hits).alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("language")))
    return F.array_max(F.array(*scores))


def detect_language(rows: DataFrame) -> DataFrame:
    """Adds ``detected`` and its score: keywords count one, patterns two; no hit means the default."""
    scored = rows.withColumn("upper", F.upper("text")).withColumn("best", _language_scores())
    name = F.when(F.col("best.score") > 0, F.col("best.language")).otherwise(dims.DEFAULT_LANGUAGE)
    return scored.withColumns({"detected": name, "score": F.col("best.score")}).drop("upper", "best")


def label_language(pages: DataFrame) -> DataFrame:
    """The language found on the first page, set on all pages of the document."""
    first = detect_language(pages.where(F.col("page_no") == 1).select("doc_id", "text")).select(
        "doc_id", F.col("detected").alias("language")
    )
    return pages.drop("language").join(first, "doc_id", "left")
