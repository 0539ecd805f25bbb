"""Segmentation, clean-up and merging beside plain restatements, with blocks small enough to be crossed."""

import random

import pytest

from ledgerloom.operators import ocr, pages
from ledgerloom.plans import flow
from ledgerloom.sources import fixtures
from pyspark.sql import functions as F


def state_machine(marks):
    """Boundaries of one document from its marks S, E and -."""
    n = len(marks)
    if n == 1:
        return [(1, 1, "SINGLE")]
    out, start = [], None
    for page, mark in enumerate(marks, 1):
        if mark == "S":
            if start:
                out.append((start, page - 1, "MULTI_PAGE"))
            start = page
        elif mark == "E" and start:
            out.append((start, page, "STANDARD"))
            start = None
    if start:
        out.append((start, n, "INCOMPLETE"))
    return out or [(1, n, "UNKNOWN")]


def features(spark, documents):
    rows = [
        (doc, page, mark == "S", False, mark == "E", False, 0.9, f"{doc}-{page}" if mark == "S" else None)
        for doc, marks in enumerate(documents)
        for page, mark in enumerate(marks, 1)
    ]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(
        rows,
        "doc_id long, page_no int, has_header boolean, start_keywords boolean, end_keywords boolean, "
        "has_signature boolean, page_confidence double, header_number string",
    )


@pytest.mark.parametrize("block", [1, 2, 3, 1 << 16])
def test_segment_equals_state_machine(spark, block):
    rng = random.Random(7)
    documents = ["S-E-SS-", "-E-", "S", "E", "SES", "--S", "E-", "SE--", "-"]
    documents += ["".join(rng.choice("SE---") for _ in range(rng.randint(1, 14))) for _ in range(120)]
    found = pages.segment(features(spark, documents), block=block).collect()
    got = sorted((r.doc_id, r.start_page, r.end_page, r.boundary_type) for r in found)
    want = sorted((doc, *b) for doc, marks in enumerate(documents) for b in state_machine(marks))
    assert got == want
    for r in found:
        if r.boundary_type in ("STANDARD", "MULTI_PAGE", "INCOMPLETE"):
            assert r.detected_number == f"{r.doc_id}-{r.start_page}"


def merged(intervals):
    out = []
    for start, end in sorted(intervals):
        if end < start:
            continue
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + 1)
        else:
            out.append((start, end, 1))
    return out


@pytest.mark.parametrize("block", [2, 5, 1 << 16])
def test_clean_intervals(spark, block):
    rng = random.Random(3)
    lists = [[(1, 2), (3, 4)], [(1, 3), (3, 5)], [(1, 9), (2, 3), (4, 5)], [(1, 4), (3, 6), (6, 8)], [(5, 4)]]
    lists += [[(s, s + rng.randint(-1, 4)) for s in (rng.randint(1, 25) for _ in range(rng.randint(1, 9)))] for _ in range(80)]
    rows = [(doc, s, e, 1.0) for doc, ivs in enumerate(lists) for s, e in ivs]
    out = pages.clean_intervals(spark.createDataFrame(rows, "doc_id long, start_page int, end_page int, confidence double"), block)
    got = sorted((r.doc_id, r.start_page, r.end_page, r.merged, round(r.confidence, 9)) for r in out.collect())
    want = sorted((doc, s, e, n, round(0.9 ** (n - 1), 9)) for doc, ivs in enumerate(lists) for s, e, n in merged(ivs))
    assert got == want


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_merge_pages_across_blocks(spark, block):
    texts = [(1, p, "a", "" if p == 4 else f"text {p}", 0.9, "Polski") for p in range(1, 10)]
    rows = spark.createDataFrame(texts, "doc_id long, page_no int, engine string, text string, confidence double, language string")
    bounds = spark.createDataFrame(
        [(1, 1, 2, "A"), (1, 3, 7, "B"), (1, 9, 9, "C")], "doc_id long, start_page int, end_page int, boundary_type string"
    )
    got = {r.boundary_type: r.text for r in pages.merge_pages(rows, bounds, block).collect()}
    mark = "\n\n--- NOWA STRONA ---\n\n"
    assert got == {"A": mark.join(["text 1", "text 2"]), "B": mark.join(f"text {p}" for p in (3, 5, 6, 7)), "C": "text 9"}


def test_failed_pages(spark):
    rows = spark.createDataFrame([("a",), ("timeout",), ("error",), ("unknown_error",)], "engine string")
    assert pages.failed_pages(rows).count() == 3


def test_engine_tie_goes_to_the_first(spark):
    box = "array<struct<text:string,left:int,top:int,width:int,height:int,confidence:double>>"
    rows = spark.createDataFrame(
        [(1, 1, "a", "x", 0.5, []), (1, 1, "b", "y", 0.5, []), (1, 2, "a", "x", 0.5, []), (1, 2, "b", "y", 0.6, [])],
        f"doc_id long, page_no int, engine string, text string, confidence double, word_boxes {box}",
    )
    best = {r.page_no: r.engine for r in ocr.choose(rows).collect()}
    assert best == {1: "a", 2: "b"}
    assert ocr.choose(rows, "fast").count() == 2 and ocr.choose(rows, "accurate").count() == 2


def test_polygon_box(spark):
    row = spark.sql("select array(struct(1.0D x, 2.0D y), struct(5.0D x, 2.0D y), struct(5.0D x, 8.0D y), struct(1.0D x, 8.0D y)) p, 3 i")
    got = row.select(ocr.polygon_box(F.col("p"), F.col("i")).alias("b")).first().b
    assert (got.x, got.y, got.left, got.top, got.width, got.height) == (3.0, 5.0, 1, 2, 4, 6)
    none = row.select(ocr.polygon_box(F.slice("p", 1, 0), F.col("i")).alias("b")).first().b
    assert (none.y, none.top, none.width, none.height) == (90.0, 90, 100, 20)


def test_language_of_a_text_is_that_of_its_first_page(spark):
    rows = spark.createDataFrame(
        [(1, 1, "a", "Rumuński"), (1, 2, "b", "Angielski"), (1, 3, "c", "Polski"), (1, 4, "d", "Angielski")],
        "doc_id long, page_no int, text string, language string",
    )
    bounds = spark.createDataFrame([(1, 1, 2), (1, 3, 4)], "doc_id long, start_page int, end_page int")
    for block in (1, 2, 100):
        got = {r.start_page: r.language for r in pages.merge_pages(rows, bounds, block).collect()}
        assert got == {1: "Rumuński", 3: "Polski"}


def test_flow_finds_languages_and_failed_texts(spark, folder):
    rows = fixtures.invoice_pages(spark, folder).where("doc_id < 60").drop("language")
    talk = fixtures.talk_pages(spark, folder).drop("language")
    got = flow.invoices(rows.unionByName(talk), fixtures.AS_OF).select("file_id", "seq", "language", "failed", "invoice_id").collect()
    truth = {r.doc_id: r.language for r in pages.label_language(rows).select("doc_id", "language").distinct().collect()}
    invoices = [r for r in got if r.file_id < 60]
    assert invoices and all(r.language == truth[r.file_id] and not r.failed for r in invoices)
    talks = [r for r in got if r.file_id >= 60]
    assert any(r.failed for r in talks)
    assert all(r.failed == str(r.invoice_id).startswith("ERROR_") for r in got)
