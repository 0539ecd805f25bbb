"""Registered queries over texts, pages and recognised words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.functions import checksum, dates, text as texts
from ledgerloom.memo import memo
from ledgerloom.operators import changes, dedupe, extract, ocr, pages, quality, stats
from ledgerloom.plans import flow
from ledgerloom.session import stored
from ledgerloom.sources import fixtures
from ledgerloom.sources.tables import table

QUERIES = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


@memo
def bounds(spark, folder):
    return flow.boundaries(fixtures.pages(spark, folder))


@memo
def merged(spark, folder):
    return flow.stored(flow.merged(fixtures.invoice_pages(spark, folder)))


@memo
def extracted(spark, folder):
    return extract.extract(merged(spark, folder), fixtures.AS_OF)


@memo
def checked(spark, folder):
    return quality.validate(extracted(spark, folder), fixtures.AS_OF)


@memo
def kept(spark, folder):
    """The checked invoices as the table that a run leaves behind."""
    return stored(checked(spark, folder).drop("raw_text"), "invoices")


@memo
def readings(spark, folder):
    return ocr.read_pages(fixtures.words(spark, folder))


# --- texts ----------------------------------------------------------------------------------------


@query("t01_clean_text")
def _(spark, folder):
    clean = texts.clean_text(F.col("text"))
    return table(spark, folder, "documents").select(
        "doc_id", F.length(clean).alias("n"), F.md5(clean.cast("binary")).alias("digest")
    )


@query("t02_numbers")
def _(spark, folder):
    found = table(spark, folder, "documents").select("doc_id", texts.extract_numbers(F.col("text")).alias("numbers"))
    return found.where(F.size("numbers") > 0).select(
        "doc_id", F.size("numbers").alias("n"), F.get("numbers", F.lit(0)).alias("first"),
        F.element_at("numbers", -1).alias("last"), F.array_max("numbers").alias("largest"),
    )


@query("t02_page_numbers")
def _(spark, folder):
    line = F.explode(F.split("text", "\n"))
    lines = fixtures.invoice_pages(spark, folder).select("doc_id", "page_no", line.alias("line"))
    found = lines.select("doc_id", "page_no", texts.extract_numbers(F.col("line")).alias("numbers"))
    flat = found.select("doc_id", "page_no", F.explode("numbers").alias("x"))
    return flat.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"), F.sum("x").alias("total"))


@query("t19_t22_page_flags")
def _(spark, folder):
    out = pages.page_features(fixtures.pages(spark, folder))
    return out.select(
        "doc_id", "page_no", "has_header", "header_number", "start_keywords", "end_keywords", "has_items",
        "has_summary", "has_signature", "total_text", "page_confidence",
    )


@query("t24_text_features")
def _(spark, folder):
    documents = table(spark, folder, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), "text")
    html = table(spark, folder, "pages").select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    talk = table(spark, folder, "conversations").select(
        F.lit("talk").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    return pages.numeric_features(documents.unionByName(html).unionByName(talk)).drop("text")


@query("s04_text_digest")
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("a18_language")
def _(spark, folder):
    return pages.detect_language(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


@query("t25_document_language")
def _(spark, folder):
    out = pages.label_language(fixtures.invoice_pages(spark, folder))
    return out.groupBy("language").agg(F.count("*").alias("pages"))


@query("d01_parse_date")
def _(spark, folder):
    return fixtures.pages(spark, folder).select(
        "doc_id", "page_no", dates.parse_date(F.col("text"), fixtures.as_of()).alias("day")
    )


@query("t10_e06_date_hits")
def _(spark, folder):
    hits = dates.drop_repeats(dates.date_hits("text", fixtures.as_of()))
    found = fixtures.pages(spark, folder).select("doc_id", "page_no", hits.alias("hits"))
    return found.select(
        "doc_id", "page_no", F.size("hits").alias("n"), F.get("hits", F.lit(0))["date"].alias("first"),
        F.try_element_at("hits", F.lit(-1))["date"].alias("last"),
    )


@query("c07_accounts")
def _(spark, folder):
    found = fixtures.pages(spark, folder).select("doc_id", "page_no", checksum.bank_accounts(F.col("text")).alias("a"))
    return found.select("doc_id", "page_no", F.array_join("a", "|").alias("accounts"))


# --- documents ------------------------------------------------------------------------------------


@query("e01_boundaries")
def _(spark, folder):
    return bounds(spark, folder)


@query("e01_whole_documents")
def _(spark, folder):
    return flow.boundaries(fixtures.pages(spark, folder), auto=False).drop("detected_number")


@query("e02_clean_intervals")
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("l_linenumber") * 2).cast("int").alias("start_page"),
        (F.col("l_linenumber") * 2 + F.col("l_quantity") % 5 - 1).cast("int").alias("end_page"),
        F.lit(0.8).alias("confidence"),
    )
    out = pages.clean_intervals(lines)
    return out.withColumn("confidence", F.round("confidence", 6))


@query("e02_boundaries_unchanged")
def _(spark, folder):
    return pages.clean_intervals(bounds(spark, folder)).select("doc_id", "start_page", "end_page", "confidence")


@query("t23_merged_texts")
def _(spark, folder):
    every = flow.merged(fixtures.pages(spark, folder))
    return every.select(
        "doc_id", "start_page", "end_page", "boundary_type", F.length("text").alias("n"),
        F.md5(F.col("text").cast("binary")).alias("digest"),
    )


@query("a15_segmentation_summary")
def _(spark, folder):
    out = pages.segmentation_summary(bounds(spark, folder))
    return out.withColumn("issues", F.array_join("issues", "; "))


@query("a12_batch_statistics")
def _(spark, folder):
    page_rows = fixtures.invoice_pages(spark, folder)
    checked_rows = quality.validate(fixtures.invoices(spark, folder), fixtures.AS_OF)
    return stats.batch(page_rows, flow.boundaries(page_rows), checked_rows)


@query("s12_run_record")
def _(spark, folder):
    return stats.run_record(
        fixtures.pages(spark, folder), fixtures.invoices(spark, folder, False), "tesseract", dims.DEFAULT_LANGUAGE
    )


# --- words ----------------------------------------------------------------------------------------


@query("a14_page_confidence")
def _(spark, folder):
    out = ocr.page_confidence(fixtures.words(spark, folder))
    return out.withColumn("confidence", F.round("confidence", 6))


@query("e05_reading_order")
def _(spark, folder):
    return readings(spark, folder).select(
        "doc_id", "page_no", "engine", F.size("word_boxes").alias("words"), F.md5(F.col("text").cast("binary")).alias("digest")
    )


@query("e04_best_engine")
def _(spark, folder):
    return ocr.choose(readings(spark, folder), "best").select(
        "doc_id", "page_no", "engine", F.round("confidence", 6).alias("confidence")
    )


@query("j12_u03_merged_engines")
def _(spark, folder):
    return ocr.choose(readings(spark, folder), "merge").select(
        "doc_id", "page_no", "engine", F.size("word_boxes").alias("boxes"), F.round("confidence", 6).alias("confidence"),
        F.md5(F.col("text").cast("binary")).alias("digest"),
    )


# --- extraction -----------------------------------------------------------------------------------

KEY = ["file_id", "start_page", "end_page"]


@query("t05_t06_number_type")
def _(spark, folder):
    return extracted(spark, folder).select(*KEY, "invoice_id", "invoice_type")


@query("j06_t11_dates")
def _(spark, folder):
    return extracted(spark, folder).select(*KEY, "issue_date", "sale_date", "due_date")


@query("t07_j07_parties")
def _(spark, folder):
    return extracted(spark, folder).select(*KEY, "supplier_tax_id", "buyer_tax_id")


@query("j08_own_tax_id")
def _(spark, folder):
    out = extract.extract(merged(spark, folder), fixtures.AS_OF, "100-000-00-06")
    return out.select(*KEY, "supplier_tax_id", "buyer_tax_id", "belongs_to_user")


@query("t08_t09_names_addresses")
def _(spark, folder):
    return extracted(spark, folder).select(
        *KEY, "supplier_name", "buyer_name", "supplier_address", "buyer_address", F.get("supplier_accounts", F.lit(0)).alias("account")
    )


@query("t12_t13_totals")
def _(spark, folder):
    return extracted(spark, folder).select(*KEY, "total_net", "total_vat", "total_gross", "totals_from_items")


@query("t14_t15_t16_payment")
def _(spark, folder):
    return extracted(spark, folder).select(*KEY, "currency", "payment_method", "payment_status", "paid_amount")


@query("e07_t17_t18_items")
def _(spark, folder):
    out = extracted(spark, folder).select(*KEY, F.explode_outer("line_items").alias("i")).where(F.col("i").isNotNull())
    return out.select(*KEY, "i.position", "i.description", "i.quantity", "i.unit_price", "i.total")


@query("e08_grouped_items")
def _(spark, folder):
    lines = texts.text_lines(F.col("text"))
    grouped = merged(spark, folder).select(
        F.col("doc_id").alias("file_id"), "start_page", "end_page", extract.grouped_items(lines).alias("items")
    )
    return grouped.select(*KEY, F.explode_outer("items").alias("i")).select(*KEY, "i.position", "i.description", "i.total")


@query("e11_label_positions")
def _(spark, folder):
    sellers = [w for lang in dims.LANGUAGES for w in dims.KEYWORDS[lang]["seller"][:1]]
    buyers = [w for lang in dims.LANGUAGES for w in dims.KEYWORDS[lang]["buyer"][:1]]
    return fixtures.invoice_pages(spark, folder).select(
        "doc_id", "page_no", texts.first_label(F.col("text"), sellers).alias("seller"),
        texts.first_label(F.col("text"), buyers).alias("buyer"),
    )


@query("k07_error_records")
def _(spark, folder):
    talk = flow.merged(fixtures.talk_pages(spark, folder))
    records = changes.error_records(extract.extract(talk, fixtures.AS_OF))
    return records.select("file_id", "invoice_id", "invoice_type", "failed", F.length("raw_text").alias("kept"))


@query("v_extracted_by_rule")
def _(spark, folder):
    return quality.rule_counts(kept(spark, folder))


@query("j05_extracted_duplicates")
def _(spark, folder):
    return dedupe.mark_duplicates(kept(spark, folder)).select("file_id", "seq", "is_duplicate")


@query("flagship_supplier_totals")
def _(spark, folder):
    return flow.supplier_totals(checked(spark, folder))
