"""Registered queries over invoice records: search, joins, statistics, quality, changes, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.functions import checksum, dates, labels, money
from ledgerloom.memo import memo
from ledgerloom.operators import changes, dedupe, joins, ordered, quality, reports, search, stats
from ledgerloom.session import stored, work_dir
from ledgerloom.sources import export, fixtures
from ledgerloom.sources.tables import table

QUERIES = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


@memo
def validated(spark: SparkSession, folder: str) -> DataFrame:
    return quality.validate(fixtures.invoices(spark, folder), fixtures.AS_OF)


@memo
def processed(spark: SparkSession, folder: str) -> DataFrame:
    """Validated invoices with duplicate flags; the duplicate search reads its own narrow plan."""
    flags = dedupe.duplicate_rows(fixtures.invoices(spark, folder, False)).withColumn(
        "is_duplicate", F.lit(True)
    )
    return (
        validated(spark, folder)
        .join(flags, dedupe.ROW, "left")
        .withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))
    )


@memo
def ready(spark: SparkSession, folder: str, with_items: bool = False) -> DataFrame:
    """The processed invoices as the table that all reports read: the messages of the findings, and the items only for
    the sheets that list them, so that no report shuffles and writes what it doesn't show."""
    rows = processed(spark, folder).drop("findings", "suggestions")
    return stored(rows if with_items else rows.drop("line_items"), "processed", "zstd")


@memo
def flat_items(spark: SparkSession, folder: str) -> DataFrame:
    net = money.item_net(F.col("total"), F.col("vat_rate"))
    return fixtures.items(spark, folder).withColumn("net_amount", net)


HEAD = ["file_id", "seq", "invoice_id", "issue_date", "supplier_tax_id", "total_gross"]


# --- search ---------------------------------------------------------------------------------------


@query("s01_scan_invoices")
def _(spark, folder):
    return fixtures.invoices(spark, folder, False).drop("supplier_accounts", "supplier_key")


@query("s02_scan_items")
def _(spark, folder):
    return fixtures.items(spark, folder)


@query("p01_number_contains")
def _(spark, folder):
    return fixtures.invoices(spark, folder, False).where(search.predicate(invoice_id="fv/1")).select(*HEAD)


@query("p02_supplier_contains")
def _(spark, folder):
    return fixtures.invoices(spark, folder, False).where(search.predicate(supplier_name="SUPPLIER#00000000")).select(*HEAD)


@query("p03_p04_tax_ids")
def _(spark, folder):
    return fixtures.invoices(spark, folder, False).where(
        search.predicate(supplier_tax_id="1000000006") | search.predicate(buyer_tax_id="5000000004")
    ).select(*HEAD)


@query("p_all_criteria")
def _(spark, folder):
    rows = processed(spark, folder)
    return search.search(
        rows, supplier_name="supplier", date_from="1996-01-01", date_to="1999-12-31", min_amount="0", max_amount="250000",
        payment_status="opłacona", is_verified=False,
    ).select(*HEAD)


@query("p10_is_verified")
def _(spark, folder):
    return validated(spark, folder).where(search.predicate(is_verified=True)).select(*HEAD)


@query("p11_p12_order_limit")
def _(spark, folder):
    return search.search(
        fixtures.invoices(spark, folder, False), order_by="total_gross", descending=True, limit=25
    ).select(*HEAD)


@query("p12_oldest_numbers")
def _(spark, folder):
    return search.search(
        fixtures.invoices(spark, folder, False), order_by="invoice_id", descending=False, limit=40
    ).select("file_id", "seq", "invoice_id")


@query("p14_point_lookup")
def _(spark, folder):
    one = fixtures.invoices(spark, folder).where(F.col("invoice_id") == "DE-5")
    return joins.flatten_items(one, "invoice_id", "issue_date")


@query("p15_p16_sane_values")
def _(spark, folder):
    day, amount = F.col("issue_date"), F.col("total_gross")
    rows = fixtures.invoices(spark, folder, False)
    sane_day = day.between(F.lit("1990-01-01").cast("date"), F.date_add(fixtures.as_of(), 365))
    return rows.where(sane_day & (amount > 0) & (amount < 10_000_000)).select(*HEAD)


@query("p17_confidence_gate")
def _(spark, folder):
    rows = fixtures.invoices(spark, folder, False).withColumnRenamed("ocr_confidence", "confidence")
    return search.confident(rows).select("file_id", "seq", "confidence")


@query("p18_p19_short_texts")
def _(spark, folder):
    return validated(spark, folder).select(
        "file_id", "seq",
        labels.short(F.col("supplier_name"), 30).alias("name30"),
        labels.short(F.col("buyer_name"), 12).alias("name12"),
        labels.head(F.col("warnings"), 3).alias("first_three"),
        labels.head(F.col("warnings"), 2).alias("first_two"),
        labels.first_or_none(F.col("supplier_accounts")).alias("account"),
    )


@query("p20_nested_record")
def _(spark, folder):
    nested = export.nested(fixtures.invoices(spark, folder, False))
    return nested.select(
        "file_id", "seq", F.col("supplier.name").alias("supplier_name"), F.col("buyer.tax_id").alias("buyer_tax_id"),
        F.col("dates.payment_term_days").alias("payment_term_days"), F.col("summary.total_gross").alias("total_gross"),
    )


# --- joins ----------------------------------------------------------------------------------------


@query("j01_nested_items")
def _(spark, folder):
    headers = fixtures.invoices(spark, folder, False)
    lines = fixtures.items(spark, folder).select("order_key", "position", "description", "total")
    nested = joins.nest_items(headers, lines, "order_key")
    return nested.select(
        "file_id", "seq", "invoice_id", F.size("items").alias("n_items"),
        F.array_join(F.transform("items", lambda i: i["description"]), "|").alias("descriptions"),
        F.array_join(F.transform("items", lambda i: i["total"].cast("string")), "|").alias("totals"),
    )


@query("j02_flat_items")
def _(spark, folder):
    return joins.flatten_items(
        fixtures.invoices(spark, folder), "file_id", "seq", "invoice_id", "issue_date", "supplier_name"
    ).drop("position")


@query("j03_exact_duplicates")
def _(spark, folder):
    return dedupe.exact_duplicates(fixtures.invoices(spark, folder, False))


@query("j03_pair_count")
def _(spark, folder):
    return dedupe.exact_pair_count(fixtures.invoices(spark, folder, False))


@query("j04_near_duplicates")
def _(spark, folder):
    return dedupe.near_duplicates(fixtures.invoices(spark, folder, False))


@query("j04_pair_count")
def _(spark, folder):
    return dedupe.near_pair_count(fixtures.invoices(spark, folder, False))


@query("j05_duplicate_flags")
def _(spark, folder):
    return dedupe.mark_duplicates(fixtures.invoices(spark, folder, False)).select("file_id", "seq", "is_duplicate")


@query("j05_tolerance")
def _(spark, folder):
    return dedupe.duplicate_rows(fixtures.invoices(spark, folder, False), tolerance="1.50")


@query("j10_bank_names")
def _(spark, folder):
    rows = fixtures.invoices(spark, folder, False).select(
        "file_id", "seq", F.get("supplier_accounts", F.lit(0)).alias("account")
    )
    named = joins.with_bank(rows, F.col("account"), dims.bank_codes(spark), dims.UNKNOWN_BANK)
    return named.select("file_id", "seq", "account", "bank_name")


@query("j11_illegal_rates")
def _(spark, folder):
    flat = joins.flatten_items(fixtures.invoices(spark, folder), "file_id", "seq", "language")
    rates = flat.groupBy("language", F.col("vat_rate").cast("int").alias("rate")).agg(F.count("*").alias("items"))
    return joins.illegal_rates(rates, dims.legal_rates(spark))


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """Company register: suppliers with a balance above 3000, by tax id."""
    return table(spark, folder, "supplier").where(F.col("s_acctbal") > 3000).select(
        fixtures.tax_id_of(100_000_000, F.col("s_suppkey")).alias("tax_id"), F.col("s_name").alias("company_name")
    )


@query("j13_unregistered_suppliers")
def _(spark, folder):
    return joins.unregistered(fixtures.invoices(spark, folder, False), registry(spark, folder)).select(
        "file_id", "seq", "supplier_tax_id"
    )


@memo
def feed(spark: SparkSession, folder: str) -> DataFrame:
    """The change feed with the number of the invoice that each change concerns."""
    ids = fixtures.clean_invoices(spark, folder, False).select("order_key", "invoice_id")
    return fixtures.changes(spark, folder).join(ids, "order_key", "left")


@memo
def store(spark: SparkSession, folder: str) -> DataFrame:
    """The stored invoices: all clean records."""
    return fixtures.clean_invoices(spark, folder, False).select(
        "invoice_id", "invoice_type", "issue_date", "supplier_tax_id", "total_net", "total_gross",
        "payment_status", "paid_amount", F.lit(False).alias("is_verified"),
        F.concat(F.lit("file-"), F.col("file_id")).alias("file_path"),
    )


@memo
def updates(spark: SparkSession, folder: str) -> DataFrame:
    """Invoices of the CREATE events under new numbers, new readings of those of the UPDATE events; the amount is
    the new gross."""
    source = feed(spark, folder).where(F.col("action").isin("CREATE", "UPDATE")).withColumnRenamed("seq", "change_seq")
    rows = fixtures.clean_invoices(spark, folder, False).drop("invoice_id", "payment_status", "paid_amount")
    number = F.when(F.col("action") == "CREATE", F.concat("invoice_id", F.lit("-N"))).otherwise(F.col("invoice_id"))
    return source.join(rows, "order_key").select(
        F.col("change_seq"),
        number.alias("invoice_id"), "invoice_type", "issue_date", "supplier_tax_id", "total_net",
        F.coalesce("amount", "total_gross").alias("total_gross"),
        F.lit("nieopłacona").alias("payment_status"), F.lit(0).cast("decimal(18,2)").alias("paid_amount"),
        F.lit(True).alias("is_verified"), F.lit("new").alias("file_path"), F.col("ts").alias(changes.AT),
    )


@query("j14_existing_and_new")
def _(spark, folder):
    old, new = joins.split_by_key(
        ordered.latest(updates(spark, folder), ["invoice_id"], "change_seq"), store(spark, folder)
    )
    mark = lambda rows, kind: rows.select("invoice_id", F.lit(kind).alias("kind"))
    return mark(old, "update").unionByName(mark(new, "insert"))


@query("j15_cascade")
def _(spark, folder):
    deleted = feed(spark, folder).where(F.col("action") == "DELETE").select("order_key")
    return joins.cascade_delete(fixtures.items(spark, folder), deleted, "order_key").select(
        "order_key", "position", "description"
    )


@query("j16_language_profile")
def _(spark, folder):
    rows = fixtures.talk_languages(spark, folder)
    return joins.with_profile(rows, dims.lang_profile(spark), dims.DEFAULT_LANGUAGE).select(
        "doc_id", "language", "profile", "code", "decimal_sep", "thousand_sep", "symbol"
    )


# --- statistics -----------------------------------------------------------------------------------


@query("a01_general")
def _(spark, folder):
    out = stats.general(processed(spark, folder))
    return out.withColumn("avg_gross", F.round(F.col("avg_gross").cast("double"), 2))


@query("a01_p13_period")
def _(spark, folder):
    rows = search.in_period(processed(spark, folder), "1997-03-01", "1999-09-30")
    out = stats.general(rows)
    return out.withColumn("avg_gross", F.round(F.col("avg_gross").cast("double"), 2))


@query("a02_top_suppliers")
def _(spark, folder):
    return stats.top_suppliers(fixtures.invoices(spark, folder, False))


@query("a03_last_months")
def _(spark, folder):
    return stats.last_months(fixtures.invoices(spark, folder, False))


@query("a04_report_statistics")
def _(spark, folder):
    out = stats.report(validated(spark, folder))
    return out.withColumn("avg_invoice_value", F.round(F.col("avg_invoice_value").cast("double"), 2))


@query("a05_top_names")
def _(spark, folder):
    return stats.top_names(fixtures.invoices(spark, folder, False))


@query("a06_monthly")
def _(spark, folder):
    return stats.monthly(fixtures.invoices(spark, folder, False))


@query("a07_pie")
def _(spark, folder):
    return stats.pie(fixtures.invoices(spark, folder, False))


@query("a08_pivot")
def _(spark, folder):
    return stats.pivot(fixtures.invoices(spark, folder, False))


@query("a09_total_row")
def _(spark, folder):
    return stats.with_total(fixtures.invoices(spark, folder, False), ["total_net", "total_vat", "total_gross"])


@query("a10_vat_summary")
def _(spark, folder):
    return stats.vat_summary(flat_items(spark, folder))


@query("a11_item_sums")
def _(spark, folder):
    return stats.item_sums(fixtures.invoices(spark, folder))


@query("a13_panel")
def _(spark, folder):
    return stats.panel(ready(spark, folder))


@query("e03_row_numbers")
def _(spark, folder):
    rows = fixtures.invoices(spark, folder, False).select(*reports.FILE_ORDER)
    return ordered.number_rows(rows, *map(F.col, reports.FILE_ORDER))


@query("e09_latest_change")
def _(spark, folder):
    return ordered.latest(fixtures.changes(spark, folder).drop("ts"), ["order_key"], "seq")


@query("e10_supplier_rank")
def _(spark, folder):
    from pyspark.sql import Window

    top = stats.top_names(fixtures.invoices(spark, folder, False))
    order = Window.orderBy(F.col("total_amount").desc(), F.col("supplier_name").asc_nulls_first())
    return top.withColumn("rank", F.row_number().over(order))


@query("u02_replaced_items")
def _(spark, folder):
    lines = fixtures.items(spark, folder).select("order_key", "position", "description", "total")
    changed = feed(spark, folder).where(F.col("action") == "UPDATE").select("order_key").distinct()
    fresh = lines.join(changed, "order_key", "left_semi").where(F.col("total") > 20000)
    return changes.replace_items(lines, fresh, changed, "order_key")


@query("u04_all_files")
def _(spark, folder):
    rows = fixtures.clean_invoices(spark, folder, False).select("file_id", "invoice_id", "total_gross")
    talks = fixtures.talk_pages(spark, folder).select(F.col("doc_id").alias("file_id")).distinct()
    return rows.unionByName(talks, allowMissingColumns=True)


# --- scalar functions -----------------------------------------------------------------------------


@query("n02_vat")
def _(spark, folder):
    vat = money.vat_of(F.col("net_amount"), F.col("vat_rate"))
    return flat_items(spark, folder).select(
        "order_key", "position", "net_amount", vat.alias("vat"), (F.col("net_amount") + vat).alias("gross")
    )


@query("n03_format_amount")
def _(spark, folder):
    return fixtures.clean_invoices(spark, folder, False).select(
        "invoice_id", money.format_amount(F.col("total_gross"), F.col("language")).alias("text")
    )


@query("n01_parse_amount")
def _(spark, folder):
    text = money.format_amount(F.col("total_gross"), F.col("language"))
    return fixtures.clean_invoices(spark, folder, False).select("invoice_id", money.parse_amount(text, F.col("language")).alias("amount"))


@query("n04_reverse_charge")
def _(spark, folder):
    country = F.get(
        F.array(*map(F.lit, ["PL", "DE", "RO", "FR", "IT", "ES"])), (F.col("order_key") % 6).cast("int")
    )
    out = fixtures.clean_invoices(spark, folder, False).select(
        "invoice_id", country.alias("country"), money.reverse_charge(F.col("total_net"), country).alias("r")
    )
    return out.select("invoice_id", "country", "r.*")


@query("n05_item_amounts")
def _(spark, folder):
    return flat_items(spark, folder).select(
        "order_key", "position", "net_amount", (F.col("total") - F.col("net_amount")).alias("vat_amount"),
        F.col("total").alias("gross_amount"),
    )


@query("n06_report_amounts")
def _(spark, folder):
    net = money.item_net(F.col("total"), F.lit(None).cast("decimal(5,2)"))
    return fixtures.items(spark, folder).select("order_key", "position", net.alias("net_amount"))


@query("d02_d03_format_dates")
def _(spark, folder):
    return fixtures.invoices(spark, folder, False).select(
        "file_id", "seq", dates.format_day(F.col("issue_date")).alias("day"),
        dates.format_day(F.when(F.col("supplier_key").isNotNull(), F.col("due_date"))).alias("due"),
        dates.format_day_in(F.col("issue_date"), F.col("language")).alias("local_day"),
    )


@query("d04_d05_d06_terms")
def _(spark, folder):
    return fixtures.invoices(spark, folder, False).select(
        "file_id", "seq", F.date_add("issue_date", 14).alias("due14"),
        F.datediff("due_date", "issue_date").alias("term"), dates.month_key(F.col("issue_date")).alias("month"),
    )


@query("c01_nip")
def _(spark, folder):
    return fixtures.invoices(spark, folder, False).select(
        "file_id", "seq", checksum.nip_valid(F.col("supplier_tax_id")).alias("supplier_ok"),
        checksum.nip_valid(F.col("buyer_tax_id")).alias("buyer_ok"),
    )


@query("c01_sql_function")
def _(spark, folder):
    checksum.register_sql(spark)
    return fixtures.invoices(spark, folder, False).select(
        "file_id", "seq", F.expr("nip_valid(supplier_tax_id)").alias("supplier_ok"),
    )


@query("c02_cui")
def _(spark, folder):
    customer = table(spark, folder, "customer")
    return customer.select(
        "c_custkey", checksum.cui_valid(F.concat(F.lit("RO "), F.col("c_custkey"))).alias("key_ok"),
        checksum.cui_valid((F.col("c_custkey") * 7919 + 1234567).cast("string")).alias("long_ok"),
    )


@query("c03_c06_iban")
def _(spark, folder):
    account = F.get("supplier_accounts", F.lit(0))
    return fixtures.invoices(spark, folder, False).select(
        "file_id", "seq", checksum.iban_valid(account).alias("valid"),
        checksum.format_iban(account).alias("grouped"),
        checksum.format_iban(F.substr(account, F.lit(3))).alias("from_nrb"),
        checksum.format_iban(F.substring(account, 1, 10)).alias("too_short"),
    )


@query("c04_email")
def _(spark, folder):
    words = F.explode(F.split("text", r"\s+"))
    seen = table(spark, folder, "documents").select("doc_id", words.alias("word"))
    return seen.where(checksum.email_valid(F.col("word"))).groupBy("doc_id").agg(F.count("*").alias("emails"))


@query("c05_phone")
def _(spark, folder):
    country = F.get(F.array(*map(F.lit, ["PL", "DE", "RO", "GB", "US", "CZ"])), (F.col("c_custkey") % 6).cast("int"))
    number = F.concat(F.lit("+"), (F.col("c_custkey") * 104729 * 104729).cast("string"))
    return table(spark, folder, "customer").select(
        "c_custkey", country.alias("country"), checksum.phone_valid(number, country).alias("ok")
    )


@query("l01_l04_labels")
def _(spark, folder):
    return ready(spark, folder).select(
        "file_id", "seq",
        labels.invoice_status(
            F.col("is_duplicate"), F.col("errors"), F.col("warnings"), F.col("confidence")
        ).alias("status"),
        labels.confidence_band(F.col("confidence")).alias("band"),
        labels.review_flag(F.col("confidence")).alias("review"),
        labels.row_status(F.col("errors"), F.col("is_verified")).alias("row_status"),
    )


# --- quality --------------------------------------------------------------------------------------


@query("v_findings")
def _(spark, folder):
    return quality.long_findings(validated(spark, folder), "file_id", "seq")


@query("v_by_rule")
def _(spark, folder):
    return quality.rule_counts(validated(spark, folder))


@query("a16_a17_v33_confidence")
def _(spark, folder):
    return validated(spark, folder).select(
        "file_id", "seq", "confidence", "is_verified",
        F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"),
    )


# --- changes --------------------------------------------------------------------------------------


@query("k01_upsert")
def _(spark, folder):
    return changes.upsert(store(spark, folder), updates(spark, folder))


@query("k02_items_of_upserts")
def _(spark, folder):
    lines = fixtures.items(spark, folder).select("order_key", "position", "description")
    changed = feed(spark, folder).where(F.col("action").isin("CREATE", "UPDATE")).select("order_key").distinct()
    fresh = lines.join(changed, "order_key", "left_semi").where(F.col("position") > 1)
    return changes.replace_items(lines, fresh, changed, "order_key")


@query("k03_delete")
def _(spark, folder):
    gone = feed(spark, folder).where(F.col("action") == "DELETE")
    return changes.delete(store(spark, folder), gone).select("invoice_id", "total_gross")


@query("k04_mark_paid")
def _(spark, folder):
    payments = ordered.latest(
        feed(spark, folder).where(F.col("action") == "PAYMENT").select("invoice_id", "seq", "amount"), ["invoice_id"], "seq"
    )
    return changes.mark_paid(store(spark, folder), payments).select("invoice_id", "payment_status", "paid_amount")


@query("k05_verify")
def _(spark, folder):
    marks = feed(spark, folder).where(F.col("action") == "VERIFY").groupBy("invoice_id").agg(F.lit(True).alias("verified"))
    return changes.verify(store(spark, folder), marks).select("invoice_id", "is_verified")


@query("k_updated_at")
def _(spark, folder):
    rows = store(spark, folder).withColumn("updated_at", F.lit(None).cast("timestamp"))
    fed = feed(spark, folder).withColumnRenamed("ts", changes.AT)
    paid = fed.where(F.col("action") == "PAYMENT").select("invoice_id", "seq", "amount", changes.AT)
    marks = fed.where(F.col("action") == "VERIFY").select("invoice_id", "seq", F.lit(True).alias("verified"), changes.AT)
    rows = changes.upsert(rows, updates(spark, folder))
    rows = changes.mark_paid(rows, ordered.latest(paid, ["invoice_id"], "seq"))
    rows = changes.verify(rows, ordered.latest(marks, ["invoice_id"], "seq"))
    return rows.select("invoice_id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("k06_audit")
def _(spark, folder):
    return changes.audit(feed(spark, folder)).drop("timestamp")


# --- reports --------------------------------------------------------------------------------------


@query("r01_summary")
def _(spark, folder):
    return reports.summary(ready(spark, folder))


@query("r02_details")
def _(spark, folder):
    return reports.details(fixtures.invoices(spark, folder))


@query("r03_items")
def _(spark, folder):
    return reports.items(fixtures.invoices(spark, folder))


@query("r04_statistics")
def _(spark, folder):
    return reports.statistics(ready(spark, folder))


@query("r05_charts")
def _(spark, folder):
    return reports.charts(fixtures.invoices(spark, folder, False))


@query("r06_pivot")
def _(spark, folder):
    return reports.pivot(fixtures.invoices(spark, folder, False))


@query("r07_validation")
def _(spark, folder):
    return reports.validation(ready(spark, folder))


# --- exports --------------------------------------------------------------------------------------


@query("s08_json_export")
def _(spark, folder):
    path = work_dir(spark, "export")
    export.write_json(validated(spark, folder), path)
    field = lambda path: F.get_json_object("value", f"$.{path}")
    return spark.read.text(path).where(field("version").isNotNull() & field("export_date").isNotNull()).select(
        field("invoice_id").alias("invoice_id"), field("supplier.tax_id").alias("supplier_tax_id"),
        field("amounts.gross").cast("double").alias("gross"), field("amounts.currency").alias("currency"),
        field("items[0].description").alias("first_item"),
    )


@query("s10_json_columns")
def _(spark, folder):
    rows = export.lists_to_text(validated(spark, folder), "warnings", "supplier_accounts")
    back = export.text_to_lists(rows, "warnings", "supplier_accounts")
    return back.select(
        "file_id", "seq", F.size("warnings").alias("n_warnings"), F.get("supplier_accounts", F.lit(0)).alias("account")
    )
