"""Registered queries over streams, files and written tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.functions import text as texts
from ledgerloom.memo import memo
from ledgerloom.operators import ordered, reports, search
from ledgerloom.plans import relational
from ledgerloom.session import work_dir
from ledgerloom.sources import export, files, fixtures, tables
from ledgerloom.sources.tables import table
from ledgerloom.streaming import feeds
from ledgerloom.streaming.store import Store, first_rows

QUERIES = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def _events(spark, folder):
    return feeds.arrivals(spark, folder, feeds.EVENTS, "events.parquet")


@query("x01_saved_arrivals")
def _(spark, folder):
    path = work_dir(spark, "arrivals")
    feeds.save(_events(spark, folder), path, work_dir(spark, "state")).awaitTermination()
    return feeds.current(spark, path, feeds.EVENTS, ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("x01_keyed_save")
def _(spark, folder):
    stored_rows = relational.store(spark, folder).withColumn("change_seq", F.lit(-1).cast("long"))
    later = relational.updates(spark, folder).withColumn("change_seq", F.col("change_seq").cast("long"))
    arrived = stored_rows.unionByName(later.drop("changed_at"))
    source = work_dir(spark, "source")
    arrived.repartitionByRange(4, "change_seq", "invoice_id").write.parquet(source)
    kept = Store(work_dir(spark, "store"), arrived.schema, every=2)
    kept.save(spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", 1).parquet(source), work_dir(spark, "state")).awaitTermination()
    return kept.current(spark).drop("change_seq")


@query("x02_running_totals")
def _(spark, folder):
    path = work_dir(spark, "totals")
    feeds.running_totals(_events(spark, folder), path, work_dir(spark, "state"), "event_type", "value").awaitTermination()
    return feeds.current_totals(spark, path).drop("after_batch")


@query("x03_unique_keys")
def _(spark, folder):
    path = work_dir(spark, "unique")
    stream = _events(spark, folder)
    feeds.first_of_key(stream, path, work_dir(spark, "state"), "user_id", "ts", "3650 days").awaitTermination()
    return spark.read.parquet(path).select("user_id")


@query("x03_first_rows")
def _(spark, folder):
    stream = _events(spark, folder)
    firsts = first_rows(work_dir(spark, "firsts"), stream.schema, "user_id", "event_id")
    firsts.save(stream, work_dir(spark, "state")).awaitTermination()
    return firsts.current(spark).select("user_id", "event_id", "event_type", "value")


@query("x04_audit_feed")
def _(spark, folder):
    path = work_dir(spark, "audit")
    rows = _events(spark, folder).select(
        "event_id", "user_id", F.col("event_type").alias("action"), F.to_json(F.struct("value")).alias("changes"), "ts"
    )
    feeds.append_audit(rows, path, work_dir(spark, "state")).awaitTermination()
    return ordered.latest(spark.read.parquet(path).drop("ts"), ["user_id"], "event_id")


def _written(spark, folder):
    """The texts of the benchmark items as files, one for each."""
    path = work_dir(spark, "files")
    table(spark, folder, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    return path


@query("s03_discovery")
def _(spark, folder):
    found = files.discover(spark, _written(spark, folder), "*.txt")
    item = F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long")
    return found.select(item.alias("item_id"), "file_size", F.col("task_id").rlike("^task_[0-9a-f]{16}_part-").alias("named"))


@query("s04_file_digests")
def _(spark, folder):
    found = files.digests(spark, _written(spark, folder), "*.txt")
    return found.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), "file_hash")


@query("s05_attachments")
def _(spark, folder):
    found = files.discover(spark, folder, "*.parquet")
    keys = found.select("file_name", F.pmod("file_size", F.lit(1000)).alias("order_key"))
    ids = fixtures.clean_invoices(spark, folder, False).select("order_key", "invoice_id")
    linked = files.attachments(spark, folder, keys.join(ids, "order_key").drop("order_key"), "*.parquet")
    return linked.select("invoice_id", "file_name", "file_type", "file_size", F.sha2("file_data", 256).alias("digest"))


@query("s09_report_sheets")
def _(spark, folder):
    rows = relational.ready(spark, folder, True)
    path = work_dir(spark, "sheets")
    sheets = reports.workbook(rows)
    export.write_sheets(sheets, path)
    counts = [
        spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("rows")).select(F.lit(name).alias("sheet"), "rows")
        for name in sheets
    ]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


@query("s11_snapshot")
def _(spark, folder):
    path = work_dir(spark, "snapshots")
    export.snapshot(fixtures.invoices(spark, folder, False), path, "20010101")
    rows = spark.read.parquet(path)
    return rows.groupBy(F.col("snapshot").cast("long").alias("snapshot"), "language").agg(
        F.count("*").alias("invoices"), F.sum("total_gross").alias("total_gross")
    )


@memo
def invoice_table(spark, folder):
    """The invoices as a table cut by month, written once per application."""
    path = work_dir(spark, "invoices")
    tables.write_invoices(fixtures.invoices(spark, folder), path)
    return tables.scan_invoices(spark, path)


@query("s01_stored_search")
def _(spark, folder):
    found = search.search(
        invoice_table(spark, folder), supplier_name="supplier", date_from="1995-02-10", date_to="1996-11-20", min_amount="100",
        payment_status="opłacona",
    )
    return found.select(*relational.HEAD)


@query("p13_stored_period")
def _(spark, folder):
    rows = search.in_period(invoice_table(spark, folder), "1996-01-15", "1996-04-02")
    return rows.select(*relational.HEAD, F.size("line_items").alias("n_items"))


@query("p14_stored_supplier")
def _(spark, folder):
    rows = invoice_table(spark, folder).where(search.predicate(supplier_tax_id="1000000006"))
    return rows.select("file_id", "seq", "invoice_id", "month", "total_gross")


@query("s06_stored_pages")
def _(spark, folder):
    path = work_dir(spark, "pages")
    tables.write_pages(fixtures.talk_pages(spark, folder), path)
    return tables.scan_pages(spark, path)


@query("t03_label_values")
def _(spark, folder):
    rows = fixtures.invoice_pages(spark, folder).withColumn("low", F.lower("text"))
    return rows.select("doc_id", "page_no", texts.value_after(F.col("text"), F.col("low"), ["REGON", "NIP"]).alias("value"))


@query("j09_keyword_matches")
def _(spark, folder):
    words = F.array(
        *[
            F.struct(F.lit(lang).alias("language"), F.lit(role).alias("role"), F.lit(w).alias("keyword"))
            for lang in dims.LANGUAGES for role, ws in dims.KEYWORDS[lang].items() for w in ws
        ]
    )
    upper = table(spark, folder, "documents").select("doc_id", F.upper("text").alias("upper"))
    hits = upper.select("doc_id", F.filter(words, lambda k: F.contains(F.col("upper"), k["keyword"])).alias("hits"))
    return hits.select(F.explode_outer("hits").alias("k")).where(F.col("k").isNotNull()).groupBy(
        "k.language", "k.role", "k.keyword"
    ).agg(F.count("*").alias("documents"))
