"""Line dedup by winnowing over line hashes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh
from ledgerloom.session import stored

GRAM, WINDOW = 2, 2  # lines of a fingerprint, fingerprints of a window: a run of 3 lines always shares one
LONG = 50  # words that make a shorter run one to delete, where asked for


def _windows(text: Column, gram: int, window: int) -> Column:
    """Per window of ``gram + window - 1`` lines that are not empty: its place, its line hashes, its fingerprint.

    The fingerprint is the least hash of the window's grams; equal windows select the same one.
    """
    run = gram + window - 1
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] != "")
    hashed = F.transform(lines, lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("h")))

    def grams(rows: Column) -> Column:
        hashes = F.transform(rows, lambda s: s["h"])
        count = F.size(rows) - (gram - 1)
        each = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda j: F.xxhash64(F.slice(hashes, j, gram)))
        return F.struct(rows.alias("rows"), F.slice(each, 1, F.greatest(count, F.lit(0))).alias("grams"))

    def cut(both: Column) -> Column:
        count = F.size(both["rows"]) - (run - 1)
        return F.when(count < 1, F.array().cast("array<struct<n:int,at:array<int>,lines:array<bigint>,fp:bigint>>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
                lambda j: F.struct(
                    j.alias("n"),
                    F.transform(F.slice(both["rows"], j, run), lambda s: s["i"]).alias("at"),
                    F.transform(F.slice(both["rows"], j, run), lambda s: s["h"]).alias("lines"),
                    F.array_min(F.slice(both["grams"], j, window)).alias("fp"),
                ),
            )
        )

    # one-element arrays hold what several expressions read, so that it is made once
    return F.flatten(F.transform(F.transform(F.array(hashed), grams), cut))


def _long_windows(text: Column, run: int, words: int) -> Column:
    """The windows of ``run`` lines that hold ``words`` words or more, like ``_windows``; shorter ones end in their row."""
    count = F.transform(F.split(text, "\n", -1), lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")))

    def kept(counts: Column) -> Column:
        total = lambda at: F.aggregate(at, F.lit(0), lambda n, i: n + F.get(counts, i))
        return F.filter(_windows(text, run, 1), lambda w: total(w["at"]) >= words)

    # the number of lines keeps these fingerprints apart from those of other windows
    own = lambda w: w.withField("fp", F.xxhash64(w["fp"], F.lit(run)))
    return F.flatten(F.transform(F.array(count), lambda c: F.transform(kept(c), own)))


def repeated_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long: int | None = None) -> DataFrame:
    """(doc_id, text_key, removed): for each text with lines to delete, their places (from 0) in order.

    A run is ``gram + window - 1`` consecutive lines that are not empty, or more; with ``long`` also fewer lines that
    hold so many words together. The first place of a line always stays. Of equal runs the one in the
    smallest doc_id (null first), there the first, is kept; each other one is deleted. A run that overlaps its
    first occurrence in the same text is none. Rows of equal doc_id and text are one text.

    1. Every window selects its least gram hash as fingerprint. 2. Fingerprints that occur twice are found by
    counts that are combined before the shuffle; most lines end here. 3. The windows of the others, which extend
    the fingerprint to both sides, are compared in full (one 64-bit hash a line): the first place of each is a
    minimum, again combined before the shuffle and written, and all places join it. Overlapping windows join to longer runs.
    """
    key = F.md5(F.coalesce(F.col("text"), F.lit("")))
    text, run = F.col("text").cast("string"), gram + window - 1
    kinds = [_windows(text, gram, window)] + [_long_windows(text, n, long) for n in range(1, run) if long is not None]
    cut = F.explode(F.concat(*kinds)).alias("w")
    places = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("text_key"), cut).select("doc_id", "text_key", "w.*")
    places = stored(places, "windows")
    # The same text twice under one id is one text, so its places must not count as two.
    seen = places.groupBy("fp").agg(
        F.min(F.struct("doc_id", "text_key", "n")).alias("a"), F.max(F.struct("doc_id", "text_key", "n")).alias("b")
    )
    shared = seen.where("a != b").select("fp")
    near = stored(places.join(shared, "fp", "left_semi").drop("fp"), "shared-windows")
    first = near.groupBy("lines").agg(F.min(F.struct("doc_id", "text_key", "n")).alias("first"))
    first = stored(first, "first-windows")  # written, so that a hot window can be split
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_key") == F.col("text_key"))
    later = near.join(first, "lines").where(~same | (F.col("n") >= F.col("first.n") + F.size("lines")))
    return later.groupBy("doc_id", "text_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("at")))).alias("removed"))


def dedupe_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long: int | None = None) -> DataFrame:
    """``docs`` without later repeated runs of lines; all rows and columns stay, only ``text`` changes.

    Null and empty texts, texts without a run and empty lines stay as they are; rows that repeat get
    the same text; an empty table gives an empty result.
    """
    return _cut(docs, gram, window, long=long).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_lines (0 for a null text), n_removed and the text that is left."""
    slim = docs.select("doc_id", "text")
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    lines = F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long")
    out = _cut(slim.withColumn("n_lines", lines), gram, window, "n_removed")
    return out.select("doc_id", "n_lines", F.col("n_removed").cast("long").alias("n_removed"), "text")


def _cut(docs: DataFrame, gram: int, window: int, count: str = "", long: int | None = None) -> DataFrame:
    doc, key, removed = fresh(docs, "r_doc", "r_key", "removed")
    found = repeated_lines(docs.select("doc_id", "text"), gram, window, long).toDF(doc, key, removed)
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.md5(F.coalesce("text", F.lit(""))) == F.col(key))
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(removed))
    # one-element array: the split is made once
    text = F.transform(F.array(lines), lambda a: F.array_join(F.transform(stay, lambda i: F.get(a, i)), "\n"))[0]
    out = docs.join(found, match, "left")
    out = out.withColumn("text", F.when(F.col(removed).isNull(), F.col("text")).otherwise(text))
    return out.withColumn(count, F.coalesce(F.size(removed), F.lit(0))) if count else out
