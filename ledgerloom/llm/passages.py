"""Repeated passages by a sparse suffix array: suffixes at content-selected positions, sorted and compared."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, letter_words
from ledgerloom.llm.decontaminate import without_words
from ledgerloom.session import stored

GRAM, SPACING = 8, 16  # words of the gram whose hash selects a position; one of so many positions is selected
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
PART, BATCH = 2048, 1000  # words of a text whose stretches are cut together, stretches that leave a worker together
KEYS = "h long, doc_id long, text_key long, pos long, around long"
TEXT = ["doc_id", "text_key"]
SPOT = [*TEXT, "pos"]


def _spot(prefix: str = "") -> Column:
    """The place of a suffix as a struct; places are ordered, null ids first."""
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in SPOT])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ahead, back = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    ahead[1:], back[1:] = BASE, pow(BASE, -1, 1 << 64)
    return np.cumprod(ahead, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Suffixes:
    """Selected positions of a text, the hash of the ``prefix`` words of the suffix at each, and the hash of these with
    the ``spacing`` - 1 words on both sides (fewer at the ends of the text)."""

    def __init__(self, gram: int, spacing: int, prefix: int):
        self.gram, self.spacing, self.prefix = gram, spacing, prefix
        self.ahead, self.back = _powers(1 << 14)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, none = len(words), np.zeros(0, np.int64)
        if n < self.prefix + self.spacing - 1:
            return none, none, none
        if n >= len(self.ahead):
            self.ahead, self.back = _powers(2 * n)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * self.ahead[:n], dtype=np.uint64)))

        def of(size: int) -> np.ndarray:
            """Hash of the ``size`` words from each position on."""
            return _mixed((total[size:] - total[:-size]) * self.back[: n - size + 1])

        windows = sliding_window_view(of(self.gram), self.spacing)
        at = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
        at = at[at <= n - self.prefix]
        begin, end = np.maximum(at - self.spacing + 1, 0), np.minimum(at + self.prefix + self.spacing - 1, n)
        around = _mixed((total[end] - total[begin]) * self.back[begin])
        shape = ((at - begin) * self.spacing + (end - at - self.prefix)).astype(np.uint64)
        return at, of(self.prefix)[at].view(np.int64), _mixed(around + shape).view(np.int64)


def suffixes(docs: DataFrame, prefix: int, gram: int, spacing: int) -> DataFrame:
    """(h, doc_id, text_key, pos, around): the retained suffixes of each text, with the hash of their first words and
    that of these and the words around them."""

    def cut(frames):
        make = Suffixes(gram, spacing, prefix)
        for part in frames:
            rows = [make(letter_words(t)) for t in part["text"]]
            count = [len(r[0]) for r in rows]
            at, h, around = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 3
            ids = part["doc_id"].astype("Int64").repeat(count).array
            keys = np.repeat(part["text_key"].to_numpy(np.int64), count)
            yield pd.DataFrame({"h": h, "doc_id": ids, "text_key": keys, "pos": at, "around": around})

    return docs.select("doc_id", "text_key", "text").mapInPandas(cut, KEYS)


def neighbours(sorted_rows: DataFrame) -> DataFrame:
    """Each row of the sorted suffixes beside the one before it (p_), where both share their hash.

    ``p_around`` is null where the words around are the same too; ``head`` is false where the row before is not
    the first of its hash. Partitions are streamed, so a hash that many suffixes share needs no task of its own. The
    first and last row of each partition (two rows a partition) are set beside each other afterwards.
    """
    columns = [c.split()[0] for c in KEYS.split(", ")]
    before = [f"p_{c}" for c in columns[1:]]
    schema = f"{KEYS}, {', '.join(f'{c} long' for c in before)}, head boolean, edge int, part int"

    def compare(frames):
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None

        def row(values, edge):
            out = pd.DataFrame([values], columns=columns).assign(**dict.fromkeys(before))
            out = out.astype(dict.fromkeys([*columns, *before], "Int64"))
            return out.assign(head=True, edge=edge, part=part)

        for now in frames:
            if not len(now):
                continue
            now = now.astype(dict.fromkeys(columns, "Int64"))
            if last is None:
                yield row(now.iloc[0].tolist(), 0)
            whole = now if last is None else pd.concat([last, now], ignore_index=True)
            h = whole["h"].to_numpy(np.int64)
            same = np.flatnonzero(h[1:] == h[:-1])
            if len(same):
                out = whole.iloc[same + 1].reset_index(drop=True)
                old = whole.iloc[same].reset_index(drop=True)[columns[1:]].set_axis(before, axis=1)
                old["p_around"] = old["p_around"].mask(old["p_around"] == out["around"])
                head = (same == 0) | (h[same] != h[same - 1])
                yield pd.concat([out, old], axis=1).assign(head=head, edge=2, part=part)
            last = now.iloc[-1:]
        if last is not None:
            yield row(last.iloc[0].tolist(), 1)

    both = stored(sorted_rows.mapInPandas(compare, schema), "neighbours")
    ends = both.where("edge < 2")
    order = Window.orderBy("part", "edge")  # two rows a partition
    lag = {f"p_{c}": F.lag(c).over(order) for c in columns}
    across = ends.drop(*before).withColumns(lag).where("edge = 0 and h = p_h")
    across = across.withColumn("p_around", F.nullif("p_around", "around"))
    names = [*columns, *before, "head"]
    pairs = both.where("edge = 2").select(*names).unionByName(across.select(*names))
    same = F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("text_key") == F.col("p_text_key")) & (F.col("pos") == F.col("p_pos"))
    return pairs.where(~same)  # a row that repeats


def _firsts(near: DataFrame) -> DataFrame:
    """(h, around, first): of suffixes that share a hash but differ in the words around, the first (doc_id, text_key,
    pos) of each kind.

    In order, the first of a kind either comes right after another kind or opens its hash, so only those rows are
    looked at; a kind that is alone in its hash is left out.
    """
    mixed = F.col("p_around").isNotNull()
    rows = near.where(mixed).select("h", "around", _spot().alias("at"), F.lit(True).alias("mixed"))
    heads = near.where(mixed | F.col("head")).select("h", F.coalesce("p_around", "around").alias("around"), _spot("p_").alias("at"), mixed.alias("mixed"))
    kinds = rows.unionByName(heads).groupBy("h", "around").agg(F.min("at").alias("first"), F.max("mixed").alias("mixed"))
    return kinds.where("mixed").drop("mixed")


def _repeated_windows(firsts: DataFrame, around: DataFrame, prefix: int, least: int) -> DataFrame:
    """Matches between the first suffixes of different kinds: (doc_id, text_key, start, stop, p_doc_id, p_start).

    Every window of ``least`` words around a suffix is set beside its first occurrence: a minimum, combined before
    the shuffle. Windows on one diagonal of two texts that overlap are one match.
    """
    beside = least - prefix
    shifts = F.filter(
        F.sequence(F.lit(0), F.lit(beside)), lambda o: (o <= F.size("left")) & (beside - o <= F.size("right"))
    )
    key = F.xxhash64("body", F.slice("left", 1, F.col("o")), F.slice("right", 1, beside - F.col("o")), "o")
    rows = firsts.join(around, "run").withColumn("o", F.explode(shifts))
    rows = rows.select(*TEXT, (F.col("pos") - F.col("o")).alias("pos"), key.alias("key"))
    least_at = rows.groupBy("key").agg(F.min(_spot()).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    least_at = stored(least_at, "first-windows")  # as above: a window that many texts share can be split
    met = rows.join(least_at, "key").where(_spot() != F.col("first"))
    met = met.select(*SPOT, *[F.col(f"first.{c}").alias(f"p_{c}") for c in SPOT]).distinct()
    return _runs(met, least)


def _runs(pairs: DataFrame, size: int) -> DataFrame:
    """Equal stretches of ``size`` words on one diagonal of two texts, joined where they overlap or touch."""
    pair = [*TEXT, "p_doc_id", "p_text_key", "diagonal"]
    along = Window.partitionBy(*pair).orderBy("pos")  # within one text
    rows = pairs.withColumn("diagonal", F.col("pos") - F.col("p_pos"))
    rows = rows.withColumn("gap", F.coalesce(F.col("pos") - F.lag("pos").over(along) > size, F.lit(True)).cast("int"))
    rows = rows.withColumn("piece", F.sum("gap").over(along))
    return rows.groupBy(*pair, "piece").agg(F.min("pos").alias("start"), (F.max("pos") + size).alias("stop"))


def _contexts(docs: DataFrame, wanted: DataFrame, reach: int, reach_alone: int) -> DataFrame:
    """For each run of ``wanted`` (run, side, doc_id, text_key, start, stop): a digest of its words and hashes of up
    to ``reach`` words before (nearest first) and after it, ``reach_alone`` for side 2.

    A stretch that many runs ask for is cut once and joined to them. The stretches of a text are dealt out by the ``PART``
    words that they start and stop in, which bounds a row whatever asks, and leave the worker ``BATCH`` at a time.
    """
    wanted = wanted.withColumn("far", F.when(F.col("side") == 2, reach_alone).otherwise(reach))
    place = [*TEXT, "start", "stop", "far"]
    parts = [F.floor(F.col(c) / PART).alias(f"{c}_part") for c in ("start", "stop")]
    asked = wanted.select(*place).distinct().groupBy(*TEXT, *parts).agg(F.collect_list(F.struct("start", "stop", "far")).alias("asked"))
    asked = stored(asked.select(*TEXT, "asked"), "asked")  # written, so that a text with many parts can be split
    d, t = "a_doc_id", "a_text_key"
    asked = asked.withColumnsRenamed({"doc_id": d, "text_key": t})
    match = docs["doc_id"].eqNullSafe(asked[d]) & (docs["text_key"] == asked[t])
    texts = docs.join(asked, match).select("text", *TEXT, "asked")

    def cut(frames):
        def codes(some):
            return [xxhash.xxh64_intdigest(w, 1) >> 1 for w in some]

        def frame(out):
            made = pd.DataFrame(out, columns=[*place, "body", "left", "right"])
            return made.astype({"doc_id": "Int64"})

        out = []
        for rows in frames:
            ids = [None if pd.isna(i) else int(i) for i in rows["doc_id"].astype("Int64")]
            for text, doc, key, runs in zip(rows["text"], ids, rows["text_key"], rows["asked"], strict=True):
                words = letter_words(text)
                for r in runs:
                    a, b, far = r["start"], r["stop"], r["far"]
                    body = hashlib.md5(b" ".join(words[a:b])).digest()
                    out.append((doc, key, a, b, far, body, codes(words[max(0, a - far) : a][::-1]), codes(words[b : b + far])))
                    if len(out) >= BATCH:
                        yield frame(out)
                        out = []
        if out:
            yield frame(out)

    schema = "doc_id long, text_key long, start long, stop long, far int, body binary, left array<long>, right array<long>"
    # rows that repeat are one text, so their stretches are cut more than once
    found = stored(texts.mapInPandas(cut, schema).dropDuplicates(place), "stretches")
    found = found.withColumnRenamed("doc_id", d)
    rest = [c for c in place if c != "doc_id"]
    both = wanted.join(found, [F.col("doc_id").eqNullSafe(F.col(d)), *[wanted[c] == found[c] for c in rest]])
    return both.select("run", "side", "body", "left", "right")


def _agree(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    differ = F.transform(pairs, lambda x: F.coalesce(x["a"] != x["b"], F.lit(True)))
    return F.coalesce(F.nullif(F.array_position(differ, True), F.lit(0)) - 1, F.size(pairs)).cast("long")


def repeated_passages(docs: DataFrame, least: int = 50, gram: int = GRAM, spacing: int = SPACING) -> DataFrame:
    """One row per repeated passage: doc_id, start, length (in words), source_doc_id, source_start.

    A passage is a run of at least ``least`` words (lower-cased, between non-word characters) that stands earlier
    too: in a smaller doc_id (null first) or further up in the same text. The earliest occurrence has no row.

    1. Each text keeps the suffixes at its minimisers: of any ``spacing`` positions the one with the least hash of
    ``gram`` words. Two occurrences of a passage keep the same ones, the first within ``spacing`` - 1 words of its
    start, so both share the ``least - spacing + 1`` words that follow it: the hash of these is the sort key.
    2. All retained suffixes are sorted by range, then id and position, and neighbours are compared in a stream.
    3. Neighbours on one diagonal of two texts are one match; its words are compared in full by digest, and it is
    extended word by word to the left and the right, where the texts differ or after as many words as the key has.
    4. Matches of at least ``least`` words count. Each suffix meets the occurrence before it, so copies make as many
    matches as there are copies.
    5. The occurrence before may share less of a passage than an earlier one. So suffixes of one hash are told apart by
    the words around them, as many as a passage can reach beyond the key. A suffix after one of another kind is also
    set beside the first of its own kind, and the windows of ``least`` words around the first suffix of each kind
    beside their first occurrence, if there are three kinds or more (before the first suffix of the second of two
    kinds stands the first kind). With that, every word of every repeated passage is in a row (but for collisions
    of 64-bit hashes, which can only lose, never add); rows of a text may overlap.

    Only narrow rows are sorted; whole texts move once, to meet their matches. Texts of fewer than ``least`` words,
    null and empty ones have no rows. Rows of equal id and text are one text. Other columns are not used.
    """
    prefix = least - spacing + 1
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    slim = slim.where("text is not null")
    kept = stored(suffixes(slim, prefix, gram, spacing), "suffixes")
    order = ["h", *TEXT, "pos"]
    near = neighbours(kept.repartitionByRange(*order).sortWithinPartitions(*order))
    firsts = _firsts(near).withColumn("run", F.monotonically_increasing_id())
    firsts = stored(firsts.select("run", "h", "around", "first.*"), "firsts")
    before = [f"p_{c}" for c in SPOT]
    own = firsts.select("h", "around", *[F.col(c).alias(b) for c, b in zip(SPOT, before, strict=True)])
    own = near.where("p_around is not null").select("h", "around", *SPOT).join(own, ["h", "around"])
    own = own.where(_spot() != _spot("p_"))
    met = near.select(*SPOT, *before).unionByName(own.select(*SPOT, *before)).distinct()
    runs = stored(_runs(met, prefix).withColumn("run", F.monotonically_increasing_id()), "runs")
    later = runs.select("run", F.lit(0).alias("side"), *TEXT, "start", "stop")
    earlier = runs.select(
        "run", F.lit(1), F.col("p_doc_id"), F.col("p_text_key"), F.col("start") - F.col("diagonal"), F.col("stop") - F.col("diagonal")
    ).toDF(*later.columns)
    # written, so that the join reads two plain shuffles and adaptive execution can split a hash with many kinds
    many = stored(firsts.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 2").select("h"), "many-kinds")
    alone = firsts.join(many, "h", "left_semi").select("run", F.lit(2), *TEXT, "pos", F.col("pos") + prefix).toDF(*later.columns)
    wanted = later.unionByName(earlier).unionByName(alone)
    around = stored(_contexts(slim, wanted, prefix - 1, spacing - 1), "contexts")
    mine, other = around.where("side = 0").alias("m"), around.where("side = 1").alias("o")
    both = mine.join(other, (F.col("m.run") == F.col("o.run")) & (F.col("m.body") == F.col("o.body")))
    both = both.select("m.run", _agree(F.col("m.left"), F.col("o.left")).alias("l"), _agree(F.col("m.right"), F.col("o.right")).alias("r"))
    found = runs.join(both, "run")
    out = found.select(
        "doc_id", (F.col("start") - F.col("l")).alias("start"), (F.col("stop") - F.col("start") + F.col("l") + F.col("r")).alias("length"),
        F.col("p_doc_id").alias("source_doc_id"), (F.col("start") - F.col("diagonal") - F.col("l")).alias("source_start"), "text_key",
    )
    out = out.where(F.col("length") >= least)
    more = _repeated_windows(firsts.drop("h", "around"), around.where("side = 2").drop("side"), prefix, least)
    more = more.select(
        "doc_id", "start", (F.col("stop") - F.col("start")).alias("length"), F.col("p_doc_id").alias("source_doc_id"),
        (F.col("start") - F.col("diagonal")).alias("source_start"), "text_key",
    )
    both = out.withColumn("kind", F.lit(0)).unionByName(more.withColumn("kind", F.lit(1)))
    so_far = Window.partitionBy(*TEXT).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("start") + F.col("length")
    both = both.withColumn("covered", F.max(F.when(F.col("kind") == 0, end)).over(so_far))
    return both.where((F.col("kind") == 0) | F.col("covered").isNull() | (F.col("covered") < end)).drop("kind", "covered")


def remove_passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """``docs`` without the words of repeated passages; the earliest occurrence stays, all rows and columns stay."""
    doc, key, spans = fresh(docs, "p_doc", "p_key", "spans")
    found = repeated_passages(docs.select("doc_id", "text"), least)
    span = F.struct(F.col("start").alias("s"), (F.col("start") + F.col("length")).alias("e"))
    found = found.groupBy(*TEXT).agg(F.collect_set(span).alias(spans)).withColumnsRenamed({"doc_id": doc, "text_key": key})
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(key))
    out = docs.join(found, match, "left")
    cut = without_words(F.col("text"), F.col(spans))
    return out.withColumn("text", cut).select(*[F.col(f"`{c}`") for c in docs.columns])
