"""Near-duplicates by shingle similarity: SimHash links and MinHash bands find candidates, whole shingle sets decide."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructType

from ledgerloom.llm import simhash
from ledgerloom.llm.common import components, fresh
from ledgerloom.session import stored

SHINGLE, ALIKE = 5, 0.8  # words of a shingle, least Jaccard similarity of a link
BANDS, ROWS = 20, 5  # keys of a text, minima in a key: texts at 0.8 share a key with a chance of 0.9996
WHOLE = 8  # sets of a key that are all compared with each other; of more, see ``rare_pairs`` and ``common_pairs``
RARE = 32  # sets, of those in large keys, that hold a shingle which may be compared with each other

_draw = np.random.default_rng(20)
_PLACES = _draw.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted; none without words.

    Words lie between ASCII white space, A-Z in lower case; fewer than ``SHINGLE`` words are one shingle.
    """
    parts = [] if text is None else text.encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    size, n = min(SHINGLE, len(parts)), len(parts)
    words = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, n)
    total = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        total += words[i : n - size + 1 + i] * _PLACES[i]
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(total ^ (total >> np.uint64(29)))


def band_keys(found: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of a set of shingles; none of an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):  # a long text in bounded memory
        block = found[at : at + 1024, None] * _TIMES + _PLUS
        np.minimum(least, block.min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


@F.pandas_udf(StructType().add("t", LongType()).add("v", ArrayType(LongType())))
def _signed(texts: pd.Series) -> pd.DataFrame:
    sets = [shingles(t) for t in texts]
    names = [np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64) for s in sets]
    return pd.DataFrame({"t": np.array(names, np.int64), "v": pd.Series([band_keys(s) for s in sets], dtype=object)})


@F.pandas_udf(BinaryType())
def _sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).tobytes() for t in texts], dtype=object)


def _alike(least: float, a: Column, b: Column) -> Column:
    @F.pandas_udf(BooleanType())
    def check(left: pd.Series, right: pd.Series) -> pd.Series:
        pairs = zip(left, right, strict=True)
        return pd.Series([jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in pairs], dtype=bool)

    return check(a, b)


def print_pairs(signed: DataFrame) -> DataFrame:
    """(a, b) of distinct shingle sets a < b that the fingerprints of operator 10 (``fp``) link: equal ones meet at their
    smallest set, those of 1 to 3 bits apart by its links, each between the smallest sets of two fingerprints."""
    kinds = stored(signed.select("fp", "t").distinct(), "print-kinds")
    least = stored(kinds.groupBy("fp").agg(F.min("t").alias("least")), "prints")
    equal = kinds.join(least, "fp").select("t", F.col("least").alias("u"))
    links = simhash.near_pairs(least.select("fp"))
    near = links.join(least.toDF("a", "t"), "a").join(least.toDF("b", "u"), "b").select("t", "u")
    met = equal.unionByName(near).where("t != u")
    return met.select(F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b")).distinct()


def candidates(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, b), (t)) of distinct shingle sets (``t``, with their keys ``v``): pairs a < b that share a key, and all sets
    of large keys, whose pairs are not all among them.

    Most keys stand alone and end at a minimum and a maximum that are combined before the shuffle. Up to ``WHOLE``
    sets of a key meet each other; in a larger one each meets the key's first set, by an order that differs from
    key to key, which joins a group of copies at the price of its size.
    """
    each = signed.select("t", F.explode("v").alias("v"))
    shared = each.groupBy("v").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a != b").select("v")
    near = stored(each.join(stored(shared, "shared-keys"), "v").select("v", "t").distinct(), "near")
    keys = near.groupBy("v").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("t", "v"), "t"))["t"].alias("first"))
    met = stored(near.join(stored(keys, "keys"), "v"), "met")  # written, so that a hot key can be split
    few = met.where(F.col("n") <= WHOLE).select("v", "t")
    pairs = few.join(few.withColumnRenamed("t", "u"), "v").where("t < u").select(F.col("t").alias("a"), F.col("u").alias("b"))
    many = met.where(F.col("n") > WHOLE)
    firsts = many.where("t != first").select(F.least("t", "first").alias("a"), F.greatest("t", "first").alias("b"))
    return pairs.unionByName(firsts).distinct(), many.select("t").distinct()


def prefixes(sets: DataFrame, alike: float) -> DataFrame:
    """(t, token, df, size, place) of the sets (t, s: hashes as bytes): the rarest shingles of each, from place 1 on, and
    how many sets hold them.

    Two sets of similarity ``alike`` share one of the first size - ceil(alike * size) + 1 shingles of either, in any one
    order of all shingles; the rarest come first, so that few sets meet at a shingle.
    """

    def cut(frames):
        for frame in frames:
            for t, raw in zip(frame["t"], frame["s"], strict=True):
                found = np.frombuffer(raw, np.uint64).view(np.int64)
                yield pd.DataFrame({"t": np.full(len(found), t, np.int64), "token": found, "size": np.full(len(found), len(found), np.int64)})

    tokens = stored(sets.select("t", "s").mapInPandas(cut, "t long, token long, size long"), "shingles")
    df = stored(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shingle-counts")
    ranked = tokens.join(df, "token", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("t").orderBy("df", "token"))
    # a little lower than the product, so that rounding never shortens a prefix
    length = F.col("size") - F.ceil(F.col("size") * (alike - 1e-9)) + 1
    return ranked.withColumn("place", place).where((F.col("place") <= length) & (F.col("df") > 1)).select("t", "token", "df", "size", "place")


def _meetings(left: DataFrame, right: DataFrame, alike: float) -> DataFrame:
    """Pairs at a token of sets in different groups that may be ``alike``; (a, b) with a < b.

    From the first shared shingle on, both sets must still hold as many as a pair of their sizes has to share. At a
    later one this counts too few, but then the pair is met at its first as well. Rows of a set lie side by side and are
    stored in few bytes, from which Spark would take them as small enough to broadcast.
    """
    other = right.select(
        "token", F.col("t").alias("u"), F.col("size").alias("size2"), F.col("place").alias("place2"), F.col("group").alias("group2")
    )
    shared = (F.col("size") + F.col("size2")) * (alike / (1 + alike)) - 1e-6
    rest = F.least(F.col("size") - F.col("place"), F.col("size2") - F.col("place2")) + 1
    met = left.join(other.hint("merge"), "token").where((F.col("t") != F.col("u")) & (F.col("group") != F.col("group2")) & (rest >= shared))
    return met.select(F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b")).distinct()


def rare_pairs(rows: DataFrame, alike: float) -> DataFrame:
    """Pairs of different groups that meet at a shingle of at most ``RARE`` sets; rows of ``prefixes`` with their group."""
    few = rows.where(F.col("df") <= RARE)
    return _meetings(few, few, alike)


def common_pairs(rows: DataFrame, alike: float) -> DataFrame:
    """Pairs of different groups that meet at a more common shingle. Here four fifths of a set are shingles that many sets
    hold, so it is mostly one large group of copies; only sets outside the shingle's largest group look for others."""
    many = rows.where(F.col("df") > RARE)
    sizes = many.groupBy("token", "group").agg(F.count("*").alias("n")).groupBy("token")
    main = stored(sizes.agg(F.max(F.struct("n", "group"))["group"].alias("main")), "main-groups")
    outside = stored(many.join(main, "token").where(F.col("group") != F.col("main")).drop("main"), "outside")
    return _meetings(outside, many, alike)


def drop_similar(docs: DataFrame, alike: float = ALIKE) -> DataFrame:
    """``docs`` with one row of each group of similar texts: its smallest doc_id, null ids last, then the smallest text by MD5.

    Texts link when the Jaccard similarity of their sets of five-word shingles is ``alike`` or more; links are
    transitive. Every candidate pair is checked on its whole sets, so no text goes without a link. Candidates are linked
    by the SimHash fingerprints of operator 10 (3 bits at most), or they share a MinHash key. In a key of many sets each is first compared with one of them only; then the sets of such keys are
    searched exactly: pairs of different groups that share one of their rarest shingles. Texts of one set,
    also all without words, are one group. Repeated rows are one candidate and leave one row. Columns pass
    unchanged, whatever their names; maps, which can't be compared, are not allowed.
    """
    names = fresh(docs, "n", "d", "t", "h")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    text = F.col("text").cast("string")
    key = [
        F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)).cast("long"), F.md5(F.coalesce("text", F.lit(""))),
        F.xxhash64(*columns),
    ]
    keyed = docs.withColumns(dict(zip(names, key, strict=True)))
    printed = simhash.fingerprints(keyed.select(text.alias("text"), *names))
    slim = stored(printed.select(F.struct(*names).alias("key"), "fp", _signed(F.col("text")).alias("s")), "signatures")
    slim = slim.select("key", "fp", "s.t", "s.v")
    kinds = stored(slim.groupBy("t").agg(F.min("key").alias("key")), "kinds")
    pairs, large = candidates(slim)
    pairs = stored(pairs.unionByName(print_pairs(slim)).distinct(), "pairs")
    large = stored(large, "large-keys")

    wanted = pairs.select(F.col("a").alias("t")).unionByName(pairs.select(F.col("b").alias("t"))).distinct()
    wanted = stored(kinds.join(wanted, "t").select(F.col("t").alias("set_of"), "key.*"), "wanted")
    (name,) = fresh(keyed, "set_of")
    texts = keyed.select(text.alias("text"), *names).join(wanted.withColumnRenamed("set_of", name), names)
    sets = stored(texts.select(F.col(name).alias("t"), _sets("text").alias("s")).dropDuplicates(["t"]), "sets")

    def checked(found: DataFrame) -> DataFrame:
        both = found.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
        return stored(both.where(_alike(alike, F.col("left"), F.col("right"))).select("a", "b"), "links")

    links = checked(pairs)
    joined = components(links)
    if not large.isEmpty():  # every set of a large key is in a pair, so its shingles are at hand
        group = joined.select(F.col("node").alias("t"), F.col("component").alias("group"))
        rows = prefixes(sets.join(large, "t", "left_semi"), alike).join(group, "t", "left")
        rows = stored(rows.withColumn("group", F.coalesce("group", "t")), "prefixes")
        more = checked(stored(rare_pairs(rows, alike).unionByName(common_pairs(rows, alike)).distinct(), "more-pairs"))
        if not more.isEmpty():
            joined = components(links.unionByName(more))
    groups = kinds.join(joined, kinds["t"] == joined["node"], "left").select(F.coalesce("component", "t").alias("group"), "key")
    best = groups.groupBy("group").agg(F.min("key").alias("key")).select("key.*")
    return keyed.join(best, names, "left_semi").select(*columns).dropDuplicates()
