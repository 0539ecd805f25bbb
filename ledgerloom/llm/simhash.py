"""SimHash near-duplicates: meet-in-the-middle ball hashing over 64-bit fingerprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ledgerloom.llm.common import components, fresh
from ledgerloom.session import stored

BITS = 64
BLOCKS = 4  # of which one may be left out of a key


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The text's SimHash as a signed 64-bit number; zero without words.

    Words lie between ASCII white space, A-Z in lower case; each shingle of ``words`` words (all words if fewer)
    votes with the bits of its XXH64; a bit is set if it is in over half of the shingles, repeats included.
    """
    parts = [] if text is None else text.encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    size = min(words, len(parts))
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(size)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), "<u8")
    votes, step = np.zeros(BITS, np.int64), 1 << 16
    for at in range(0, len(hashes), step):  # bit counts of a long text in bounded memory
        block = hashes[at : at + step].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``fp`` (long); one of that name is replaced. A null text counts as empty."""
    return docs.withColumn("fp", _fingerprints(F.col(text).cast("string")))


def _flips(value: Column, bits: Column) -> Column:
    """The value itself and with each one of ``bits`` (an array of masks) flipped."""
    return F.concat(F.array(value), F.transform(bits, lambda b: value.bitwiseXOR(b)))


def _masks(bits) -> Column:
    ones = [1 << b for b in bits]
    return F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in ones])


def near_pairs(found: DataFrame) -> DataFrame:
    """Links between distinct fingerprints (``fp``: long) whose components are those of all pairs with 1 to 3 bits apart.

    Two fingerprints at distance d meet at a variant in the middle. Up to distance 2 both reach it with one flip:
    each emits its 65 variants, and all that meet at one variant (65 at most) are within 2 bits of each other, so the
    smallest stands for them. At distance 3 one flip from either side leaves one bit over: that bit lies in one
    of four blocks of 16 bits, so a second key leaves out a block and holds one flip at most in the other 48 bits
    (4 x 49 variants instead of the 2,081 within two flips). Distance 3 changes the parity of the bit count:
    even fingerprints meet odd ones only, pairs that the first step has already joined are passed over, and each
    pair that meets is checked by its bits. Both steps shuffle variants of distinct fingerprints only; Spark sizes them like
    the fingerprints they come from, so that the join is told to merge, else the driver would get all of them to broadcast.
    """
    every = _masks(range(BITS))
    ball = found.select("fp", F.explode(_flips(F.col("fp"), every)).alias("v"))
    ball = ball.withColumn("least", F.min("fp").over(Window.partitionBy("v")))
    close = stored(ball.where("fp != least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct(), "close")
    joined = components(close)
    classes = found.join(joined, found["fp"] == joined["node"], "left")
    classes = stored(classes.select("fp", F.coalesce("component", "fp").alias("c")), "classes")

    size = BITS // BLOCKS
    keys = []
    for k in range(BLOCKS):
        own = range(k * size, (k + 1) * size)
        block = sum(1 << b for b in own)
        outside = ~block if block < 1 << 63 else -1 ^ (block - (1 << 64))
        kept = F.col("fp").bitwiseAND(F.lit(outside).cast("long"))
        flips = _masks(b for b in range(BITS) if b not in own)
        keys.append(_flips(kept, flips))
    wide = classes.select("fp", "c", F.explode(F.concat(*keys)).alias("v"))
    odd = F.bit_count("fp") % 2 == 1
    left = wide.where(~odd).alias("l")
    right = wide.where(odd).alias("r")
    apart = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp")))
    met = left.join(right.hint("merge"), (F.col("l.v") == F.col("r.v")) & (F.col("l.c") != F.col("r.c")) & (apart <= 3))
    across = met.select(F.col("l.c").alias("a"), F.col("r.c").alias("b")).distinct()
    return close.unionByName(across)


def near_components(prints: DataFrame) -> DataFrame:
    """(fp, group) of every distinct fingerprint: group is the smallest fingerprint that links of 3 bits reach."""
    found = stored(prints.select("fp").distinct(), "fingerprints")
    joined = components(near_pairs(found))
    both = found.join(joined, found["fp"] == joined["node"], "left")
    return both.select("fp", F.coalesce("component", "fp").alias("group"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every document's doc_id, fp and component_id: the smallest doc_id among all that links reach.

    Documents link when their fingerprints differ in 3 bits at most. Copies share a fingerprint and meet only in
    sums per fingerprint; empty and null texts have fingerprint zero and link like any other. A null doc_id
    takes part in its group but never names it; a group of null ids only has a null component. An empty table gives
    an empty result; other columns are not used.
    """
    prints = stored(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "fp"), "prints")
    groups = stored(near_components(prints), "groups")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("m")).join(groups, "fp")
    names = least.groupBy("group").agg(F.min("m").alias("component_id"))
    named = groups.join(names, "group").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: its smallest doc_id, null ids last, then the smallest text by MD5.

    Repeated rows are one candidate and leave one row. Columns pass unchanged, whatever their names; maps, which
    can't be compared, are not allowed.
    """
    names = fresh(docs, "n", "d", "t", "h")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = [
        F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)).cast("long"), F.md5(F.coalesce("text", F.lit(""))),
        F.xxhash64(*columns),
    ]
    keyed = docs.withColumns(dict(zip(names, key, strict=True)))
    slim = stored(fingerprints(keyed.select("text", *names)).select("fp", F.struct(*names).alias("key")), "prints")
    groups = stored(near_components(slim), "groups")
    best = slim.groupBy("fp").agg(F.min("key").alias("key")).join(groups, "fp")
    best = best.groupBy("group").agg(F.min("key").alias("key")).select("key.*")
    return keyed.join(best, names, "left_semi").select(*columns).dropDuplicates()
