"""Pieces that several operators share: word splitting, span merging and connected components."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stored

# Bytes that separate words become blanks, A-Z become a-z; bytes of non-ASCII characters stay.
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def letter_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of letters, digits and non-ASCII characters, as UTF-8; none for a null text."""
    return [] if text is None else text.encode("utf-8", "replace").translate(_LETTERS).split()


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``rows`` has."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans in order, overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long): component is the smallest node reachable.

    Alternating large-star and small-star steps: each links every node to the smallest one it sees, until
    nothing changes, after about log n steps. Minima are combined before the shuffle and written; the way back is a plain
    join whose large partitions adaptive execution splits, so a hub needs no task of its own. Each state is a
    table in the shared folder. Nulls and loops are ignored; without edges the result is empty.
    """

    def star(pairs: DataFrame, both: bool) -> DataFrame:
        if both:
            pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = stored(least, "least")  # a plain table under the join, so that a hub can be split
        seen = pairs.join(least, "a")
        out = seen.where(F.col("b") > F.col("a")) if both else seen.where(F.col("b") != F.col("m"))
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not both:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.distinct()

    def state(pairs: DataFrame) -> tuple[DataFrame, tuple]:
        kept = stored(pairs, "stars")
        return kept, tuple(kept.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b"))).first())

    long = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b")
    pairs, mark = state(long.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if not mark[0]:
            break
        before = mark
        pairs, mark = state(star(star(pairs, True), False))
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle; raise rounds")
    roots = pairs.select(F.col("b").alias("node")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
