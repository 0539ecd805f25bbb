"""Periodic runs of words: suffix classes are united by decreasing common prefix, new neighbours seed the runs.

Kruskal's order: pairs of neighbouring suffixes are the edges, heaviest (longest common prefix) first. Each class keeps
its positions in order. When two classes unite over a prefix of l words, positions x < y of different classes that
become neighbours agree on exactly l words, so with y - x <= l the text has period y - x from x on for l + y - x words.
The two first repetitions of a run are never kept apart by a third position, so every run is seeded at its own start.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOUND = (
    "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start:long,length:long,period:long>>, collapsed string"
)
TOGETHER = 200_000  # words of short texts that are sorted together; a longer text is sorted alone, but whole


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8; none for a null text."""
    return [] if text is None else text.encode("utf-8", "replace").split()


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten with a periodic tail, by the CRC-32 of its id; a null id keeps its words."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


class Suffixes:
    """Ranks of the suffixes of number sequences by prefixes of 1, 2, 4, ... words; sequences never share a rank.

    A rank is the place of its class's first suffix. Only classes of two and more are sorted again, until there is
    none, so unlike texts end after a few steps.
    """

    def __init__(self, sequences: list[list[bytes]]):
        codes: list[int] = []
        used = 0
        for words in sequences:  # own numbers for each sequence, then a number that ends it
            own: dict[bytes, int] = {}
            codes += [own.setdefault(w, used + len(own)) for w in words]
            codes.append(used + len(own))
            used += len(own) + 1
        self.codes = np.array(codes, np.int64)
        counts = np.bincount(self.codes, minlength=1)
        rank = (np.cumsum(counts) - counts)[self.codes]
        active = np.flatnonzero(counts[self.codes] > 1)
        self.levels, size = [rank], 1
        while len(active):
            old, then = rank[active], rank[active + size]
            order = np.lexsort((then, old))
            active, old, then = active[order], old[order], then[order]
            head = np.ones(len(active), bool)  # first of an old class
            head[1:] = old[1:] != old[:-1]
            new = head.copy()
            new[1:] |= then[1:] != then[:-1]
            at = np.arange(len(active))
            fresh = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
            rank = rank.copy()
            rank[active] = fresh
            self.levels.append(rank)
            alone = new & np.append(new[1:], True)
            active, size = active[~alone], 2 * size

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that suffixes a and b have in common, from the highest level down."""
        total = np.zeros(len(a), np.int64)
        last = len(self.codes) - 1
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            equal = (a + total <= last) & (b + total <= last)
            equal &= rank[np.minimum(a + total, last)] == rank[np.minimum(b + total, last)]
            total += equal.astype(np.int64) << k
        return total

    def edges(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, common words) of neighbouring suffixes that share ``least`` words or more, longest first."""
        level = min(max(0, least.bit_length() - 1), len(self.levels) - 1)
        rank = self.levels[level]
        size = np.bincount(rank, minlength=1)
        place = np.flatnonzero(size[rank] > 1)
        place = place[np.argsort(self.levels[-1][place], kind="stable")]
        a, b = place[:-1], place[1:]
        both = self.common(a, b)
        order = np.flatnonzero(both >= least)
        order = order[np.argsort(-both[order], kind="stable")]
        return a[order], b[order], both[order]


def seeds(a: np.ndarray, b: np.ndarray, common: np.ndarray):
    """(x, y, common words) of positions x < y as they become neighbours within a class; edges heaviest first."""
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    for i, j, size in zip(a.tolist(), b.tolist(), common.tolist(), strict=True):
        for x in (i, j):
            if x not in parent:
                parent[x], members[x] = x, [x]
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        while parent[j] != j:
            parent[j] = parent[parent[j]]
            j = parent[j]
        if len(members[i]) < len(members[j]):
            i, j = j, i
        large, small = members[i], members.pop(j)
        parent[j] = i
        for k, x in enumerate(small):
            at = bisect_left(large, x)
            if at and (not k or large[at - 1] > small[k - 1]):
                yield large[at - 1], x, size
            if at < len(large) and (k + 1 == len(small) or large[at] < small[k + 1]):
                yield x, large[at], size
        if len(small) * 8 < len(large):
            for x in small:
                insort(large, x)
        else:
            large += small
            large.sort()


def runs(sequences: list[list[bytes]], exponent: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """Per sequence its runs (start, length, period) in order: smallest period q, at least max(``least``, ``exponent`` * q)
    words, not extensible on either side. ``exponent`` is 2 or more."""
    suffixes = Suffixes(sequences)
    ends = np.cumsum([len(s) + 1 for s in sequences])
    out: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    codes = suffixes.codes
    # The first repetition leaves length - q words in common: at least (exponent - 1) q, and at least ``least`` - q.
    shared = min(max((exponent - 1) * q, least - q) for q in range(1, least + 1))
    for x, y, size in seeds(*suffixes.edges(max(1, shared))):
        q = y - x
        if (exponent - 1) * q > size or size + q < least or (x and codes[x - 1] == codes[y - 1]):
            continue
        k = int(np.searchsorted(ends, x, "right"))
        out[k].append((x - (int(ends[k - 1]) if k else 0), size + q, q))
    return [sorted(found, key=lambda r: (r[0], r[2])) for found in out]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


def _row(words: list[bytes], found: list[tuple[int, int, int]], full: bool) -> tuple:
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (None, None, None, None) if best is None else (*best, 1000 * best[1] // best[2])
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    text = b" ".join(collapsed(words, found))
    digests = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest())
    more = ([{"start": s, "length": n, "period": q} for s, n, q in found], text.decode("utf-8")) if full else (None, None)
    return len(found), *head, *digests, *more


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6, plant: bool = False, full: bool = True, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with a column ``found``: its periodic runs of words and the text without repetitions.

    ``found`` holds n_runs, the longest run (start, length, period, exponent_milli; ties: smallest start, then period;
    nulls without a run), runs_sha256 over lines "start,length,period", collapsed_sha256, and with ``full`` the runs
    themselves and the collapsed text. ``plant`` first gives one document in ten a periodic tail (``planted``).

    Each text is read whole in its own row and nothing is shuffled; a task holds the suffix ranks of one long text, or of
    some short ones with ``TOGETHER`` words in all, about log2 of the longest repeat times eight bytes a word. Null
    and empty texts have no words and no run; a null doc_id plants nothing; repeated rows are each searched; an empty
    table gives an empty result. A column ``found`` of ``docs`` is replaced, all others pass unchanged.
    """
    if exponent < 2:
        raise ValueError("exponent must be 2 or more")

    @F.pandas_udf(FOUND)
    def search(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out: list[tuple] = []
        group: list[list[bytes]] = []
        held = 0

        def flush() -> None:
            out.extend(_row(w, r, full) for w, r in zip(group, runs(group, exponent, least), strict=True))
            group.clear()

        for doc, value in zip(ids, texts, strict=True):
            words = words_of(value)
            if plant:
                words = planted(None if pd.isna(doc) else int(doc), words)
            if group and held + len(words) > TOGETHER:
                flush()
                held = 0
            group.append(words)
            held += len(words)
        flush()
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])
        for c in ("start", "length", "period", "exponent_milli"):
            frame[c] = frame[c].astype("Int64")
        return frame

    ids = F.col("doc_id").cast("long") if plant else F.lit(None).cast("long")
    # As decimal texts, so that large ids stay exact where some are null.
    return docs.withColumn("found", search(ids.cast("string"), F.col(text).cast("string")))
