"""Best-fit packing of token sequences after a reduction by dominance.

The instance is the histogram of piece lengths: at most ``capacity`` sizes with their counts, whatever the corpus
holds. Reduction and best fit run on that histogram and give a list of placements, each for a whole range of equal
pieces; pieces are then numbered within their length on the cluster and look their place up.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.tokens import CACHE, LONGEST, STRANGE, kept, special, tokenizer
from ledgerloom.session import stored

PIECE = "piece int, start long, length long, ids_crc32 long"


# A word of Latin letters, each lower-cased one to one, with closing punctuation: two pre-tokens at most.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([,.;:!?%#$*&|)]*)")


class WordIds:
    """Token ids, as little-endian 32-bit bytes, of a vocabulary that drops white space and case and marks word ends.

    Words between white space are encoded on their own and kept in a cache of two generations: when the younger is
    full it becomes the older one, and a word of the older that is met again moves up. What a group of texts lacks is
    encoded together: words that differ in case or closing punctuation only share their letters, and letters are joined
    to one text whose ids are cut where a token ends a word. Texts with a special token string or a separator control
    character go whole through the library.
    """

    TOGETHER = 1 << 22  # characters of texts that are looked up together; a longer text is looked up alone

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.special = special(self.library)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _each(self, words: list[str]) -> list[bytes]:
        codes = self.library.encode_batch_fast(words, add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in codes]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of words that are one pre-token each; one by one if their ends don't tell them apart."""
        out: list[bytes] = []
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):
                out += self._each(part)
                continue
            raw, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
            out += [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        new = {w: self.old[w] for w in words if w in self.old}
        words = [w for w in words if w not in new]
        plain = [PLAIN.fullmatch(w) for w in words]
        other = [w for w, m in zip(words, plain, strict=True) if m is None]
        letters = [m[1].lower() for m in plain if m]
        closing = [m[2] for m in plain if m]
        of = self._letters(set(letters))
        ends = list(set(closing))
        tail = dict(zip(ends, self._each(ends), strict=True))
        new.update((m[0], of[x] + tail[y]) for m, x, y in zip(filter(None, plain), letters, closing, strict=True))
        new.update(zip(other, self._each(other), strict=True))
        self.known.update((w, ids) for w, ids in new.items() if len(w) <= LONGEST)
        return new

    def _letters(self, letters: set[str]) -> dict[str, bytes]:
        """Ids of lower-cased letters, which are words themselves and kept as such."""
        of: dict[str, bytes] = {}
        for x in letters:
            ids = self.known.get(x) or self.old.get(x)
            if ids:
                of[x] = ids
        lacking = list(letters.difference(of))
        new = dict(zip(lacking, self._joined(lacking), strict=True))
        self.known.update((x, ids) for x, ids in new.items() if len(x) <= LONGEST)
        return of | new

    def _group(self, texts: list[str]) -> list[bytes]:
        """Splits the group in one go and looks every different word up once; the words' ids, laid end to end, are cut
        where the texts end."""
        if len(self.known) > CACHE:
            self.known, self.old = {}, self.known
        whole = [any(s in t for s in self.special) or STRANGE.search(t) is not None for t in texts]
        split = pc.utf8_split_whitespace(pa.array(["" if w else t for t, w in zip(texts, whole, strict=True)], pa.large_string()))
        words = split.flatten().dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, different))
        lacking = [i for i, ids in enumerate(found) if ids is None]
        if lacking:
            new = self._learn([different[i] for i in lacking])
            for i in lacking:
                found[i] = new[different[i]]
        ids = pa.array(found, pa.large_binary()).take(words.indices)
        _, ends, raw = ids.buffers()
        cuts = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()].tolist()
        raw = memoryview(raw or b"")
        parts = zip(texts, whole, cuts, cuts[1:], strict=False)
        return [self._each([t])[0] if w else raw[i:j].tobytes() for t, w, i, j in parts]

    def many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; none for a null text."""
        out: list[bytes] = []
        group: list[str] = []
        held = 0
        for text in texts:
            if group and held + len(text or "") > self.TOGETHER:
                out += self._group(group)
                group, held = [], 0
            group.append(text or "")
            held += len(group[-1])
        return out + self._group(group) if group else out


def pieces(docs: DataFrame, encoder: Callable, capacity: int, end: int, text: str = "text", ids: bool = False) -> DataFrame:
    """One row per piece: the columns of ``docs`` but the text, then piece, start, length, ids_crc32 and, with
    ``ids``, the ids themselves as bytes.

    ``encoder()`` gives in each worker an object whose ``many`` turns texts into their ids as little-endian 32-bit bytes;
    the id ``end`` is appended. A document of more than ``capacity`` ids is cut into pieces of that many, the last may be
    shorter. A null or empty text is the one id ``end``.
    """
    tag, last = os.urandom(8).hex(), np.asarray([end], "<u4").tobytes()
    kind = f"array<struct<{PIECE.replace(' ', ':')}{',ids:binary' if ids else ''}>>".replace(",:", ",")

    @F.pandas_udf(kind)
    def cut(texts: pd.Series) -> pd.Series:
        encode = kept(tag, encoder)
        out = []
        for raw in encode.many(texts.tolist()):
            raw += last
            row = []
            for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at : at + 4 * capacity]
                one = {"piece": i, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                row.append(one | {"ids": part} if ids else one)
            out.append(row)
        return pd.Series(out, dtype=object)

    own = {"piece", "start", "length", "ids_crc32", "ids", text}
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*rest, F.explode(cut(F.col(text).cast("string"))).alias("_p")).select(*rest, "_p.*")


@dataclass(frozen=True)
class Placement:
    """Pieces of one length, from ``rank`` on (``count`` of them), ``each`` to a bin, in bins from ``bin`` on, at ``offset``."""

    length: int
    rank: int
    count: int
    each: int
    bin: int
    offset: int


def reduction(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins (lengths, how many such bins) that some best packing has; what they take is taken out of ``counts``.

    For a largest size j left, a set that holds j dominates another if the other's items can be parted so that
    each part fits in place of one item of the set. A size is fixed with
    1. nothing, if nothing fits beside it;
    2. a piece that fills the bin;
    3. the largest that fits beside it, k, if no two do;
    4. k, if three do not fit and no two together are longer than k;
    5. the pair (k, b), b the largest that fits beside j and k, if three do not fit and no two longer than b do.
    Each removal leaves fewer pieces, so rules that held go on holding for further equal sets. Passes repeat
    until one fixes nothing; what is left is the remainder.
    """
    sizes = sorted(counts)
    bins: list[tuple[tuple[int, ...], int]] = []

    def take(items: tuple[int, ...], n: int) -> None:
        bins.append((items, n))
        for x in set(items):
            counts[x] -= n * items.count(x)
            if not counts[x]:
                del counts[x]
                del sizes[bisect_left(sizes, x)]

    def smallest(j: int, n: int, above: int = 0) -> list[int]:
        """The n smallest pieces beside one j, of sizes over ``above``."""
        out: list[int] = []
        for x in sizes[bisect_right(sizes, above) :]:
            out += [x] * min(n - len(out), counts[x] - (x == j))
            if len(out) >= n:
                break
        return out

    def largest(j: int, room: int, also: int = 0) -> int:
        """The largest size of at most ``room`` that is left beside j and ``also``; 0 if none."""
        for x in reversed(sizes[: bisect_right(sizes, room)]):
            if counts[x] > (x == j) + (x == also):
                return x
        return 0

    def best_pair(j: int, room: int) -> int:
        best, low, high = 0, 0, len(sizes) - 1
        while low <= high:
            a, b = sizes[low], sizes[high]
            if a + b > room or counts[b] == (b == j):
                high -= 1
                continue
            if counts[a] > (a == j) + (a == b):
                best = max(best, a + b)
            low += 1
        return best

    def beside(j: int) -> tuple[int, ...] | None:
        room = capacity - j
        k = largest(j, room)
        two = smallest(j, 2)
        if not k or k == room:
            return (k,) if k else ()
        if len(two) < 2 or sum(two) > room:
            return (k,)
        three = smallest(j, 3)
        if len(three) == 3 and sum(three) <= room:
            return None
        if best_pair(j, room) <= k:
            return (k,)
        b = largest(j, room - k, k)
        over = smallest(j, 2, b)
        return (k, b) if b and (len(over) < 2 or sum(over) > room) else None

    changed = True
    while changed:
        changed = False
        for j in list(reversed(sizes)):
            while j in counts and (items := beside(j)) is not None:
                whole = (j, *items)
                take(whole, min(counts[x] // whole.count(x) for x in set(whole)))
                changed = True
    return bins


def best_fit(counts: dict[int, int], capacity: int, bins: list[tuple[tuple[int, ...], int]]) -> list[Placement]:
    """Placements of the fixed ``bins`` and of all that ``counts`` still holds, best fit from the largest size down.

    Open bins of equal room are one group, and a size goes at once into as many bins of the tightest group as it
    fills, so the work follows the number of sizes, not of pieces.
    """
    out: list[Placement] = []
    rank: dict[int, int] = {}
    made = 0

    def place(length: int, count: int, each: int, first: int, offset: int) -> None:
        out.append(Placement(length, rank.get(length, 0), count, each, first, offset))
        rank[length] = rank.get(length, 0) + count

    for items, n in bins:
        offset = 0
        for x in items:
            place(x, n, 1, made, offset)
            offset += x
        made += n
    groups: list[tuple[int, int, int]] = []  # room, first bin, bins
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(groups, (size, 0, 0))
            if at < len(groups):
                room, first, n = groups.pop(at)
            else:
                room, first, n = capacity, made, max(1, -(-left // (capacity // size)))
                made += n
            each = min(room // size, left)
            full = min(n, left // each)
            place(size, full * each, each, first, capacity - room)
            left -= full * each
            if room - each * size:
                insort(groups, (room - each * size, first, full))
            if full < n:
                insort(groups, (room, first + full, n - full))
    return out


def number_equal(rows: DataFrame, key: str, order: list[str], name: str, target: int = 1 << 20) -> DataFrame:
    """``rows`` with their number from 0 within each value of ``key``, which may hold any share of them.

    Rows are dealt by a hash of ``order`` into buckets of about ``target`` rows (at least 256 buckets), counted per
    key and bucket before the shuffle, numbered in each, and shifted by the buckets before. Rows that agree in
    ``order`` and ``key`` may swap numbers.
    """
    buckets = max(256, -(-rows.count() // target))
    cut = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    starts = starts.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1
    numbered = cut.withColumn("_local", local).join(starts, [key, "_bucket"])
    return numbered.withColumn(name, F.col("_start") + F.col("_local")).drop("_bucket", "_start", "_local")


def pack(rows: DataFrame, capacity: int = 4096) -> DataFrame:
    """``rows`` (doc_id, piece, length, ...) with sequence_id and offset: as few sequences as best fit needs.

    Lengths are 1 to ``capacity``; an empty table gives an empty result, repeated rows are packed each. The driver
    sees one row per length, at most ``capacity``. Sequences are filled from 0 without gaps.
    """
    counts = {int(r.length): r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit(counts, capacity, reduction(counts, capacity))
    plan = sorted(plan, key=lambda p: (p.length, p.rank))
    table = rows.sparkSession.sparkContext.broadcast(
        np.array([(p.length, p.rank, p.each, p.bin, p.offset) for p in plan], np.int64).reshape(-1, 5)
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        t, size, rank = table.value, length.to_numpy(np.int64), number.to_numpy(np.int64)
        if not len(size):
            return pd.DataFrame({"sequence_id": size, "offset": size})
        first = np.searchsorted(t[:, 0], size)  # the placements of a length, then the one that holds the number
        where = np.empty(len(size), np.int64)
        for x in np.unique(size):
            mine = size == x
            low, high = np.searchsorted(t[:, 0], [x, x + 1])
            where[mine] = low + np.searchsorted(t[low:high, 1], rank[mine], "right") - 1
        assert (where >= first).all()
        nth = rank - t[where, 1]
        each = t[where, 2]
        return pd.DataFrame({"sequence_id": t[where, 3] + nth // each, "offset": t[where, 4] + nth % each * size})

    numbered = number_equal(rows, "length", ["doc_id", "piece", "ids_crc32"], "_rank")
    out = numbered.withColumn("_at", place("length", "_rank"))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are encoded once; what is written and shuffled are the narrow piece rows. Null texts are empty documents;
    a null doc_id is a document like any other; columns besides doc_id and text are not used.
    """
    slim = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return pack(stored(pieces(slim, lambda: WordIds(path), capacity, end), "pieces"), capacity)


def sequences(rows: DataFrame) -> DataFrame:
    """Packed sequences from rows with ids, sequence_id and offset: sequence_id, length, ids (bytes).

    A sequence has at most the capacity's ids, so one row and one group are bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    got = rows.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_parts"))
    joined = F.aggregate(F.transform("_parts", lambda x: x["ids"]), F.lit(b""), lambda a, x: F.concat(a, x))
    return got.select("sequence_id", "length", joined.alias("ids"))
