"""Benchmark decontamination: a broadcast hash set of test windows, scanned over training texts."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.llm.common import fresh, letter_words, merged
from ledgerloom.session import stored

_FOUND = "n_words long, starts array<long>, ends array<long>, items array<long>"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def test_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct (window, item_id): all windows of ``n`` words of each item; a shorter item is one window."""

    def cut(frames):
        for frame in frames:
            rows = []
            for item, text in zip(frame["item_id"], frame["text"], strict=True):
                words = letter_words(text)
                size = min(n, len(words))
                grams = {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if size else ()
                rows.extend((g.decode("utf-8"), None if pd.isna(item) else int(item)) for g in grams)
            yield pd.DataFrame(
                {"window": pd.Series([r[0] for r in rows], dtype=object), "item_id": pd.array([r[1] for r in rows], "Int64")}
            )

    slim = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInPandas(cut, "window string, item_id long").distinct()


class _Probe:
    """The hash set of one block of windows. Word runs outside the set's vocabulary are skipped at once."""

    def __init__(self, rows):
        self.windows = defaultdict(set)
        for window, item in rows:
            self.windows[window.encode("utf-8")].add(item)
        self.sizes = sorted({w.count(b" ") + 1 for w in self.windows})
        self.known = dict.fromkeys((word for w in self.windows for word in w.split()), 1)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        seen = np.fromiter(map(self.known.get, words, repeat(0)), np.int8, len(words))
        total = np.concatenate(([0], np.cumsum(seen, dtype=np.int64)))
        spans, items = [], set()
        for size in self.sizes:
            if size > len(words):
                break
            for i in np.flatnonzero(total[size:] - total[:-size] == size):
                hit = self.windows.get(b" ".join(words[i : i + size]))
                if hit is not None:
                    spans.append((int(i), int(i) + size))
                    items |= hit
        return merged(spans), {x for x in items if x is not None}


def _scan(probe) -> object:
    @F.pandas_udf(_FOUND)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = letter_words(text)
            spans, items = probe.value.find(words) if words else ([], set())
            rows.append((len(words), [s for s, _ in spans], [e for _, e in spans], sorted(items)))
        return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    return scan


def _merge(spans: Column) -> Column:
    """Spans joined where they overlap or touch, in order; linear in their number."""
    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        apart = (F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["e"] < x["s"])
        return F.when(apart, F.concat(acc, F.array(x))).otherwise(
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))
        )

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<s:bigint,e:bigint>>"), add)


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = 10, block: int = 200_000, leak: str = "leak"
) -> DataFrame:
    """Every row of ``docs`` with a column ``leak``: n_words, spans (s, e: word positions) and items hit.

    A document word is hit when it lies inside any occurrence of a test window (``n`` consecutive words, or all
    words of a shorter item). The windows are written once, cut by hash into blocks of about ``block`` rows, and
    each block is broadcast and scanned on its own, so a benchmark of any size is used whole and no broadcast
    grows with it. No text is shuffled. A null or empty text or item has no words; items with a null id mark
    words but are not listed; repeated items count once; an empty benchmark leaves every list empty. Columns
    of ``docs`` pass unchanged; ``leak`` is the new column's name, another can be given.
    """
    spark = docs.sparkSession
    windows = stored(test_windows(benchmark, n), "test-windows")
    blocks = max(1, -(-windows.count() // block))
    part = F.pmod(F.xxhash64("window"), F.lit(blocks))
    found = []
    for i in range(blocks):
        rows = [tuple(r) for r in windows.where(part == i).collect()]  # one block at a time
        found.append(_scan(spark.sparkContext.broadcast(_Probe(rows)))(F.col(text).cast("string")))
    names = fresh(docs, *[f"_found_{i}" for i in range(blocks)])
    out = docs.withColumns(dict(zip(names, found, strict=True)))
    zipped = [
        F.transform(F.arrays_zip(f"{c}.starts", f"{c}.ends"), lambda x: F.struct(x["starts"].alias("s"), x["ends"].alias("e")))
        for c in names
    ]
    spans = zipped[0] if blocks == 1 else _merge(F.concat(*zipped))
    items = reduce(F.array_union, [F.col(f"{c}.items") for c in names])
    found = F.struct(F.col(f"{names[0]}.n_words").alias("n_words"), spans.alias("spans"), items.alias("items"))
    return out.withColumn(leak, found).drop(*names)


@F.pandas_udf(StringType())
def _without(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for text, begin, end in zip(texts, starts, ends, strict=True):
        if text is None or begin is None or not len(begin):
            out.append(text)
            continue
        raw = text.encode("utf-8", "replace")
        at = [m.span() for m in _WORD.finditer(raw.lower())]
        keep, last = [], 0
        for s, e in merged(zip(begin, end, strict=True)):
            keep.append(raw[last : at[s][0]])
            last = at[e - 1][1]
        out.append(b"".join([*keep, raw[last:]]).decode("utf-8"))
    return pd.Series(out, dtype=object)


def without_words(text: Column, spans: Column) -> Column:
    """The text without the words of ``spans`` (array of structs s, e), cut from the first to the last byte of each."""
    return _without(text, F.transform(spans, lambda x: x["s"]), F.transform(spans, lambda x: x["e"]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = 10, **more) -> DataFrame:
    """``docs`` without what leaks the benchmark, with its own columns.

    ``remove="documents"`` drops each document that holds a window, ``remove="spans"`` cuts the hit words (from
    the first to the last byte of each span) out of the texts and keeps all rows. Null texts stay.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove}")
    (leak,) = fresh(docs, "leak")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = contamination(docs, benchmark, n=n, leak=leak, **more)
    spans = F.col(f"{leak}.spans")
    if remove == "documents":
        return found.where(F.size(spans) == 0).select(*columns)
    return found.withColumn("text", without_words(F.col("text"), spans)).select(*columns)
