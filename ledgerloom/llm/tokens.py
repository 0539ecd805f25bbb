"""Token counts of whole texts by a two-tier lookup on the map side, without any shuffle of pre-tokens."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stored

CACHE = 400_000  # chunks that a worker keeps of what it has encoded itself
LONGEST = 64  # characters of the longest chunk that is kept

STRANGE = re.compile("[\x1c-\x1f]")  # blanks to Python, not to the libraries
# A run of white space without its last character, or a word with one white space character before it.
PIECES = re.compile(r"\s+(?!\S)|\s?\S+")

_workers: dict = {}  # what this Python worker keeps between batches


def kept(tag: str, make: Callable):
    """The object that ``make`` builds, once per worker and job."""
    if tag not in _workers:
        _workers.clear()
        _workers[tag] = make()
    return _workers[tag]


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special(library) -> list[str]:
    return [t.content for t in library.get_added_tokens_decoder().values()]


def even_words(text: str) -> list[str] | None:
    """Words of a text with exactly one blank or line break between any two, else None."""
    words = text.split()
    return words if words == text.replace("\n", " ").split(" ") else None


class Counts:
    """Token counts as the library gives them, from a table of frequent chunks and a bounded cache for the rest.

    A chunk is a word with the one white space character before it, kept without that character if it is a
    blank. Byte-level pre-tokens never reach over the start of a chunk, so the sum over chunks is the count of the
    text. Texts with a special token string or a separator control character are encoded whole by the library.
    """

    def __init__(self, path: str, table: dict[str, int]):
        self.library = tokenizer(path)
        self.special = special(self.library)
        self.table = dict(table)
        self.fixed = len(self.table)
        self.raw: dict[str, int] = {}

    def encode(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def _raw(self, text: str) -> int:
        """Of the first word and of runs of white space, which stand for themselves."""
        if len(text) > LONGEST:
            return self.encode(text)
        if text not in self.raw:
            if len(self.raw) > CACHE // 8:
                self.raw.clear()
            self.raw[text] = self.encode(text)
        return self.raw[text]

    def _learn(self, chunks: list[str]) -> dict[str, int]:
        """Lengths of chunks that neither tier holds; short ones stay in the cache."""
        texts = [c if c[0].isspace() else " " + c for c in chunks]
        sizes = [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        new = dict(zip(chunks, sizes, strict=True))
        if len(self.table) + len(new) > self.fixed + CACHE:
            self.table = dict(list(self.table.items())[: self.fixed])
        self.table.update((c, n) for c, n in new.items() if len(c) <= LONGEST)
        return new

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special) or STRANGE.search(text):
            return self.encode(text)
        if even_words(text):
            head, *chunks = text.replace("\n", " \n").split(" ")
            total = self._raw(head)
        else:
            total, chunks = 0, []
            for piece in PIECES.findall(text):
                if piece.isspace() or not piece[0].isspace():
                    total += self._raw(piece)
                else:
                    chunks.append(piece[1:] if piece[0] == " " else piece)
        sizes = list(map(self.table.get, chunks))
        if None in sizes:
            new = self._learn(list({c for c, n in zip(chunks, sizes, strict=True) if n is None}))
            sizes = [new[c] if n is None else n for c, n in zip(chunks, sizes, strict=True)]
        return total + sum(sizes)


def frequent_words(docs: DataFrame, size: int = 65_536, text: str = "text", held: int = 500_000, each: int = 16_384) -> list[str]:
    """At most ``size`` frequent words between white space, of at most ``LONGEST`` characters, counted over all whole texts.

    A task counts every word of its texts and hands on the ``each`` most frequent ones with their counts, when it holds
    ``held`` different words or ends, so a few rows a task are shuffled instead of the words. The words with the highest
    sums reach the driver: those above the count at which there are ``size`` or fewer.
    """

    def count(frames):
        seen: Counter = Counter()

        def rows() -> pd.DataFrame:
            top = [(w, n) for w, n in seen.most_common(each) if n > 1 and len(w) <= LONGEST]
            seen.clear()
            return pd.DataFrame(top, columns=["w", "n"])

        for frame in frames:
            for value in frame["t"]:
                seen.update(value.split())
                if len(seen) > held:
                    yield rows()
        yield rows()

    texts = docs.select(F.col(text).cast("string").alias("t")).where("t is not null")
    counts = stored(texts.mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "word-counts")
    bands = counts.groupBy(F.floor(F.log2("n") * 64).alias("band")).agg(F.count("*").alias("words"), F.min("n").alias("least"))
    least, words = None, 0
    for band in bands.orderBy(F.desc("band")).collect():  # at most 64 for each doubling of the count
        words += band.words
        if least is not None and words > size:
            break
        least = band.least
    if least is None:
        return []
    return [r.w for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(size).collect()]


def frequent(docs: DataFrame, path: str, size: int = 65_536, text: str = "text") -> dict[str, int]:
    """Lengths of the most frequent chunks (words with a blank before them) of all texts: at most ``size`` entries."""
    library = tokenizer(path)
    marked = special(library)
    chunks = [w for w in frequent_words(docs, size, text) if not any(s in w for s in marked)]
    counts = library.encode_batch_fast([" " + w for w in chunks], add_special_tokens=False)
    return {w: len(e.ids) for w, e in zip(chunks, counts, strict=True)}


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text", table: int = 65_536) -> DataFrame:
    """Every row of ``docs`` with n_tokens, n_bytes (UTF-8) and over_limit (n_tokens > ``limit``).

    ``path`` is a byte-level BPE file. The first tier is a broadcast table of at most ``table`` frequent chunks, counted
    over all texts, the second a cache in each worker; a miss is encoded by the library in its worker. Only the counts
    of words for the table are shuffled, and every text is read whole, twice. Null and empty texts count zero; special token strings are read as the library does by default;
    columns of the same names are replaced; repeated rows are counted each; an empty table gives an empty result.
    """
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, table, text=text))
    tag = os.urandom(8).hex()

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        counts = kept(tag, lambda: Counts(path, known.value))
        return pd.Series(list(map(counts.count, texts)), dtype="int64")

    whole = F.col(text).cast("string")
    size = F.coalesce(F.octet_length(whole), F.lit(0)).cast("long")
    out = docs.withColumns({"n_tokens": count(whole), "n_bytes": size})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
