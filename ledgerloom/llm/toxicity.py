"""Toxicity by a classifier chain: linear models in sequence, each fed with the probabilities before it."""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, letter_words
from ledgerloom.llm.tokens import kept
from ledgerloom.session import stored

BUCKETS = 1 << 20  # hashed features
STEMS = (4, 5, 6)  # bytes of the word starts that are features beside the whole words
CACHE = 200_000  # words whose features a worker keeps


class Features:
    """Hashed features of a text: which words and which word starts it holds, each once, in the whole text."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _of(self, word: bytes) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            keys = [word + b" ", *(word[:n] for n in STEMS if len(word) > n)]
            got = tuple(xxhash.xxh32_intdigest(k) % BUCKETS for k in keys)
            if len(self.known) >= CACHE:
                self.known.clear()
            if len(word) <= 40:
                self.known[word] = got
        return got

    def __call__(self, text: str | None) -> np.ndarray:
        words = set(letter_words(text))
        return np.unique(np.fromiter((f for w in words for f in self._of(w)), np.int32))


@dataclass
class Linear:
    """A logistic model over the features it was given to choose, and over the scores of earlier links."""

    weights: np.ndarray  # by feature bucket
    before: np.ndarray  # by earlier link
    bias: float

    def score(self, features: np.ndarray, earlier: list[float]) -> float:
        z = self.bias + float(self.weights[features].sum(dtype=np.float64)) + float(np.dot(self.before, earlier))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logit(p) -> np.ndarray:
    p = np.clip(np.asarray(p, float), 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 4


def _chunks(rows: list[np.ndarray], size: int = 1000):
    """Features and row numbers of so many rows at a time, which bounds what stands in memory beside them."""
    for at in range(0, len(rows), size):
        part = rows[at : at + size]
        yield np.concatenate(part), np.repeat(np.arange(at, at + len(part), dtype=np.int32), [len(x) for x in part])


def fit_linear(rows: list[np.ndarray], y: np.ndarray, earlier: np.ndarray, features: int, steps: int, ridge: float) -> Linear:
    """Logistic regression by full gradients over the ``features`` buckets that tell the classes best apart."""
    n, ones = len(rows), int(y.sum())
    empty = np.zeros(BUCKETS, np.float32)
    if not ones or ones == n:  # one class only: its share, smoothed
        share = (ones + 0.5) / (n + 1)
        return Linear(empty, np.zeros(earlier.shape[1]), float(np.log(share / (1 - share))))
    pos, total = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for flat, owner in _chunks(rows):
        total += np.bincount(flat, minlength=BUCKETS)
        pos += np.bincount(flat[y[owner] > 0], minlength=BUCKETS)
    neg = total - pos
    p, q = (pos + 0.5) / (ones + 1), (neg + 0.5) / (n - ones + 1)
    pooled = (pos + neg + 1) / (n + 2)
    z = (p - q) / np.sqrt(pooled * (1 - pooled) * (1 / ones + 1 / (n - ones)))
    z[pos + neg < 3] = 0
    chosen = np.argsort(-np.abs(z), kind="stable")[:features]
    chosen = np.sort(chosen[np.abs(z[chosen]) > 3])
    column = np.full(BUCKETS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    hits = []
    for flat, owner in _chunks(rows):
        at = column[flat]
        hits.append((at[at >= 0], owner[at >= 0]))
    col, row = (np.concatenate([h[i] for h in hits]) for i in (0, 1))
    w, b, v = np.zeros(len(chosen)), float(np.log(ones / (n - ones))), np.zeros(earlier.shape[1])
    moment = [np.zeros_like(w), 0.0, np.zeros_like(v)]
    square = [np.zeros_like(w), 0.0, np.zeros_like(v)]
    for t in range(1, steps + 1):
        s = b + earlier @ v + np.bincount(row, weights=w[col], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) / n
        grads = [np.bincount(col, weights=error[row], minlength=len(w)) + ridge * w, error.sum(), earlier.T @ error + ridge * v]
        new = []
        for i, (value, g) in enumerate(zip((w, b, v), grads, strict=True)):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            step = (moment[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.999**t)) + 1e-8)
            new.append(value - 0.1 * step)
        w, b, v = new
    weights = empty.copy()
    weights[chosen] = w
    return Linear(weights, v, float(b))


@dataclass
class Chain:
    categories: list[str]
    links: list[Linear]

    def score(self, features: np.ndarray) -> list[float]:
        out: list[float] = []
        for link in self.links:
            out.append(link.score(features, list(_logit(out)) if out else []))
        return out


def fit_chain(
    rows: list[np.ndarray], labels: np.ndarray, categories: list[str], folds: int = 5, features: int = 8192,
    steps: int = 120, ridge: float = 1e-5,
) -> Chain:
    """A chain over ``labels`` (rows x categories, 0/1), in the order of the categories.

    Each link is trained on the features and on the probabilities of the earlier links. Those are out of fold: for
    the rows of one fold they come from models that were trained on the other folds, features chosen there too.
    """
    n = len(rows)
    fold = np.arange(n) % folds
    earlier, links = np.zeros((n, 0)), []
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        links.append(fit_linear(rows, y, earlier, features, steps, ridge))
        if k + 1 == len(categories):
            break
        held = np.zeros(n)
        for f in range(folds):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(outside):
                continue
            part = fit_linear([rows[i] for i in inside], y[inside], earlier[inside], features, steps, ridge)
            held[outside] = [part.score(rows[i], list(earlier[i])) for i in outside]
        earlier = np.column_stack([earlier, _logit(held)])
    return Chain(list(categories), links)


def training_rows(docs: DataFrame, labels: DataFrame, categories: list[str], bound: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of at most ``bound`` labelled documents, those of the smallest hashed ids.

    Labels that are null, or ids without a document, are left out; ids labelled twice count as the larger value, of an id
    with several texts that of the smallest hash counts. The choice is made on the cluster, so the driver gets at most
    ``bound`` rows whatever repeats.
    """
    known = labels.where(F.col("doc_id").isNotNull())
    for c in categories:
        known = known.where(F.col(c).isNotNull())
    known = known.groupBy("doc_id").agg(*[F.max(F.col(c).cast("double")).alias(c) for c in categories])
    # One text of each labelled id, then the smallest hashes: all on (id, hash) rows, before any feature is made.
    slim = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    mark = F.xxhash64("text").alias("mark")
    there = slim.where("doc_id is not null").select("doc_id", mark).groupBy("doc_id").agg(F.min("mark").alias("mark"))
    chosen = stored(known.join(there, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound), "training-ids")
    both = slim.withColumn("mark", mark).join(F.broadcast(chosen), ["doc_id", "mark"])

    def cut(frames):
        make = Features()
        for part in frames:
            out = part[["doc_id", *categories]].copy()
            out["features"] = [make(t).astype("<i4").tobytes() for t in part["text"]]
            yield out

    schema = "doc_id long, " + ", ".join(f"{c} double" for c in categories) + ", features binary"
    both = both.select(F.col("doc_id").cast("long").alias("doc_id"), *categories, "text").dropDuplicates(["doc_id"])
    got = both.mapInPandas(cut, schema).toPandas().sort_values("doc_id", kind="stable")
    values = got[categories].to_numpy(float).reshape(-1, len(categories))
    return [np.frombuffer(x, "<i4") for x in got.pop("features")], values


def labelled(labels: DataFrame) -> DataFrame:
    """The two categories of the ``labels`` table as 0/1: low quality first, toxicity last."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic").alias("toxic"))


def score(
    docs: DataFrame, labels: DataFrame, categories: list[str], bound: int = 8_000, name: str = "scores",
    corpus: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with the column ``name``: the probability of each category, an array in the chain's order.

    ``labels`` holds doc_id and a 0/1 column per category; the chain is fitted on the driver on a sample of at most
    ``bound`` labelled documents of ``corpus``, ``docs`` itself if not given (features of whole texts, made by the
    tasks), and broadcast. Every text is scored whole in its own row; nothing is shuffled but the labels. Null texts and texts without words have probability 0
    in every category, and so has every text if there are no labels. Columns pass unchanged.
    """
    rows, y = training_rows(docs if corpus is None else corpus, labels, categories, bound)
    chain = fit_chain(rows, y, categories) if len(rows) else None
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    tag, none = os.urandom(8).hex(), [0.0] * len(categories)

    @F.pandas_udf("array<double>")
    def scores(texts: pd.Series) -> pd.Series:
        make, model = kept(tag, lambda: (Features(), shared.value))
        out = []
        for text in texts:
            features = make(text) if model else ()
            out.append(model.score(features) if len(features) else none)
        return pd.Series(out, dtype=object)

    return docs.withColumn(name, scores(F.col("text").cast("string")))


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = 0.3, **more) -> DataFrame:
    """``docs`` without the rows whose toxicity is ``reject`` or more; null and empty texts stay."""
    (name,) = fresh(docs, "scores")
    found = score(docs, labelled(labels), ["low_quality", "toxic"], name=name, **more)
    return found.where(F.element_at(name, -1) < reject).select(*[F.col(f"`{c}`") for c in docs.columns])
