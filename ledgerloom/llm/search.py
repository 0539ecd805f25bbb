"""Ranked lexical search: tries of frequency-ordered term vectors, searched by branch and bound.

Only terms that some query holds matter for a score, so a document is a short vector of such terms with their counts.
Each task puts the vectors of a block of documents in order, most frequent term first; equal beginnings then share a
path of a trie (an FP-tree of documents). A node knows the largest count of every term and the smallest length
measure below it, which bounds the score of all its documents for any query. A query goes depth first into the most
promising child and passes over every node whose bound is below its tenth best score so far.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, letter_words
from ledgerloom.session import stored

VOCABULARY = 8192  # terms of the queries that are searched together; more queries take another pass
BLOCK, ENTRIES = 16_384, 1 << 21  # documents of a trie, and terms in them, at most (one document more may go over)
LEAF = 64  # documents of a subtree that is not split further, unless they are equal
K1000, SHARE, SCALE = 1000, 75, 1_000_000_000


def query_blocks(queries: DataFrame, vocabulary: int) -> list[list[tuple[int | None, Counter]]]:
    """The queries with their terms, in blocks of at most ``vocabulary`` different terms (a longer query alone).

    Queries come to the driver one partition at a time; they are a benchmark, not a corpus, and the blocks bound
    what is broadcast.
    """
    blocks: list[list[tuple[int | None, Counter]]] = []
    held: set[bytes] = set()
    for row in queries.toLocalIterator():
        terms = Counter(letter_words(row[1]))
        if not blocks or len(held | terms.keys()) > vocabulary and held:
            blocks.append([])
            held = set()
        blocks[-1].append((row[0], terms))
        held |= terms.keys()
    return blocks


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(doc_id, n, terms, counts): words of the whole text, and of those in ``vocabulary`` number and count."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("n long, terms array<int>, counts array<int>")
    def count(texts: pd.Series) -> pd.DataFrame:
        place, size = known.value, len(known.value)
        n, terms, counts = [], [], []
        for value in texts:
            words = letter_words(value)
            got = [place[w] for w in words if w in place]
            if len(got) > 4 * size:
                seen = np.bincount(got, minlength=size)
                which = np.flatnonzero(seen)
                many = seen[which]
            else:
                which, many = np.unique(np.array(got, np.int64), return_counts=True)
            n.append(len(words))
            terms.append(which.astype(np.int32))
            counts.append(many.astype(np.int32))
        return pd.DataFrame({"n": n, "terms": pd.Series(terms, dtype=object), "counts": pd.Series(counts, dtype=object)})

    found = docs.select(F.col(key).cast("long").alias("doc_id"), count(F.col(text).cast("string")).alias("v"))
    return found.select("doc_id", "v.n", "v.terms", "v.counts")


def per_weight(tf, m):
    """(10^9 tf) div (1000 tf + 8 m), below a million: what a term adds to a score for each unit of its weight. It grows
    with tf and falls with m."""
    return ((SCALE * tf) // (K1000 * tf + 8 * m)).astype(np.int32)


@dataclass
class Trie:
    """Documents in the order of their vectors, and the subtrees of their trie that branch.

    ``terms`` and ``units`` (see ``per_weight``) hold the vectors one after the other, ``start`` where each begins. Of node
    k, ``low[k]`` and ``high[k]`` are its documents, ``children[k]`` its nodes, none of a leaf, and ``most[k]`` has for
    each term ``per_weight`` of the largest count and the smallest m below it, zero if no document there holds it.
    """

    ids: np.ndarray
    named: np.ndarray
    terms: np.ndarray
    units: np.ndarray
    start: np.ndarray
    low: list[int]
    high: list[int]
    children: list[list[int]]
    most: np.ndarray


def grow(ids: np.ndarray, named: np.ndarray, m: np.ndarray, vectors_: list[tuple[np.ndarray, np.ndarray]], rank: np.ndarray) -> Trie:
    """The trie of documents with (terms, counts); ``rank`` is the place of each term by falling frequency."""
    paths, kept = [], []
    for terms, counts in vectors_:
        order = np.argsort(rank[terms])
        kept.append((terms[order], counts[order]))
        paths.append(rank[terms[order]].astype(">u4").tobytes())
    order = sorted(range(len(paths)), key=lambda i: (paths[i], kept[i][1].tobytes()))
    paths, kept = [paths[i] for i in order], [kept[i] for i in order]
    size = np.array([len(t) for t, _ in kept], np.int64)
    start = np.concatenate(([0], np.cumsum(size)))
    terms = np.concatenate([t for t, _ in kept]).astype(np.int64)
    counts = np.concatenate([c for _, c in kept]).astype(np.int64)
    m = m[order]

    shared = np.empty(max(0, len(paths) - 1), np.int64)  # terms that neighbours begin with alike
    for i in range(len(paths) - 1):
        a, b = paths[i], paths[i + 1]
        if a == b:
            shared[i] = size[i]
            continue
        n = int(min(size[i], size[i + 1]))
        x, y = np.frombuffer(a, ">u4", n), np.frombuffer(b, ">u4", n)
        differ = np.flatnonzero(x != y)
        shared[i] = differ[0] if len(differ) else n

    low, high, children = [0], [len(paths)], [[]]
    todo = [0]
    while todo:
        node = todo.pop()
        first, last = low[node], high[node]
        between = shared[first : last - 1]
        if last - first <= LEAF or paths[first] == paths[last - 1]:
            continue
        cuts = first + 1 + np.flatnonzero(between == between.min())
        edges = [first, *cuts.tolist(), last]
        begin = first
        for a, b in zip(edges, edges[1:], strict=False):  # small neighbours stay together, up to a leaf
            if b - a > LEAF:
                if a > begin:
                    children[node].append(len(low))
                    low.append(begin), high.append(a), children.append([])
                children[node].append(len(low))
                todo.append(len(low))
                low.append(a), high.append(b), children.append([])
                begin = b
            elif b - begin > LEAF:
                children[node].append(len(low))
                low.append(begin), high.append(a), children.append([])
                begin = a
        if last > begin:
            children[node].append(len(low))
            low.append(begin), high.append(last), children.append([])

    most = np.zeros((len(low), len(rank)), np.int32)
    least = np.zeros(len(low), np.int64)
    for node in range(len(low) - 1, -1, -1):  # children have higher numbers
        if children[node]:
            most[node] = most[children[node]].max(axis=0)
            least[node] = least[children[node]].min()
        else:
            a, b = start[low[node]], start[high[node]]
            np.maximum.at(most[node], terms[a:b], counts[a:b].astype(np.int32))
            least[node] = m[low[node] : high[node]].min()
    for node in range(len(low)):  # row by row, in place
        most[node] = per_weight(most[node].astype(np.int64), least[node])
    units = per_weight(counts, np.repeat(m, size))
    return Trie(ids[order], named[order], terms, units, start, low, high, children, most)


def best(trie: Trie, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, top: list, k: int) -> int:
    """Adds to ``top`` (a heap of (score, no id, -id), the worst first) what ``trie`` has among the ``k`` best.

    ``dense`` is a zeroed array over all terms for the query's weights. Returns the number of documents scored.
    """
    bound = (trie.most[:, terms] * weights).sum(axis=1).tolist()
    dense[terms] = weights
    scored, todo = 0, [0]
    while todo:
        node = todo.pop()
        if not bound[node] or len(top) == k and bound[node] < top[0][0]:
            continue
        if trie.children[node]:
            todo += sorted(trie.children[node], key=bound.__getitem__)  # the best is taken first
            continue
        low, high = trie.low[node], trie.high[node]
        begin = trie.start[low:high]  # no vector is empty
        scores = np.add.reduceat(dense[trie.terms[begin[0] : trie.start[high]]] * trie.units[begin[0] : trie.start[high]], begin - begin[0])
        scored += high - low
        for i in np.flatnonzero(scores >= (top[0][0] if len(top) == k else 1)).tolist():
            one = (int(scores[i]), bool(trie.named[low + i]), -int(trie.ids[low + i]))
            if len(top) < k:
                heapq.heappush(top, one)
            elif one > top[0]:
                heapq.heapreplace(top, one)
    dense[terms] = 0
    return scored


def search(
    docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id",
    vocabulary: int = VOCABULARY,
) -> DataFrame:
    """The ``k`` best documents of each query: item_id, rank (from 1), doc_id, score; score above 0, ties by doc_id.

    Terms are lower-cased (A-Z) words of letters, digits and non-ASCII characters in the whole text. N counts
    documents with a term, L their terms, n those of one document, df the documents that hold a term. A term weighs
    w = floor(1000 ln((2N+2)/(2df+1))), a document measures m = 25 + (75 n N) div L, and its score is the sum of
    w * ((10^9 tf) div (1000 tf + 8m)) over the query's terms, repeats included; integers but for the logarithm.

    Texts are read once for every ``vocabulary`` different query terms and become vectors in the shared folder; df, N
    and L are sums over these. Each task builds tries of bounded size over its documents, keeps the ``k`` best of every
    query from trie to trie, and returns at most ``k`` rows a query, the best of which are taken in two steps. No
    document is shuffled, queries and documents are never paired. Null and empty texts have no terms and are not found;
    a null id comes after all others among equal scores; repeated rows are documents each (their order among
    themselves is open, the rows are equal); items that repeat an id or a null id are ranked each on their own and
    each gives its rows; without documents or queries the result is empty. Other columns are not used.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col(item).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    shape = "query long, item_id long, doc_id long, score long"
    found = None
    done = 0
    for block in query_blocks(asked, vocabulary):
        numbers = {w: i for i, w in enumerate(sorted(set().union(*[terms for _, terms in block])))}
        if not numbers:
            continue
        slim = stored(vectors(docs, numbers, key, text), "term-vectors")
        every = slim.where("n > 0").agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
        if not every.N:
            continue
        df = np.zeros(len(numbers), np.int64)
        for r in slim.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
            df[r.t] = r.df  # at most ``vocabulary`` rows, or the terms of one query
        weight = np.array([math.floor(1000 * math.log((2 * every.N + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        rank = np.empty(len(df), np.int64)
        rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
        plan = []
        for i, (name, terms) in enumerate(block):
            where = np.array(sorted(numbers[w] for w in terms), np.int64)
            times = np.zeros(len(df), np.int64)
            for w, n in terms.items():
                times[numbers[w]] = n
            plan.append((done + i, name, where, weight[where] * times[where]))
        done += len(block)
        shared = spark.sparkContext.broadcast((plan, rank, int(every.N), int(every.L)))

        def rank_block(frames, shared=shared):
            plan, rank, total, length = shared.value
            dense = np.zeros(len(rank), np.int64)
            tops: list[list] = [[] for _ in plan]
            ids, named, m, held, entries = [], [], [], [], 0

            def flush() -> None:
                nonlocal entries
                trie = grow(np.array(ids, np.int64), np.array(named, bool), np.array(m, np.int64), held, rank)
                for (_, _, terms, weights), top in zip(plan, tops, strict=True):
                    if len(terms):
                        best(trie, terms, weights, dense, top, k)
                for x in (ids, named, m, held):
                    x.clear()
                entries = 0

            for frame in frames:
                null = frame["doc_id"].isna().to_numpy()
                numbers_ = [0 if x else int(d) for x, d in zip(null, frame["doc_id"], strict=True)]
                for doc, none, n, terms, counts in zip(numbers_, null, frame["n"], frame["terms"], frame["counts"], strict=True):
                    if not len(terms):
                        continue
                    ids.append(doc), named.append(not none), m.append(100 - SHARE + (SHARE * int(n) * total) // length)
                    held.append((np.asarray(terms, np.int64), np.asarray(counts, np.int64)))
                    entries += len(terms)
                    if len(ids) >= BLOCK or entries >= ENTRIES:
                        flush()
            if ids:
                flush()
            out = [
                (number, name, -doc if has else None, score)
                for (number, name, _, _), top in zip(plan, tops, strict=True)
                for score, has, doc in top
            ]
            columns = ["query", "item_id", "doc_id", "score"]
            yield pd.DataFrame({c: pd.array([r[i] for r in out], "Int64") for i, c in enumerate(columns)})

        part = slim.where(F.size("terms") > 0).select(F.col("doc_id").cast("decimal(20,0)").cast("string").alias("doc_id"), "n", "terms", "counts")
        part = part.mapInPandas(rank_block, shape)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    (part,) = fresh(found, "part")
    some = found.withColumn(part, F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("query", part).orderBy(*order))).where(F.col("rank") <= k)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return some.select("item_id", "rank", "doc_id", "score")
