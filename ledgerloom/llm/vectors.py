"""Embedding near-duplicates: cover trees with halving radii, traversed in pairs, for all pairs over a threshold."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import components
from ledgerloom.session import stored

SLACK = 2e-7  # on bounds of distances: the root of a difference of cosines is off by up to 3e-8 near zero
LEAF = 16  # points of a node that is not split further


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class CoverTree:
    """Nested nets over unit vectors: children of a node of radius r cover its points within r / 2.

    ``points`` of a node are all below it, ``radius`` is the measured distance of the farthest from its centre, which
    is one of them. A node of few points, or of one place (within ``SLACK``), is a leaf, so every child has fewer points
    than its parent and growing ends.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.center, self.radius, self.points, self.children = [], [], [], []
        if len(vectors):
            self._grow(np.arange(len(vectors)), 2.0)

    def _node(self, points: np.ndarray, far: float) -> int:
        self.center.append(int(points[0]))
        self.radius.append(far)
        self.points.append(points)
        self.children.append(None)
        return len(self.center) - 1

    def _grow(self, points: np.ndarray, level: float) -> int:
        away = _distances(self.vectors[points], self.vectors[points[:1]])[:, 0]
        away[0] = 0.0
        root = self._node(points, float(away.max()))
        todo = [(root, level)]
        while todo:
            node, level = todo.pop()
            points, half = self.points[node], level / 2
            if len(points) <= LEAF or self.radius[node] <= SLACK:
                continue
            while half >= self.radius[node] - SLACK / 2:  # the farthest point is outside, however its distance is rounded
                half /= 2
            kids, rest = [], points
            while len(rest):  # a greedy net: centres are more than half a level apart
                away = _distances(self.vectors[rest], self.vectors[rest[:1]])[:, 0]
                away[0] = 0.0
                near = away <= half
                kids.append(self._node(rest[near], float(away[near].max())))
                rest = rest[~near]
            self.children[node] = np.array(kids)
            todo += [(k, half) for k in kids]
        return root

    def pack(self) -> tuple:
        return self.vectors, self.center, self.radius, self.points, self.children

    @classmethod
    def unpack(cls, state: tuple) -> CoverTree:
        out = cls.__new__(cls)
        out.vectors, out.center, out.radius, out.points, out.children = state
        return out


def traverse(a: CoverTree, b: CoverTree, threshold: float, same: bool):
    """All links (cosine >= threshold) between two trees, or within one: exact pairs and whole blocks.

    Yields (points of a, points of b, matrix or None): where the matrix is true, or everywhere, pairs are links. Node
    pairs are dropped when their centres are farther apart than the threshold's distance and both radii, and taken
    whole when the farthest points must be within it; all others are opened, leaves are compared in double precision.
    Within one tree each unordered pair is seen once; a block of a node with itself holds each pair twice.
    """
    most = math.sqrt(max(0.0, 2 - 2 * threshold))
    todo = [(0, 0)] if a.center and b.center else []
    while todo:
        p, q = todo.pop()
        if same and p == q and 2 * a.radius[p] <= most - SLACK:
            yield a.points[p], b.points[q], None
            continue
        kids_p = a.children[p] if a.children[p] is not None else None
        kids_q = b.children[q] if b.children[q] is not None else None
        if kids_p is None and kids_q is None:
            yield a.points[p], b.points[q], a.vectors[a.points[p]] @ b.vectors[b.points[q]].T >= threshold
            continue
        own = same and p == q
        left = kids_p if kids_p is not None else np.array([p])
        right = kids_q if kids_q is not None else np.array([q])
        reach = np.array([b.radius[k] for k in right])
        for at in range(0, len(left), 512):
            part = left[at : at + 512]
            gap = _distances(a.vectors[[a.center[k] for k in part]], b.vectors[[b.center[k] for k in right]])
            both = np.array([a.radius[k] for k in part])[:, None] + reach[None, :]
            open_ = gap <= most + both + SLACK
            if own:
                open_ &= right[None, :] >= part[:, None]
            whole = open_ & (gap + both <= most - SLACK)
            if own:
                whole &= right[None, :] != part[:, None]
            for i, j in zip(*np.nonzero(whole), strict=True):
                yield a.points[part[i]], b.points[right[j]], None
            for i, j in zip(*np.nonzero(open_ & ~whole), strict=True):
                todo.append((int(part[i]), int(right[j])))


def links(a: CoverTree, b: CoverTree, weight_a: np.ndarray, weight_b: np.ndarray, threshold: float, same: bool):
    """Weighted numbers of links of the points of both trees, and for each point the root of its local component.

    Roots are numbers over both trees, those of ``b`` after those of ``a`` (the same ones if ``same``).
    """
    shift = 0 if same else len(weight_a)
    count_a, count_b = np.zeros(len(weight_a), np.int64), np.zeros(len(weight_b), np.int64)
    if same:
        count_b = count_a
    parent = np.arange(shift + len(weight_b))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(x: int, y: int) -> None:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)

    for p, q, hit in traverse(a, b, threshold, same):
        own = same and p is q
        if hit is None:
            count_a[p] += weight_b[q].sum()
            if own:
                count_a[p] -= weight_a[p]
            else:
                count_b[q] += weight_a[p].sum()
            if len(p) and len(q):
                for x in p:
                    join(int(x), shift + int(q[0]))
                for x in q[1:]:
                    join(int(p[0]), shift + int(x))
            continue
        if own:
            hit = hit.copy()
            np.fill_diagonal(hit, False)
        if not hit.any():
            continue
        count_a[p] += hit @ weight_b[q]
        if not own:
            count_b[q] += weight_a[p] @ hit
        for i, j in zip(*np.nonzero(hit), strict=True):
            join(int(p[i]), shift + int(q[j]))
    roots = np.array([find(x) for x in range(len(parent))])
    return count_a, count_b, roots


def _cells(classes: DataFrame, block, groups: int = 32, sample: int = 256):
    """A skeleton for the largest groups: the first levels of a cover tree over a bounded sample of each.

    At most ``groups`` groups of more than ``block`` (a Column of ``dim``) vectors and ``sample`` vectors of each, those of the smallest
    hashes. Only the order in which vectors are put into blocks depends on it.
    """
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = sizes.orderBy(F.desc("n"), "label", "dim").limit(groups)
    share = F.shiftrightunsigned(F.xxhash64("cid"), 33) / float(1 << 31)
    some = classes.join(F.broadcast(large), ["label", "dim"]).where(share < sample / F.col("n")).select("label", "dim", "e")
    found: dict = {}
    for row in some.limit(2 * groups * sample).collect():
        found.setdefault((row.label, row.dim), []).append(row.e)
    return {key: CoverTree(unit(np.array(rows, float))) for key, rows in found.items()}


def _descend(tree: CoverTree, rows: np.ndarray) -> np.ndarray:
    """The deepest node that covers each row, going to the nearest child each time; 0 is the root."""
    out = np.zeros(len(rows), np.int64)
    todo = [(0, np.arange(len(rows)), 2.0)]
    while todo:
        node, which, reach = todo.pop()
        kids = tree.children[node]
        if kids is None or not len(which):
            continue
        away = _distances(rows[which], tree.vectors[[tree.center[k] for k in kids]])
        best = away.argmin(axis=1)
        inside = away[np.arange(len(which)), best] <= max(reach / 2, 0.25)
        for k in np.unique(best[inside]):
            mine = which[inside & (best == k)]
            out[mine] = kids[k]
            todo.append((int(kids[k]), mine, reach / 2))
    return out


def near_vectors(vectors: DataFrame, threshold: float = 0.93, budget: int = 1 << 17) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id that links reach), kept (vec_id = component_id).

    Vectors (embedding: array of numbers) link if their labels are equal and not null, they have as many components
    and their cosine in double precision is ``threshold`` or more (which must be positive). Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing. A null vec_id links and is counted, but
    names no component; rows that repeat a vec_id are vectors of their own. Empty table: no rows.

    1. Equal vectors of a label become one class with its number of copies. 2. Classes are put into blocks of at most
    ``budget`` / dimension vectors: those of one cell of a skeleton together, a large cell by hash. 3. Each block
    becomes one row with its cover tree: nested nets with halving radii. 4. Block pairs of a label whose covering
    radii rule out a link are pruned; trees of all others are traversed in pairs. 5. Sums per class, components over
    one edge per class and block pair, then back to the rows. A group of copies or near copies is never expanded
    into pairs, a label of any size is cut into blocks.
    """
    number = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), number.alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & finite & F.exists("e", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    good, bad = rows.where(usable), rows.where(~usable)

    classes = good.groupBy("label", "e").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = stored(classes.withColumns({"cid": F.monotonically_increasing_id(), "dim": F.size("e")}), "classes")

    block = F.greatest(F.lit(64), F.floor(F.lit(budget) / F.col("dim"))).cast("long")
    skeleton = classes.sparkSession.sparkContext.broadcast(_cells(classes, block))

    @F.pandas_udf("long")
    def cell(label: pd.Series, dim: pd.Series, e: pd.Series) -> pd.Series:
        out = np.zeros(len(e), np.int64)
        for key, part in pd.DataFrame({"label": label, "dim": dim}).groupby(["label", "dim"]):
            tree = skeleton.value.get((key[0], int(key[1])))
            if tree is not None:
                at = part.index.to_numpy()
                out[at] = _descend(tree, unit(np.stack(e.iloc[at].to_list())))
        return pd.Series(out)

    group = ["label", "dim"]
    placed = stored(classes.select("cid", "copies", *group, "e", cell("label", "dim", "e").alias("cell")), "cells")
    cells = placed.groupBy(*group, "cell").agg(F.count("*").alias("n"))
    small = F.when(F.col("n") < block, F.col("n")).otherwise(0)
    order = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumns(
        {
            "parts": F.ceil(F.col("n") / block).cast("long"),
            "run": F.when(F.col("n") < block, F.floor((F.sum(small).over(order) - 1) / block)).otherwise(-1 - F.col("cell")),
        }
    ).drop("n")
    part = F.when(F.col("run") < 0, F.pmod(F.xxhash64("cid"), F.col("parts"))).otherwise(0)
    blocks = placed.join(cells, [*group, "cell"]).withColumn("part", part)

    def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cid")
        tree = CoverTree(unit(np.stack(frame["e"].to_list())))
        state = pickle.dumps((frame["cid"].to_numpy(np.int64), frame["copies"].to_numpy(np.int64), tree.pack()), 5)
        top = tree.vectors[tree.center[0]].tolist()
        return pd.DataFrame([(*key, top, tree.radius[0], state)], columns=["label", "dim", "run", "part", "center", "radius", "tree"])

    kind = dict(placed.dtypes)["label"]
    shape = f"label {kind}, dim int, run long, part long, center array<double>, radius double, tree binary"
    trees = blocks.groupBy(*group, "run", "part").applyInPandas(grow, shape)
    trees = stored(trees.withColumn("block", F.monotonically_increasing_id()), "trees")

    most = math.sqrt(max(0.0, 2 - 2 * threshold))
    heads = trees.select(*group, "block", "center", "radius")
    pairs = heads.join(heads.select(*group, F.col("block").alias("b2"), F.col("center").alias("c2"), F.col("radius").alias("r2")), group)
    dot = F.aggregate(F.zip_with("center", "c2", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    gap = F.sqrt(F.greatest(2 - 2 * dot, F.lit(0.0)))
    pairs = pairs.where((F.col("block") <= F.col("b2")) & (gap <= F.col("radius") + F.col("r2") + most + SLACK)).select("block", "b2")
    sides = pairs.join(trees.select("block", "tree"), "block").join(
        trees.select(F.col("block").alias("b2"), F.col("tree").alias("tree2")), "b2"
    )

    def compare(frames):
        for frame in frames:
            for one, two, first, second in frame[["block", "b2", "tree", "tree2"]].itertuples(index=False):
                cid_a, copies_a, state_a = pickle.loads(first)
                cid_b, copies_b, state_b = pickle.loads(second)
                same = one == two
                a = CoverTree.unpack(state_a)
                b = a if same else CoverTree.unpack(state_b)
                n_a, n_b, roots = links(a, b, copies_a, copies_b, threshold, same)
                cids = cid_a if same else np.concatenate([cid_a, cid_b])
                n = n_a if same else np.concatenate([n_a, n_b])
                out = pd.DataFrame({"cid": cids, "n": n, "root": cids[roots]})
                yield out[out["n"] > 0]

    found = stored(sides.mapInPandas(compare, "cid long, n long, root long"), "links")
    joined = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("cid").agg(F.sum("n").alias("n"))
    whole = classes.join(sums, "cid", "left").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
    whole = whole.withColumn("component", F.coalesce("component", "cid"))
    names = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = whole.join(names, "component").select(
        "label", "e", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked = good.join(whole, ["label", "e"]).select("vec_id", "n_links", "component_id")
    alone = bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
