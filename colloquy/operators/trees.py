"""Deep decision trees whose subtrees are grown where their rows are.

Spark grows trees level by level and ships a histogram of every node, feature and bin from every task, and a deep tree has
nearly as many nodes as rows. Here (PLANET; Panda et al. 2009) only nodes of more than ``LOCAL_ROWS`` rows are split from such histograms;
the rows of a smaller node, a byte a feature, go to one task that finishes the subtree by sorting them.

The rules are those of Spark's trees: gini impurity, at most ``BINS`` bins a feature cut at quantiles, any gain splits,
Poisson bootstrap weights and a random choice of features at each node of a forest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import write_stage

BINS = 32
LOCAL_ROWS = 1 << 18        #: rows of a node whose subtree one task grows
SHIPPED_ROWS = 1 << 24      #: rows times trees that are shuffled at once
NODE_HISTOGRAMS = 1 << 10   #: histograms that a task holds at once
GROUP_NODES = 1 << 21       #: nodes of the trees that score the rows at once


@dataclass
class Nodes:
    """A tree: its root is node 0, the right child follows the left one; ``feature`` is -1 in a leaf and ``value`` the weight of each class."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def packed(self) -> dict:
        return {"feature": self.feature.astype(np.int16).tobytes(), "cut": self.cut.astype(np.uint8).tobytes(),
                "left": self.left.astype(np.int32).tobytes(), "value": self.value.astype(np.float64).tobytes()}

    @classmethod
    def unpacked(cls, r) -> "Nodes":
        feature = np.frombuffer(r["feature"], np.int16)
        return cls(feature, np.frombuffer(r["cut"], np.uint8), np.frombuffer(r["left"], np.int32), np.frombuffer(r["value"]).reshape(len(feature), -1))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bin numbers."""
        at = np.zeros(len(x), np.int32)
        rows = np.arange(len(x))
        while len(rows):
            feature = self.feature[at[rows]]
            rows, feature = rows[feature >= 0], feature[feature >= 0]
            here = at[rows]
            at[rows] = self.left[here] + (x[rows, feature] > self.cut[here])
        return at


# --- rows --------------------------------------------------------------------------------------------------

def cuts_of(rows: DataFrame) -> list[np.ndarray]:
    """For each element of ``x`` the values that may split it: between all its values if it has few, else its quantiles."""
    n = len(rows.first()["x"])
    x = [F.col("x")[i] for i in range(n)]
    levels = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(c, levels, 10_000).alias(f"q{i}") for i, c in enumerate(x)],
                     *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(x)]).first()
    cuts = [np.unique(np.array(found[f"q{i}"] or [], float)) for i in range(n)]
    few = [i for i in range(n) if found[f"d{i}"] <= 2 * BINS]
    if few:
        values = rows.agg(*[F.array_sort(F.collect_set(x[i])).alias(str(i)) for i in few]).first()
        for i in few:
            v = np.array(values[str(i)], float)
            if len(v) <= BINS:
                cuts[i] = (v[:-1] + v[1:]) / 2
    return cuts


def bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers of rows: a value is at most cut ``i`` if its bin is at most ``i``."""
    return np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1).astype(np.uint8)


def stacked(x: pd.Series, cuts: list[np.ndarray]) -> np.ndarray:
    return bins(np.stack(x.to_numpy()), cuts) if len(x) else np.zeros((0, len(cuts)), np.uint8)


CHUNK = "chunk long, x binary, y binary, w binary, miss binary"
SCORED = f"{CHUNK}, mass double, missed double"


@dataclass
class Chunk:
    """Some rows: bin numbers, class numbers, weights, and which of them the last tree got wrong."""

    number: int
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    miss: np.ndarray


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for b in batches:
        for r in b.to_pylist():
            y = np.frombuffer(r["y"], np.uint8)
            yield Chunk(r["chunk"], np.frombuffer(r["x"], np.uint8).reshape(len(y), -1), y, np.frombuffer(r["w"]), np.frombuffer(r["miss"], np.uint8))


def batch(schema: str, *rows: dict) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist(list(rows), pa.schema([(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))]))


def stored_chunks(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """``(x, y, w)`` as stored chunks; a chunk's number seeds its bootstrap weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, b in enumerate(batches):
            if not b.num_rows:
                continue
            if b.column("y").null_count or b.column("x").null_count or b.column("w").null_count:
                raise ValueError("a row without a label, weight or features")
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
            y, w = b.column("y").to_numpy(), b.column("w").to_numpy()
            if (y != y.astype(np.uint8)).any():
                raise ValueError("labels are class numbers")
            yield batch(CHUNK, {"chunk": (TaskContext.get().partitionId() << 32) + i, "x": bins(x, cuts).tobytes(), "y": y.astype(np.uint8).tobytes(),
                                "w": w.astype(float).tobytes(), "miss": np.zeros(len(y), np.uint8).tobytes()})

    return write_stage(rows.select("x", "y", "w").mapInArrow(run, CHUNK), "tree-rows")


def scored_chunks(stored: DataFrame, tree: Nodes, weight: Callable[[Chunk], np.ndarray]) -> DataFrame:
    """Stored chunks with their present weights and which rows the tree gets wrong, and the sums of both."""
    predicted = tree.value.argmax(1)
    shape = Nodes(tree.feature, tree.cut, tree.left, np.zeros((0, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            w, miss = weight(c), (predicted[shape.leaves(c.x)] != c.y).astype(np.uint8)
            yield batch(SCORED, {"chunk": c.number, "x": c.x.tobytes(), "y": c.y.tobytes(), "w": w.tobytes(), "miss": miss.tobytes(),
                                 "mass": float(w.sum()), "missed": float(w @ miss)})

    return write_stage(stored.select("chunk", "x", "y", "w", "miss").mapInArrow(run, SCORED), "tree-rows")


# --- one node ----------------------------------------------------------------------------------------------

def _gain(left: list[np.ndarray], total: list[np.ndarray]) -> np.ndarray:
    """How much a split raises the sum of squared class weights over the weight of a side (the fall of the gini impurity
    times the node's weight)."""
    right = [t - x for t, x in zip(total, left)]
    square = lambda side: sum(s * s for s in side) / sum(side)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(square(left) + square(right) - square(total), nan=-np.inf, posinf=-np.inf)


def _best_by_histogram(key, o, y, w, k, total):
    weights = [np.bincount(key, w * (y == c), o * BINS).reshape(o, BINS).cumsum(1) for c in range(k)]
    n = np.bincount(key, minlength=o * BINS).reshape(o, BINS).cumsum(1)
    gain = np.where((n > 0) & (n < n[:, -1:]), _gain(weights, [t[:, None] for t in total]), -np.inf)
    cut = gain.argmax(1)
    return np.arange(o), gain[np.arange(o), cut], cut


def _best_by_sort(key, starts, y, w, k, total):
    bits = max(1, len(key).bit_length())
    both = np.sort(key << bits | np.arange(len(key)))
    key, order = both >> bits, both & ((1 << bits) - 1)
    ends = np.flatnonzero(key[1:] != key[:-1])
    node = key[ends] // BINS
    inside = key[ends + 1] // BINS == node
    ends, node = ends[inside], node[inside]
    if not len(ends):
        return node, np.zeros(0), np.zeros(0, np.int64)
    y, w, left = y[order], w[order], []
    for c in range(k):
        sums = np.concatenate([[0.0], np.cumsum(np.where(y == c, w, 0.0))])
        left.append(sums[ends + 1] - sums[starts[node]])
    gain = _gain(left, [t[node] for t in total])
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    best = np.maximum.reduceat(gain, first)
    hits = np.flatnonzero(gain == np.repeat(best, np.diff(np.append(first, len(node)))))
    hits = hits[np.concatenate([[True], node[hits[1:]] != node[hits[:-1]]])]
    return node[hits], best, key[ends[hits]] % BINS


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, k: int, depth: int, candidates: int, rng: np.random.Generator) -> tuple[Nodes, np.ndarray]:
    """The whole subtree over some rows, level by level, and the gains of each feature. ``candidates`` features are tried at a node."""
    used = w > 0
    x, y, w = (x, y, w) if used.all() else (x[used], y[used], w[used])
    features = x.shape[1]
    value = [np.array([[w[y == c].sum() for c in range(k)]])]
    levels, gains, made = [], np.zeros(features), 1
    rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    ids = np.zeros(1, np.int64)                     # the tree's numbers of the open nodes
    if len(np.unique(y)) < 2:
        ids, rows, node = ids[:0], rows[:0], node[:0]
    for _ in range(depth):
        o = len(ids)
        if not o:
            break
        yr, wr = y[rows], w[rows]
        total = [np.bincount(node, wr * (yr == c), o) for c in range(k)]
        starts = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=o))[:-1]])
        tried = np.argpartition(rng.random((o, features)), candidates - 1, axis=1)[:, :candidates] if candidates < features else None
        best, feature, cut = np.full(o, -np.inf), np.zeros(o, np.int64), np.zeros(o, np.int64)
        for j in range(candidates):
            asked = np.full(o, j) if tried is None else tried[:, j]
            key = node * BINS + (x[rows, j] if tried is None else x[rows, asked[node]])
            if o * BINS * 4 < len(rows):
                at, gain, where = _best_by_histogram(key, o, yr, wr, k, total)
            else:
                at, gain, where = _best_by_sort(key, starts, yr, wr, k, total)
            better = gain > best[at]
            at = at[better]
            best[at], feature[at], cut[at] = gain[better], asked[at], where[better]
        split = best > 1e-12 * sum(total)
        if not split.any():
            break
        rank = np.cumsum(split) - 1
        n = int(split.sum())
        levels.append((ids[split], feature[split], cut[split], made + 2 * np.arange(n)))
        gains += np.bincount(feature[split], best[split], features)
        keep = split[node]
        rows, node = rows[keep], node[keep]
        node = 2 * rank[node] + (x[rows, feature[node]] > cut[node])
        yr, wr = y[rows], w[rows]
        value.append(np.stack([np.bincount(node, wr * (yr == c), 2 * n) for c in range(k)], axis=1))
        classes = sum((np.bincount(node[yr == c], minlength=2 * n) > 0).astype(int) for c in range(k))
        ids = made + np.flatnonzero(classes > 1)
        made += 2 * n
        keep = (classes > 1)[node]
        rows, node = rows[keep], (np.cumsum(classes > 1) - 1)[node[keep]]
    out = Nodes(np.full(made, -1, np.int16), np.zeros(made, np.uint8), np.zeros(made, np.int32), np.concatenate(value))
    for at, feature, cut, left in levels:
        out.feature[at], out.cut[at], out.left[at] = feature, cut, left
    return out, gains


# --- trees over all tasks ----------------------------------------------------------------------------------

class Top:
    """The upper part of a tree, on the driver; ``open`` are its leaves that a task has to finish, with their rows and depth."""

    def __init__(self, k: int, rows: int, features: int):
        self.feature, self.cut, self.left, self.value = [-1], [0], [0], [[0.0] * k]
        self.open, self.gains = {0: (rows, 0)}, np.zeros(features)

    def split(self, node: int, feature: int, cut: int, gain: float, left: np.ndarray, right: np.ndarray, rows: tuple[int, int], depth: int) -> None:
        at = self.open.pop(node)[1] + 1
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        self.gains[feature] += gain
        self.value[node] = list(left + right)
        for value, n in ((left, rows[0]), (right, rows[1])):
            if (value > 0).sum() > 1 and at < depth:
                self.open[len(self.feature)] = (n, at)
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.value.append(list(value))

    @property
    def nodes(self) -> Nodes:
        return Nodes(np.array(self.feature, np.int16), np.array(self.cut, np.uint8), np.array(self.left, np.int32), np.array(self.value))


PIECE = "tree int, node int, nodes int, feature binary, cut binary, left binary, value binary, gains binary"
_SHIPPED = "tree int, node int, part long, x binary, y binary, w binary"
_HISTOGRAM = "tree int, node int, sums binary"
_SPLIT = "tree int, node int, feature int, cut int, gain double, sums binary"


def grow_trees(stored: DataFrame, n_rows: int, k: int, features: int, trees: list[int], depth: int, candidates: int, seed: int,
               weigh: Callable[[Chunk, int], np.ndarray], local_rows: int | None = None) -> Iterator[DataFrame]:
    """Pieces (``PIECE``) of the trees with the given numbers, some trees at a time: each finished subtree with the node of the
    upper part that it hangs on, and the upper part (node -1) if there is one."""
    at_once = max(1, SHIPPED_ROWS // max(1, n_rows))
    for i in range(0, len(trees), at_once):
        yield _grow_some(stored, n_rows, k, features, trees[i:i + at_once], depth, candidates, seed, weigh, local_rows or LOCAL_ROWS)


def _grow_some(stored, n_rows, k, features, trees, depth, candidates, seed, weigh, local_rows) -> DataFrame:
    spark = stored.sparkSession
    tops = {t: Top(k, n_rows, features) for t in trees}
    while True:
        wide = [(t, node) for t, top in tops.items() for node, (n, at) in top.open.items() if n > local_rows and at < depth][:NODE_HISTOGRAMS]
        if not wide:
            break
        for r in _splits(stored, tops, wide, k, features, candidates, seed, weigh).collect():
            sums = np.frombuffer(r["sums"]).reshape(2, k + 1)
            top = tops[r["tree"]]
            if r["feature"] < 0:        # no split gains anything: a leaf of its class weights
                top.open.pop(r["node"])
                top.value[r["node"]] = list(sums[0, :k] + sums[1, :k])
            else:
                top.split(r["node"], r["feature"], r["cut"], r["gain"], sums[0, :k], sums[1, :k], (int(sums[0, k]), int(sums[1, k])), depth)
    uppers = [{"tree": t, "node": -1, "nodes": len(top.feature), **top.nodes.packed(), "gains": top.gains.tobytes()} for t, top in tops.items() if len(top.feature) > 1 or not top.open]
    open_ = {t: (top.nodes, {node: at for node, (_, at) in top.open.items()}) for t, top in tops.items()}

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            for t, (upper, nodes) in open_.items():
                w = weigh(c, t)
                at = upper.leaves(c.x)
                out = []
                for node in nodes:
                    mine = np.flatnonzero((at == node) & (w > 0))
                    if len(mine):
                        out.append({"tree": t, "node": node, "part": c.number, "x": c.x[mine].tobytes(), "y": c.y[mine].tobytes(), "w": w[mine].tobytes()})
                if out:
                    yield batch(_SHIPPED, *out)

    def finish(key, rows):
        t, node = (int(v) for v in key)
        rows = rows.sort_values("part")
        x, y, w = (np.frombuffer(b"".join(rows[c]), kind) for c, kind in (("x", np.uint8), ("y", np.uint8), ("w", float)))
        found, gains = grow(x.reshape(len(y), -1), y, w, k, depth - open_[t][1][node], candidates, np.random.default_rng([seed, t, node]))
        return pd.DataFrame([{"tree": t, "node": node, "nodes": len(found.feature), **found.packed(), "gains": gains.tobytes()}])

    pieces = stored.mapInArrow(ship, _SHIPPED).groupBy("tree", "node").applyInPandas(finish, PIECE)
    return pieces.unionByName(spark.createDataFrame(pd.DataFrame(uppers), PIECE)) if uppers else pieces


def _splits(stored, tops, wide, k, features, candidates, seed, weigh) -> DataFrame:
    """The best split of each given node (feature -1 if none gains), with the class weights and rows of both sides."""
    asked: dict[int, list[int]] = {}
    for t, node in wide:
        asked.setdefault(t, []).append(node)
    uppers = {t: tops[t].nodes for t in asked}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {(t, node): np.zeros((k + 1, features, BINS)) for t, node in wide}
        for c in chunks(batches):
            for t, nodes in asked.items():
                w, at = weigh(c, t), uppers[t].leaves(c.x)
                for node in nodes:
                    mine = np.flatnonzero((at == node) & (w > 0))
                    x, y, v = c.x[mine], c.y[mine], w[mine]
                    for f in range(features):
                        for j in range(k):
                            held[t, node][j, f] += np.bincount(x[:, f], v * (y == j), BINS)
                        held[t, node][k, f] += np.bincount(x[:, f], minlength=BINS)
        for (t, node), h in held.items():
            yield batch(_HISTOGRAM, {"tree": t, "node": node, "sums": h.tobytes()})

    def choose(key, parts):
        t, node = (int(v) for v in key)
        h = sum(sorted((np.frombuffer(b) for b in parts["sums"]), key=lambda a: a.tobytes())).reshape(k + 1, features, BINS).cumsum(2)
        rng = np.random.default_rng([seed, t, node, 1])
        tried = rng.permutation(features)[:candidates] if candidates < features else np.arange(features)
        total = h[:, 0, -1]
        gain = _gain([h[j][tried] for j in range(k)], [np.full((1, 1), total[j]) for j in range(k)])
        gain = np.where((h[k][tried] > 0) & (h[k][tried] < total[k]), gain, -np.inf)
        best = int(gain.argmax())
        f, cut = int(tried[best // BINS]), best % BINS
        left = h[:, f, cut]
        splits = gain.flat[best] > 1e-12 * total[:k].sum()
        return pd.DataFrame([{"tree": t, "node": node, "feature": f if splits else -1, "cut": cut, "gain": float(gain.flat[best]), "sums": np.stack([left, total - left]).tobytes()}])

    return stored.mapInArrow(count, _HISTOGRAM).groupBy("tree", "node").applyInPandas(choose, _SPLIT)


def assembled(pieces: list) -> Nodes:
    """A tree from its pieces."""
    upper = [Nodes.unpacked(r) for r in pieces if r["node"] < 0]
    if not upper:
        return Nodes.unpacked(pieces[0])
    parts = [[a.copy()] for a in (upper[0].feature, upper[0].cut, upper[0].left, upper[0].value)]
    made = len(upper[0].feature)
    for r in pieces:
        if r["node"] >= 0:
            sub = Nodes.unpacked(r)
            left = np.where(sub.feature >= 0, sub.left - 1 + made, 0).astype(np.int32)
            for p, a in zip(parts, (sub.feature, sub.cut, left, sub.value)):
                p[0][r["node"]] = a[0]
                p.append(a[1:])
            made += len(sub.feature) - 1
    return Nodes(*[np.concatenate(p) for p in parts])


def load(table: DataFrame, trees: list[int]) -> list[Nodes]:
    """Trees with the given consecutive numbers."""
    found: dict[int, list] = {t: [] for t in trees}
    for r in table.where(F.col("tree").between(trees[0], trees[-1])).collect():
        found[r["tree"]].append(r)
    return [assembled(found[t]) for t in trees]


def groups(sizes: list[int]) -> list[list[int]]:
    """Consecutive trees of at most ``GROUP_NODES`` nodes together, one at least."""
    out: list[list[int]] = [[]]
    held = 0
    for t, n in enumerate(sizes):
        if out[-1] and held + n > GROUP_NODES:
            out.append([])
            held = 0
        out[-1].append(t)
        held += n
    return out


def with_votes(df: DataFrame, column: str, cuts: list[np.ndarray], table: DataFrame, sizes: list[int], k: int, weights: list[float], whole: bool) -> DataFrame:
    """Adds ``_votes``: for each class the weighted sum over the trees of its share in a row's leaf, or (``whole``) of the leaf's
    largest class. The rows pass the groups of trees in turn and are written between two."""
    df = df.withColumn("_votes", F.array_repeat(F.lit(0.0), k))
    parts = groups(sizes)
    for i, part in enumerate(parts):
        trees = load(table, part)
        # a tree sends what it votes for in a leaf, not the leaf's weights
        shares = [np.eye(k)[t.value.argmax(1)] * weights[j] if whole else t.value / t.value.sum(1, keepdims=True) * weights[j] for j, t in zip(part, trees)]
        shapes = [Nodes(t.feature, t.cut, t.left, np.zeros((0, k))) for t in trees]
        df = df.withColumn("_votes", F.zip_with("_votes", _voter(shapes, shares, cuts, k)(vector_to_array(column)), lambda a, b: a + b))
        if i < len(parts) - 1:
            df = write_stage(df, "tree-votes")
    return df


def _voter(shapes: list[Nodes], shares: list[np.ndarray], cuts: list[np.ndarray], k: int):
    @F.pandas_udf("array<double>")
    def votes(x: pd.Series) -> pd.Series:
        rows = stacked(x, cuts)
        out = np.zeros((len(rows), k))
        for t, share in zip(shapes, shares):
            out += share[t.leaves(rows)]
        return pd.Series(list(out))

    return votes


def sqrt_of(features: int) -> int:
    """Features that are tried at a node of a classification forest."""
    return max(1, math.ceil(math.sqrt(features)))
