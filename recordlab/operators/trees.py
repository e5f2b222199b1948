"""Histogram trees on Spark: softmax boosting and deep forests from one tree grower.

Features are cut once at quantiles of a sketch (one aggregation for all columns) and kept as byte
codes in stored blocks. Trees grow from their roots in two ways:

* nodes with more than ``SMALL`` rows, level by level: every task adds up the statistics of its
  rows per node, feature and bin, and one exchange brings the histograms of ``FEATURES`` features of
  a node together and gives their best cut;
* smaller nodes whole: their rows meet in one Arrow task, which grows the subtree to its end. All
  small nodes of all trees that grow together are one job.

The driver holds trees and few rows per node of a pass, never rows of data. Histograms of a pass
are bounded by ``PASS_BYTES``; more nodes take more passes. A deep forest has about as many nodes as
its trees have rows: finished subtrees are columns of small numbers, seven bytes a node, and equal
leaf values are kept once.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlab.operators.fitted import SharesModel, dumped, loaded
from recordlab.session import drop_scratch, scratch_path, scratch_scope

BINS = 256
SMALL = 50_000
PASS_BYTES = 128 << 20
#: features whose histograms of a node meet in one group
FEATURES = 64
#: rows of small nodes that a task hands on together
ROUTE_BYTES = 16 << 20
#: rows from which a histogram is made feature by feature
LONG = 1024
BLOCK_ROWS = 8192
#: rounds after which margins are written with the rows instead of being derived from the trees
REFRESH = 20
#: the same for more than ``SMALL`` rows, where a pass over pending trees costs more than writing
REFRESH_LARGE = 4
DEFAULT_DEPTH = 6


# --- rows as blocks of byte codes -------------------------------------------------------------


def quantile_edges(df: DataFrame, features: str, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of each feature's bins but the last, from one sketch aggregation."""
    shares = [i / bins for i in range(1, bins)]
    cells = df.select(F.posexplode(vector_to_array(features)).alias("at", "x")).where("NOT isnan(x)")
    rows = cells.groupBy("at").agg(F.percentile_approx("x", F.lit(shares), 10_000).alias("q"), F.max("x").alias("top"))
    found = {r.at: np.unique([x for x in r.q if x < r.top]) for r in rows.collect()}
    return [found.get(i, np.empty(0)) for i in range(max(found, default=-1) + 1)]


def code_rows(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of every cell; a missing number falls into the last one."""
    out = np.empty(x.shape, dtype=np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j])
    return out


_BLOCKS = "block bigint, n int, codes binary, y binary, w binary, margins binary"


def _pack(rows: dict) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "n": pa.int32()}
    return pa.RecordBatch.from_pydict({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in rows.items()})


def to_blocks(df: DataFrame, features: str, label: str, weight: str, edges: Sequence[np.ndarray], classes: int) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(list(edges))
    width = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
            w = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            for at in range(0, len(x), BLOCK_ROWS):
                rows = slice(at, at + BLOCK_ROWS)
                codes = code_rows(x[rows], sent.value)
                margins = np.zeros((len(codes), classes))
                cells = (codes, y[rows], w[rows], margins)
                yield _pack(
                    {"block": part << 32 | number, "n": len(codes)}
                    | {k: c.tobytes() for k, c in zip(("codes", "y", "w", "margins"), cells)}
                )
                number += 1

    rows = df.select(vector_to_array(features).alias("x"), F.col(label), F.col(weight).cast("double"))
    return _stored(rows.mapInArrow(run, _BLOCKS))


def _stored(blocks: DataFrame) -> DataFrame:
    path = scratch_path(blocks.sparkSession, "tree-blocks")
    blocks.write.parquet(path)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path)


@dataclass
class Rows:
    """One block, read back."""

    block: int
    codes: np.ndarray
    y: np.ndarray
    w: np.ndarray
    margins: np.ndarray
    #: what the trees of a round share: rows that take part and their class shares
    shares: tuple[np.ndarray, np.ndarray] | None = None


def _read(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Rows]:
    for batch in batches:
        for r in batch.to_pylist():
            numbers = lambda name, kind: np.frombuffer(r[name], dtype=kind)  # noqa: B023, E731
            codes = numbers("codes", np.uint8).reshape(-1, width)
            margins = numbers("margins", np.float64).reshape(len(codes), -1)
            yield Rows(r["block"], codes, numbers("y", np.int32), numbers("w", np.float64), margins)


# --- cuts ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """When a node is cut, and what a leaf holds.

    ``boost``: statistics are gradient and hessian sums; a leaf holds ``-rate * T(G) / (H + l2)``
    where T moves G towards zero by ``l1``. ``gini``: statistics are weights per class; a leaf
    holds their shares.
    """

    kind: str
    stats: int
    depth: int | None = None
    min_split: int = 2
    min_weight: float = 0.0
    l1: float = 0.0
    l2: float = 1.0
    rate: float = 1.0
    #: features looked at in a node, none for all
    tried: int | None = None

    def leaf(self, total: np.ndarray) -> np.ndarray:
        if self.kind == "boost":
            return -self.rate * np.atleast_1d(_soft(total[0], self.l1)) / (total[1] + self.l2)
        return total / max(total.sum(), 1e-300)

    def open(self, total: np.ndarray, rows: float, depth: int) -> bool:
        if (self.depth is not None and depth >= self.depth) or rows < max(self.min_split, 2):
            return False
        return self.kind == "boost" or int((total > 0).sum()) > 1

    def gains(self, left: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Gain of each cut; ``left`` has statistics first and row counts last on axis 0."""
        right = total[:, None, None] - left
        if self.kind == "boost":
            g, h = left[0], left[1]
            part = lambda g, h: _soft(g, self.l1) ** 2 / (h + self.l2)
            gain = part(g, h) + part(right[0], right[1]) - part(total[0], total[1])
            fine = (h >= self.min_weight) & (right[1] >= self.min_weight) & (gain > 1e-6)
        else:
            side = lambda s: (s[:-1] ** 2).sum(axis=0) / np.maximum(s[:-1].sum(axis=0), 1e-300)
            whole = total[:-1]
            gain = side(left) + side(right) - (whole**2).sum() / max(whole.sum(), 1e-300)
            fine = gain > -1e-9 * max(whole.sum(), 1e-300)
        return np.where(fine & (left[-1] >= 1) & (right[-1] >= 1), gain, -np.inf)


def _soft(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def histogram(codes: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Sums per statistic (last: rows), feature and bin."""
    width = codes.shape[1]
    out = np.empty((stats.shape[1] + 1, width, BINS))
    if len(codes) >= LONG:
        weights = np.ascontiguousarray(stats.T)
        for j in range(width):
            at = codes[:, j].astype(np.intp)
            for s, w in enumerate(weights):
                out[s, j] = np.bincount(at, weights=w, minlength=BINS)
            out[-1, j] = np.bincount(at, minlength=BINS)
        return out
    at = (codes + BINS * np.arange(width)).ravel()
    for s in range(stats.shape[1]):
        out[s] = np.bincount(at, weights=np.repeat(stats[:, s], width), minlength=width * BINS).reshape(width, BINS)
    out[-1] = np.bincount(at, minlength=width * BINS).reshape(width, BINS)
    return out


def best_cut(hist: np.ndarray, rule: Rule) -> tuple[float, int, int, np.ndarray]:
    """Gain, feature, last bin on the left, statistics on the left; the first of equal gains."""
    left = np.cumsum(hist, axis=2)
    gain = rule.gains(left, left[:, 0, -1])
    at = int(np.argmax(gain))
    j, b = divmod(at, BINS)
    return float(gain[j, b]), j, b, left[:, j, b]


def _child(key: int, side: int) -> int:
    return (key * 6364136223846793005 + 1442695040888963407 * (side + 1)) & (2**63 - 1)


def _order(seed: int, key: int, allowed: np.ndarray) -> np.ndarray:
    return np.random.default_rng((seed, key)).permutation(allowed)


@dataclass
class Grown:
    """A finished tree: a cut node's ``left`` is its left child, which the right one follows, a
    leaf's is the complement of its row in ``values``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    values: np.ndarray

    def plain(self) -> tuple[np.ndarray, ...]:
        """Feature (-1 in a leaf), cut, left child and value by node."""
        leaf = self.feature < 0
        value = np.zeros((len(leaf), self.values.shape[1]))
        value[leaf] = self.values[~self.left[leaf]]
        return self.feature.astype(np.int32), self.cut.astype(np.int16), np.where(leaf, 0, self.left), value

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """Value of the leaf of every row."""
        return self.values[~self.left[descend(codes, self.feature, self.cut, self.left)]]


@dataclass
class Tree:
    """Nodes in order of birth; the right child follows the left one; -1 marks a leaf. ``below`` has
    finished trees that take the place of a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[np.ndarray] = field(default_factory=lambda: [np.zeros(1)])
    below: dict[int, Grown] = field(default_factory=dict)

    def split(self, node: int, feature: int, cut: int) -> int:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for _ in range(2):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.value.append(np.zeros_like(self.value[node]))
        return self.left[node]

    def grown(self) -> Grown:
        feature, cut = np.array(self.feature, np.int16), np.array(self.cut, np.uint8)
        own = np.flatnonzero((feature < 0) & ~np.isin(np.arange(len(feature)), list(self.below)))
        left = np.array(self.left, np.int32)
        left[own] = ~np.arange(len(own), dtype=np.int32)
        lists, nodes, leaves = [[feature], [cut], [left], [self.value[i][None] for i in own.tolist()]], len(feature), len(own)
        for node, sub in self.below.items():
            moved = np.where(sub.feature < 0, sub.left - leaves, sub.left + (nodes - 1)).astype(np.int32)
            feature[node], cut[node], left[node] = sub.feature[0], sub.cut[0], moved[0]
            for out, x in zip(lists, (sub.feature[1:], sub.cut[1:], moved[1:], sub.values)):
                out.append(x)
            nodes, leaves = nodes + len(moved) - 1, leaves + len(sub.values)
        return Grown(*(np.concatenate(x) for x in lists))

    def shape(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature, np.int32), np.array(self.cut, np.int16), np.array(self.left, np.int32)


def _small(tree: Tree) -> dict[str, bytes]:
    """A whole subtree in a row. Its nodes were cut in their order, so children need no numbers."""
    feature = np.array(tree.feature, np.int16)
    own = [tree.value[i] for i in np.flatnonzero(feature < 0).tolist()]
    values, leaf = np.unique(np.array(own), axis=0, return_inverse=True)
    cells = {"feature": feature, "cut": np.array(tree.cut, np.uint8), "leaf": leaf.ravel().astype(np.int32), "value": values}
    return {c: zlib.compress(x.tobytes(), 1) for c, x in cells.items()}


def _large(row, stats: int) -> Grown:
    read = lambda c, kind: np.frombuffer(zlib.decompress(row[c]), dtype=kind)
    feature = read("feature", np.int16)
    cuts = feature >= 0
    left = np.empty(len(feature), np.int32)
    left[cuts] = 1 + 2 * np.arange(int(cuts.sum()), dtype=np.int32)
    left[~cuts] = ~read("leaf", np.int32)
    return Grown(feature, read("cut", np.uint8), left, read("value", np.float64).reshape(-1, stats))


def descend(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Node of every row."""
    node = np.zeros(len(codes), dtype=np.int64)
    live = np.arange(len(codes)) if feature[0] >= 0 else np.empty(0, dtype=np.int64)
    while len(live):
        at = node[live]
        node[live] = left[at] + (codes[live, feature[at]] > cut[at])
        live = live[feature[node[live]] >= 0]
    return node


def grow(codes: np.ndarray, stats: np.ndarray, rule: Rule, allowed: np.ndarray, seed: int, key: int, depth: int) -> Tree:
    """The whole subtree of a node from its rows."""
    tree = Tree()
    todo = deque([(0, np.arange(len(codes)), key, depth)])
    while todo:
        node, rows, key, depth = todo.popleft()
        own = stats[rows]
        total = own.sum(axis=0)
        tree.value[node] = rule.leaf(total)
        if not rule.open(total, len(rows), depth):
            continue
        order = allowed if rule.tried is None else _order(seed, key, allowed)
        step = len(order) if rule.tried is None else rule.tried
        for at in range(0, len(order), step):  # further features only if none of the first can be cut
            looked = order[at : at + step]
            part = codes[rows[:, None], looked]
            gain, j, b, _ = best_cut(histogram(part, own), rule)
            if gain > -math.inf:
                break
        else:
            continue
        first = tree.split(node, int(looked[j]), b)
        goes_right = part[:, j] > b
        todo += [(first, rows[~goes_right], _child(key, 0), depth + 1), (first + 1, rows[goes_right], _child(key, 1), depth + 1)]
    return tree


# --- growing on Spark ---------------------------------------------------------------------------

#: rows of a block, number of a tree -> statistics and rows that take part
Stats = Callable[[Rows, int], tuple[np.ndarray, np.ndarray]]


@dataclass
class _Open:
    tree: int
    node: int
    key: int
    depth: int
    rows: float


def _level_pass(blocks: DataFrame, trees: list[Tree], nodes: list[_Open], stats: Stats, rule: Rule, looked: dict, width: int):
    """Best cut of every node of the pass: ``(tree, node) -> gain, feature, bin, left, total``."""
    shapes = {n.tree: trees[n.tree].shape() for n in nodes}
    wanted = {(n.tree, n.node) for n in nodes}
    sent = blocks.sparkSession.sparkContext.broadcast((shapes, wanted, looked))

    def add_up(batches):
        shapes, wanted, looked = sent.value
        sums: dict = {}
        for rows in _read(batches, width):
            for t, shape in shapes.items():
                values, part = stats(rows, t)
                at = descend(rows.codes[part], *shape)
                for node in np.unique(at).tolist():
                    if (t, node) in wanted:
                        mine = part[at == node]
                        hist = histogram(rows.codes[mine[:, None], looked[t, node]], values[at == node])
                        sums[t, node] = sums[t, node] + hist if (t, node) in sums else hist
        out, size = [], 0
        for (t, node), hist in sums.items():
            for at in range(0, hist.shape[1], FEATURES):
                out.append((t, node, at, np.ascontiguousarray(hist[:, at : at + FEATURES]).tobytes()))
                size += len(out[-1][-1])
                if size >= ROUTE_BYTES:
                    yield as_batch(out)
                    out, size = [], 0
        if out:
            yield as_batch(out)

    def as_batch(out):
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["tree", "node", "at", "hist"])

    def cut(table: pa.Table) -> pa.Table:
        t, node, at = (table.column(c)[0].as_py() for c in ("tree", "node", "at"))
        parts = (np.frombuffer(h.as_py(), dtype=np.float64) for h in table.column("hist"))
        hist = functools.reduce(np.add, parts).reshape(rule.stats + 1, -1, BINS)
        gain, j, b, left = best_cut(hist, rule)
        row = {"tree": t, "node": node, "feature": int(sent.value[2][t, node][at + j])}
        row |= {"gain": gain, "bin": b, "left": left.tolist(), "total": hist[:, j].sum(axis=1).tolist()}
        return pa.Table.from_pylist([row], schema=_CUT_ARROW)

    hists = blocks.mapInArrow(add_up, "tree int, node int, at int, hist binary")
    found: dict = {}
    for r in hists.groupBy("tree", "node", "at").applyInArrow(cut, _CUT).collect():
        if (r.tree, r.node) not in found or (r.gain, -r.feature) > (found[r.tree, r.node].gain, -found[r.tree, r.node].feature):
            found[r.tree, r.node] = r
    sent.unpersist()
    return {k: (r.gain, r.feature, r.bin, np.array(r.left), np.array(r.total)) for k, r in found.items()}


_CUT = "tree int, node int, feature int, gain double, bin int, left array<double>, total array<double>"
_CUT_ARROW = pa.schema(
    [(c, pa.int32()) for c in ("tree", "node", "feature")]
    + [("gain", pa.float64()), ("bin", pa.int32()), ("left", pa.list_(pa.float64())), ("total", pa.list_(pa.float64()))]
)


def _whole_nodes(blocks: DataFrame, trees: list[Tree], nodes: list[_Open], stats: Stats, rule: Rule, allowed, seed: int, width: int) -> None:
    """Rows of every small node meet in a task, and its subtree comes back."""
    shapes = {n.tree: trees[n.tree].shape() for n in nodes}
    keys = {(n.tree, n.node): (n.key, n.depth) for n in nodes}
    sent = blocks.sparkSession.sparkContext.broadcast((shapes, keys, allowed))

    def route(batches):
        shapes, keys, _ = sent.value
        out, size = [], 0
        for rows in _read(batches, width):
            for t, shape in shapes.items():
                values, part = stats(rows, t)
                at = descend(rows.codes[part], *shape)
                for node in np.unique(at).tolist():
                    if (t, node) in keys:
                        mine = at == node
                        out.append((t, node, rows.block, rows.codes[part[mine]].tobytes(), np.ascontiguousarray(values[mine]).tobytes()))
                        size += len(out[-1][-2]) + len(out[-1][-1])
                if size >= ROUTE_BYTES:
                    yield as_batch(out)
                    out, size = [], 0
        if out:
            yield as_batch(out)

    def as_batch(out):
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["tree", "node", "block", "codes", "stats"])

    def finish(table: pa.Table) -> pa.Table:
        _, keys, allowed = sent.value
        t, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        order = np.argsort(table.column("block").to_numpy())
        read = lambda c, kind: [np.frombuffer(table.column(c)[i].as_py(), dtype=kind) for i in order.tolist()]
        codes = np.concatenate(read("codes", np.uint8)).reshape(-1, width)
        values = np.concatenate(read("stats", np.float64)).reshape(len(codes), -1)
        key, depth = keys[t, node]
        row = {"tree": t, "node": node} | _small(grow(codes, values, rule, allowed[t], seed, key, depth))
        kinds = [("tree", pa.int32()), ("node", pa.int32()), *((c, pa.binary()) for c in ("feature", "cut", "leaf", "value"))]
        return pa.Table.from_pylist([row], schema=pa.schema(kinds))

    sub = (
        blocks.mapInArrow(route, "tree int, node int, block bigint, codes binary, stats binary")
        .groupBy("tree", "node")
        .applyInArrow(finish, "tree int, node int, feature binary, cut binary, leaf binary, value binary")
        .collect()
    )
    for r in sorted(sub, key=lambda r: (r.tree, r.node)):
        trees[r.tree].below[r.node] = _large(r, 1 if rule.kind == "boost" else rule.stats)
    sent.unpersist()


def grow_trees(blocks: DataFrame, count: int, rows: int, width: int, stats: Stats, rule: Rule, allowed: dict[int, np.ndarray], seed: int, small: int = SMALL) -> list[Tree]:
    """``count`` trees that grow together; ``allowed`` has the features of each tree."""
    trees = [Tree() for _ in range(count)]
    large = [_Open(t, 0, int(np.random.default_rng((seed, t)).integers(2**62)), 0, rows) for t in range(count)]
    little: list[_Open] = []
    every: set[tuple[int, int]] = set()  # nodes none of whose first features could be cut
    while large:
        now, later, size = [], [], 0
        looked = {}
        for n in large:
            if n.rows <= small:
                little.append(n)
                continue
            order = allowed[n.tree]
            if rule.tried is not None and (n.tree, n.node) not in every:
                order = _order(seed, n.key, order)[: rule.tried]
            size += len(order) * BINS * (rule.stats + 1) * 8
            if now and size > PASS_BYTES:
                later.append(n)
                continue
            now.append(n)
            looked[n.tree, n.node] = np.sort(order)
        if now:
            cuts = _level_pass(blocks, trees, now, stats, rule, looked, width)
            for n in now:
                if (n.tree, n.node) not in cuts:  # no row came here
                    trees[n.tree].value[n.node] = rule.leaf(np.zeros(rule.stats))
                    continue
                gain, feature, b, left, total = cuts[n.tree, n.node]
                trees[n.tree].value[n.node] = rule.leaf(total[:-1])
                if not rule.open(total[:-1], total[-1], n.depth):
                    continue
                if gain == -math.inf:
                    if rule.tried is not None and (n.tree, n.node) not in every:
                        every.add((n.tree, n.node))
                        later.append(n)
                    continue
                first = trees[n.tree].split(n.node, feature, b)
                for side, part in enumerate((left, total - left)):
                    if rule.kind == "boost" and not rule.open(part[:-1], part[-1], n.depth + 1):
                        trees[n.tree].value[first + side] = rule.leaf(part[:-1])  # its rows need no further pass
                        continue
                    later.append(_Open(n.tree, first + side, _child(n.key, side), n.depth + 1, part[-1]))
        large = later
    if little:
        _whole_nodes(blocks, trees, little, stats, rule, allowed, seed, width)
    return trees


# --- the two families ---------------------------------------------------------------------------


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def add_margins(codes: np.ndarray, margins: np.ndarray, rounds: Sequence[Sequence[tuple]]) -> np.ndarray:
    """Margins plus the leaf values of the trees (one per class) of further rounds."""
    out = margins.copy()
    for trees in rounds:
        for k, (feature, cut, left, value) in enumerate(trees):
            out[:, k] += value[descend(codes, feature, cut, left), 0]
    return out


def fit_boosting(
    train: DataFrame,
    features: str,
    classes: int,
    *,
    label: str = "label_index",
    weight: str = "weight",
    trees: int = 100,
    depth: int = DEFAULT_DEPTH,
    rate: float = 0.3,
    subsample: float = 1.0,
    columns: float = 1.0,
    min_weight: float = 1.0,
    l1: float = 0.0,
    l2: float = 1.0,
    seed: int = 42,
    small: int = SMALL,
) -> "TreeModel":
    """Softmax boosting: each round grows one tree per class on the gradients of the log loss.

    ``subsample`` draws rows anew in each round, ``columns`` the features of each tree; a child
    needs ``min_weight`` of hessian. Draws depend on the stored order of rows.
    """
    edges = quantile_edges(train, features)
    width = len(edges)
    with scratch_scope([]) as written:
        blocks = to_blocks(train, features, label, weight, edges, classes)
    n = blocks.agg(F.sum("n")).first()[0] or 0
    refresh = REFRESH if n <= small else min(REFRESH, REFRESH_LARGE)
    rule = Rule("boost", 2, depth, 2, min_weight, l1, l2, rate)
    done: list[Grown] = []
    pending: list[list[tuple]] = []
    for r in range(trees if n else 0):
        held = blocks.sparkSession.sparkContext.broadcast(pending)

        def stats(rows: Rows, k: int, held=held, r=r) -> tuple[np.ndarray, np.ndarray]:
            if rows.shares is None:
                part = np.arange(len(rows.y))
                if subsample < 1:
                    part = np.flatnonzero(np.random.default_rng((seed, r, rows.block)).random(len(part)) < subsample)
                rows.shares = part, _softmax(add_margins(rows.codes[part], rows.margins[part], held.value))
            part, p = rows.shares
            p = p[:, k]
            w = rows.w[part]
            return np.stack([w * (p - (rows.y[part] == k)), w * np.maximum(2 * p * (1 - p), 1e-16)], axis=1), part

        kept = max(1, int(columns * width))
        allowed = {
            k: np.sort(np.random.default_rng((seed, 1, r, k)).permutation(width)[:kept]) for k in range(classes)
        }
        grown = [t.grown() for t in grow_trees(blocks, classes, n, width, stats, rule, allowed, seed + r, small)]
        held.unpersist()
        done += grown
        pending = [*pending, [t.plain() for t in grown]]
        if len(pending) == refresh:
            with scratch_scope([]) as newer:
                blocks, pending = _refreshed(blocks, pending, width), []
            drop_scratch(train.sparkSession, written)
            written = newer
    return TreeModel(inputCol=features, model=_dumped("boost", edges, done, classes))


def _refreshed(blocks: DataFrame, rounds: list, width: int) -> DataFrame:
    sent = blocks.sparkSession.sparkContext.broadcast(rounds)

    def run(batches):
        for rows in _read(batches, width):
            margins = add_margins(rows.codes, rows.margins, sent.value)
            cells = {k: x.tobytes() for k, x in zip(("codes", "y", "w"), (rows.codes, rows.y, rows.w))}
            yield _pack({"block": rows.block, "n": len(margins)} | cells | {"margins": margins.tobytes()})

    return _stored(blocks.mapInArrow(run, _BLOCKS))


def fit_forest(
    train: DataFrame,
    features: str,
    classes: int,
    *,
    label: str = "label_index",
    weight: str = "weight",
    trees: int = 100,
    depth: int | None = None,
    min_split: int = 2,
    seed: int = 42,
    small: int = SMALL,
) -> "TreeModel":
    """Gini forest of any depth: every tree sees rows with Poisson(1) repetitions and looks at the
    square root of all features in a node (further ones only if none of these can be cut); nodes
    of fewer than ``min_split`` rows stay leaves. A row's class shares are averaged over trees."""
    edges = quantile_edges(train, features)
    width = len(edges)
    blocks = to_blocks(train, features, label, weight, edges, classes)
    n = blocks.agg(F.sum("n")).first()[0] or 0

    def stats(rows: Rows, t: int) -> tuple[np.ndarray, np.ndarray]:
        times = np.random.default_rng((seed, t, rows.block)).poisson(1.0, len(rows.y))
        part = np.flatnonzero(times)
        one_hot = rows.y[part][:, None] == np.arange(classes)
        return one_hot * (rows.w[part] * times[part])[:, None], part

    rule = Rule("gini", classes, depth, min_split, tried=max(1, math.isqrt(width)))
    allowed = {t: np.arange(width) for t in range(trees)}
    grown = grow_trees(blocks, trees, n, width, stats, rule, allowed, seed, small) if n else []
    return TreeModel(inputCol=features, model=_dumped("forest", edges, [t.grown() for t in grown], classes))


# --- the fitted stage ---------------------------------------------------------------------------


def _dumped(kind: str, edges: Sequence[np.ndarray], trees: list[Grown], classes: int) -> str:
    """A cut node's child is kept by its distance from the one before, nearly always 2."""
    joined = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind, copy=False)
    firsts = np.cumsum([0, *(len(t.values) for t in trees)])
    stacked = np.concatenate([t.values for t in trees]) if trees else np.empty((0, 1))
    values, place = np.unique(stacked, axis=0, return_inverse=True)
    place = place.ravel().astype(np.int32)
    return dumped(
        kind=kind,
        classes=classes,
        sizes=np.array([len(t.feature) for t in trees], dtype=np.int64),
        ends=np.cumsum([len(e) for e in edges]),
        edges=np.concatenate([*edges, []]),
        feature=joined([t.feature for t in trees], np.int16),
        cut=joined([t.cut for t in trees], np.uint8),
        step=joined([np.diff(t.left[t.feature >= 0], prepend=np.int32(0)) for t in trees], np.int32),
        leaf=joined([place[first + ~t.left[t.feature < 0]] for first, t in zip(firsts.tolist(), trees)], np.int32),
        value=values,
    )


def _unpacked(z: dict) -> dict:
    feature, cut, values = z["feature"], z["cut"], z["value"]
    ends = np.cumsum(z["sizes"]).tolist()
    trees, step, leaf = [], z["step"] if "step" in z else None, z["leaf"] if "leaf" in z else None
    cuts_at = leaf_at = 0
    for start, end in zip([0, *ends], ends):
        own = feature[start:end]
        cuts = own >= 0
        if step is None:  # a model saved with a value by node
            left = np.where(cuts, z["left"][start:end], ~np.arange(start, end)).astype(np.int32)
        else:
            n = int(cuts.sum())
            left = np.empty(end - start, np.int32)
            left[cuts] = np.cumsum(step[cuts_at : cuts_at + n], dtype=np.int32)
            left[~cuts] = ~leaf[leaf_at : leaf_at + end - start - n]
            cuts_at, leaf_at = cuts_at + n, leaf_at + end - start - n
        trees.append(Grown(own, cut[start:end], left, values))
    edges = np.split(z["edges"], z["ends"][:-1]) if len(z["ends"]) else []
    return {"kind": str(z["kind"]), "classes": int(z["classes"]), "edges": edges, "trees": trees}


def unpacked(model: str) -> dict:
    """Kind, classes, edges and trees (feature, cut, left child and value by node) of a fitted model."""
    m = loaded(model, _unpacked)
    return m | {"trees": [t.plain() for t in m["trees"]]}


def class_shares(model: str, x: np.ndarray) -> np.ndarray:
    """Probability of every class for rows of raw features."""
    m = loaded(model, _unpacked)
    codes, k = code_rows(x, m["edges"]), m["classes"]
    total = np.zeros((len(x), k))
    if m["kind"] == "boost":
        for i, tree in enumerate(m["trees"]):
            total[:, i % k] += tree.leaves(codes)[:, 0]
        return _softmax(total)
    for tree in m["trees"]:
        total += tree.leaves(codes)
    return total / len(m["trees"]) if m["trees"] else np.full((len(x), k), 1 / k)


class TreeModel(SharesModel):
    """Trees as a stage."""

    shares = staticmethod(class_shares)
