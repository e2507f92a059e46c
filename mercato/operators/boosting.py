"""Leaf-wise histogram boosting of a binary target (CH5).

Features are cut into bins at approximate quantiles, and the rows are kept as blocks of bin
numbers.  A tree grows best first: of all leaves the one with the greatest gain is split
next, until ``leaves`` leaves, or ``depth``, are reached.  A node's best split depends on its
own rows only, so the nodes that best-first growth would split among those known are
searched together, in one pass over the rows; a node that it wouldn't reach yet can't be
reached later either, because nodes found below others only come before it.  A tree
takes at most ``depth`` passes, where one pass a split would take 127.

A pass sums gradients, curvatures and row counts by (node, feature, bin) inside each task,
and a tree of reducers adds these tables, so the driver gets one table of bounded
size (nodes x features x bins).  Gradients are whole multiples of 2^-24: sums don't depend
on the order of the rows, so with the same edges the same rows give the same model however they
are partitioned (approximate quantiles may differ a little between partitionings; ``edges`` fixes them).

Leaf values are -shrink(G, l1) / (H + l2).  A row is in the bag of ``bag_every`` trees by a hash of
its key, and each tree has its own choice of features.  Rounds end when the AUC of the
validation rows (from counts in GRADES classes of the probability) has not risen for
``patience`` trees; the trees up to the best remain.

A null or NaN feature counts as greater than every number.  Without training rows of both
classes the model has no trees and scores the share of the positive class.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from mercato.operators.attribution import Leaf
from mercato.session import checkpoint_root

BLOCK = 65_536   # rows of a block
UNIT = 2.0**24   # gradients are summed as whole multiples of 1 / UNIT
CHECKPOINT_EVERY = 20
GRADES = 1 << 16


@dataclass
class Settings:
    rounds: int = 5000
    step: float = 0.02
    leaves: int = 128
    depth: int = 9
    least_rows: int = 20
    l1: float = 1.0
    l2: float = 1.0
    bag: float = 0.8
    bag_every: int = 5
    features: float = 0.8
    bins: int = 128
    patience: int = 200
    seed: int = 42


@dataclass
class Tree:
    """Nodes in arrays, the root first; ``left`` is -1 for a leaf.  A row goes left if its bin is at most ``cut``."""
    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        open_ = np.flatnonzero(left[at] >= 0)
        while len(open_):
            n = at[open_]
            at[open_] = np.where(bins[open_, feature[n]] <= cut[n], left[n], right[n])
            open_ = open_[left[at[open_]] >= 0]
        return at


@dataclass
class Boosted:
    names: list[str]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree]
    losses: list[float]   # 1 - AUC of the validation rows, before each tree and after the last

    def bins(self, x: np.ndarray) -> np.ndarray:
        return binned(x, self.edges)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row of features."""
        b, out = self.bins(x), np.full(len(x), self.start)
        for t in self.trees:
            out += np.array(t.value)[t.places(b)]
        return out

    def leaf_paths(self) -> list[Leaf]:
        """The leaves as intervals of features, for the attributions (CH9)."""
        out = []
        for t in self.trees:
            stack = [(0, {})]
            while stack:
                n, path = stack.pop()
                if t.left[n] < 0:
                    f = sorted(path)
                    out.append(Leaf(t.value[n], np.array(f, np.int64), *(np.array([path[j][k] for j in f], float) for k in range(3))))
                    continue
                j, at = t.feature[n], float(self.edges[t.feature[n]][t.cut[n]])
                for child, is_left in ((t.left[n], True), (t.right[n], False)):
                    lo, hi, share = path.get(j, (-np.inf, np.inf, 1.0))
                    lo, hi = (lo, min(hi, at)) if is_left else (max(lo, at), hi)
                    stack.append((child, path | {j: (lo, hi, share * t.rows[child] / t.rows[n])}))
        return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin k holds edges[k-1] < x <= edges[k]; NaN is above all edges."""
    return np.stack([np.searchsorted(e, np.where(np.isnan(x[:, j]), np.inf, x[:, j]), "left") for j, e in enumerate(edges)], 1).astype(np.uint8)


def matrix_of(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names], 1).astype(float)


def bin_edges(rows: DataFrame, names: list[str], bins: int) -> list[np.ndarray]:
    """At most bins - 1 distinct approximate quantiles of each feature (finite values)."""
    real = rows.select(*[F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")),
                                F.col(c).cast("double")).alias(c) for c in names])
    cuts = real.approxQuantile(names, [k / bins for k in range(1, bins)], 1 / (4 * bins))
    return [np.unique(np.array(c, float)) for c in cuts]


def in_bag(key: np.ndarray, draw: int, share: float) -> np.ndarray:
    """Whether each row is in bag number ``draw``: a hash of its key and the number."""
    with np.errstate(over="ignore"):
        x = key.view(np.uint64) + np.uint64(draw + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(float) / 2.0**53 < share


def best_first(root: int, gain: dict[int, float], children: dict[int, tuple[int, int]], most: int) -> list[int]:
    """The nodes that best-first growth splits, at most ``most`` of them, in order; a node
    without children here is split without any known below it."""
    heap, out = [(-gain[root], root)] if root in gain else [], []
    while heap and len(out) < most:
        _, n = heapq.heappop(heap)
        out.append(n)
        for c in children.get(n, ()):
            if c in gain:
                heapq.heappush(heap, (-gain[c], c))
    return out


def lost_area(counts: np.ndarray) -> float:
    """1 - AUC from the rows of both classes (rows of ``counts``) by grade; rows of one grade are ties.
    0 if a class has no rows."""
    clean, marked = counts.astype(float)
    if not clean.sum() or not marked.sum():
        return 0.0
    below = np.cumsum(clean) - clean
    return float(1 - (marked * (below + clean / 2)).sum() / (clean.sum() * marked.sum()))


def shrink(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def best_splits(table: np.ndarray, chosen: np.ndarray, last: np.ndarray, s: Settings) -> list[tuple[float, int, int]]:
    """(gain, feature, cut) of each node of ``table`` (nodes, features, bins, 3); gain 0 without a split."""
    total = table[:, np.flatnonzero(chosen)[:1]].sum(2, keepdims=True)  # a feature left out has no counts
    left = np.cumsum(table, 2)[:, :, :-1]
    right = total - left

    def worth(t: np.ndarray) -> np.ndarray:
        return shrink(t[..., 0] / UNIT, s.l1) ** 2 / (t[..., 1] / UNIT + s.l2)

    gain = worth(left) + worth(right) - worth(total)
    fits = (left[..., 2] >= s.least_rows) & (right[..., 2] >= s.least_rows)
    fits &= chosen[None, :, None] & (np.arange(left.shape[2])[None, :] < last[:, None])[None]
    gain = np.where(fits, gain, 0).reshape(len(table), -1)
    at = gain.argmax(1)
    return [(float(g[k]), int(k // left.shape[2]), int(k % left.shape[2])) for g, k in zip(gain, at)]


def to_blocks(rows: DataFrame, names: list[str], edges: list[np.ndarray], key: str, label: str, weight: str, validation: str, parts: int):
    """An RDD of blocks (bins, label, weight, is validation, key hash); each holds at most BLOCK rows."""
    columns = rows.select(*names, F.xxhash64(key).alias("__key"), F.col(label).cast("double").alias("__y"),
                          F.col(weight).cast("double").alias("__w"), F.col(validation).alias("__v"))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                y, w, v, k = (part.column(c).to_numpy(zero_copy_only=False) for c in ("__y", "__w", "__v", "__key"))
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((binned(matrix_of(part, names), edges), y, w, v.astype(bool), k))])], ["block"])

    return columns.repartition(parts, "__key").mapInArrow(run, "block binary").rdd.map(lambda r: pickle.loads(r.block))


def grow(state, n_features: int, last: np.ndarray, number: int, s: Settings) -> tuple[Tree, float]:
    """One tree on the blocks with their margins, and 1 - AUC of the validation rows before it (0 without them)."""
    width = int(last.max()) + 1
    r = np.random.default_rng([s.seed, number])
    chosen = np.zeros(n_features, bool)
    chosen[r.permutation(n_features)[:max(1, int(np.ceil(s.features * n_features)))]] = True
    tree, gain, children, sums, cuts = Tree(), {}, {}, {}, {}
    loss, wanted, depth = 0.0, [0], {0: 0}
    while wanted:
        slot = np.full(len(tree.left), -1)
        slot[wanted] = np.arange(len(wanted))
        n_slots, first = len(wanted), wanted == [0]

        def add(acc, block, slot=slot, n_slots=n_slots, tree=tree, first=first):
            bins, y, w, v, key, margin = block
            p = 1 / (1 + np.exp(-margin))
            if first:
                grade = np.minimum((p[v] * GRADES).astype(np.int64), GRADES - 1) + GRADES * (y[v] == 1)
                acc = (acc[0], acc[1] + np.bincount(grade, minlength=2 * GRADES).reshape(2, GRADES))
            at = slot[tree.places(bins)]
            use = np.flatnonzero((at >= 0) & ~v & in_bag(key, s.seed + number // s.bag_every, s.bag))
            g, h = np.rint((w * (p - y))[use] * UNIT), np.rint((w * p * (1 - p))[use] * UNIT)
            size = n_slots * width
            table = np.zeros((n_slots, n_features, width, 3), np.int64) if acc[0] is None else acc[0]
            for j in np.flatnonzero(chosen):
                cell = at[use] * width + bins[use, j]
                for k, x in enumerate((g, h, None)):
                    table[:, j, :, k] += np.bincount(cell, x, size).astype(np.int64).reshape(n_slots, width)
            return table, acc[1]

        def merge(a, b):
            return b[0] if a[0] is None else a[0] if b[0] is None else a[0] + b[0], a[1] + b[1]

        table, counts = state.treeAggregate((None, np.zeros((2, GRADES if first else 0), np.int64)), add, merge, depth=2)
        if first:
            loss = lost_area(counts)
        if first and table is None:  # no rows
            return tree, loss
        if first:  # the sums of a node: of any feature that was counted
            sums[0] = table[0, int(np.flatnonzero(chosen)[0])].sum(0)
        for n, t, (worth, j, cut) in zip(wanted, table, best_splits(table, chosen, last, s)):
            if worth > 1e-9:
                gain[n], tree.feature[n], tree.cut[n] = worth, j, cut
                cuts[n] = t[j, :cut + 1].sum(0)
        wanted = []
        for n in best_first(0, gain, children, s.leaves - 1):
            if n not in children:
                for side, part in ((tree.left, cuts[n]), (tree.right, sums[n] - cuts[n])):
                    new = side[n] = len(tree.value)
                    depth[new], sums[new] = depth[n] + 1, part
                    if depth[new] < s.depth and part[2] >= 2 * s.least_rows:
                        wanted.append(new)
                    for column, x in ((tree.feature, 0), (tree.cut, 0), (tree.left, -1), (tree.right, -1), (tree.value, 0.0), (tree.rows, 0)):
                        column.append(x)
                children[n] = (tree.left[n], tree.right[n])
    return pruned(tree, set(best_first(0, gain, children, s.leaves - 1)), sums, s), loss


def pruned(tree: Tree, split: set[int], sums: dict[int, np.ndarray], s: Settings) -> Tree:
    """The tree with the nodes of ``split`` only, renumbered, with the leaves' values."""
    out, todo = Tree(), [(0, 0)]
    while todo:
        old, new = todo.pop()
        g, h, n = sums[old]
        out.rows[new] = int(n)
        if old not in split:
            out.value[new] = float(-s.step * shrink(np.array(g / UNIT), s.l1) / (h / UNIT + s.l2)) if n else 0.0
            continue
        out.feature[new], out.cut[new] = tree.feature[old], tree.cut[old]
        for side, child in ((out.left, tree.left[old]), (out.right, tree.right[old])):
            side[new] = len(out.value)
            todo.append((child, len(out.value)))
            for column, x in ((out.feature, 0), (out.cut, 0), (out.left, -1), (out.right, -1), (out.value, 0.0), (out.rows, 0)):
                column.append(x)
    return out


def fit(rows: DataFrame, names: list[str], key: str, label: str, weight: str, validation: str,
        settings: Settings | None = None, edges: list[np.ndarray] | None = None) -> Boosted:
    """Boosted trees for ``label`` (0 or 1), fitted on the rows where ``validation`` is false.
    Without validation rows all ``rounds`` are kept."""
    s = settings or Settings()
    checkpoint_root(rows.sparkSession)
    own = rows.where(~F.col(validation))
    n, up, down = own.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col(label) == 1, F.col(weight))), F.lit(0.0)),
                          F.coalesce(F.sum(F.when(F.col(label) != 1, F.col(weight))), F.lit(0.0))).first()
    if not up or not down:
        return Boosted(names, [np.zeros(0)] * len(names), 40.0 if up else -40.0, [], [])
    edges = edges or bin_edges(own, names, s.bins)
    last = np.array([len(e) for e in edges])
    start = float(np.log(up / down))
    state = to_blocks(rows, names, edges, key, label, weight, validation, n // 100_000 + 1).map(
        lambda b: (*b, np.full(len(b[1]), start))).persist(StorageLevel.MEMORY_AND_DISK)
    trees, losses, best, held = [], [], 0, []
    for number in range(s.rounds + 1):
        tree, loss = grow(state, len(names), last, number, s)
        losses.append(loss)
        if loss < losses[best]:
            best = number
        if number == s.rounds or (loss and number - best >= s.patience) or tree.left[0] < 0:
            break
        trees.append(tree)
        held.append(state)
        while len(held) > 1:
            held.pop(0).unpersist()
        state = state.map(lambda b, t=tree: (*b[:5], b[5] + np.array(t.value)[t.places(b[0])])).persist(StorageLevel.MEMORY_AND_DISK)
        if (number + 1) % CHECKPOINT_EVERY == 0:
            state.checkpoint()  # lost blocks are made again from here
    for x in (*held, state):
        x.unpersist()
    return Boosted(names, edges, start, trees[:best] if losses[0] else trees, losses)


def with_probability(rows: DataFrame, model: Boosted, name: str = "model_probability") -> DataFrame:
    """All columns of ``rows`` and the probability of label 1."""
    schema = StructType([*rows.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        for b in batches:
            p = 1 / (1 + np.exp(-model.margin(matrix_of(b, model.names)))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)
