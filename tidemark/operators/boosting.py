"""Boosted trees grown over a whole table, level by level.

Rows stay where they are: each feature is one byte, its equal-frequency bin, in a table written once. A level of a tree is one pass.
Tasks apply the trees so far to their rows, sum gradients and Hessians by (node, feature, bin), and Spark adds the tasks' sums; only
those bins, at most nodes x features x bins of them, reach the driver, which picks the splits. Of two siblings the smaller is
summed, the other is what is left of their parent.

Gradients are summed as whole numbers of 2^-24, so a tree is the same however rows are dealt out, up to 5 * 10^11 rows. Margins
are written anew every so many trees; between, tasks apply the trees since.

Cases. Rows without a label are left out. A null or NaN feature is in the last bin and always goes right. A table without rows, or of one
class, gives trees of one leaf. Repeated keys are drawn together where rows are subsampled; nulls of the key too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, stored
from .drift import melt
from .metrics import order_statistics
from .models import GBT, sigmoid

ONE = 1 << 24
_BINNED = "bins binary, y double, u bigint, raw double"
_SUMS = pa.schema([("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("n", pa.int64()), ("g", pa.int64()), ("h", pa.int64())])
_SUMS_DDL = "node int, feature int, bin int, n bigint, g bigint, h bigint"
#: The node under which a pass reports its rows and their loss.
_LOSS = -1


@dataclass
class Tree:
    """Nodes by their place in a full binary tree. A node with a feature has children at 2k + 1 and 2k + 2; bins up to cut go left."""

    depth: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)
    rows: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        size = 2 ** (self.depth + 1) - 1
        self.feature, self.cut, self.rows = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        self.value, self.gain = np.zeros(size), np.zeros(size)

    def place(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node that each row comes to in so many levels."""
        node, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for _ in range(self.depth if levels is None else levels):
            f = self.feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (bins[rows, f] > self.cut[node]), node)
        return node

    def as_dict(self, edges: list[np.ndarray], k: int = 0) -> dict:
        """Thresholds in place of bins: bins up to cut hold what is below the edge after it."""
        if self.feature[k] < 0:
            return {"value": float(self.value[k])}
        f = int(self.feature[k])
        threshold = float(np.nextafter(edges[f][self.cut[k]], -np.inf))
        return {"feature": f, "threshold": threshold, "left": self.as_dict(edges, 2 * k + 1), "right": self.as_dict(edges, 2 * k + 2)}

    def nodes(self) -> list[int]:
        """The nodes that there are, parents first."""
        out, todo = [], [0]
        while todo:
            k = todo.pop(0)
            out.append(k)
            if self.feature[k] >= 0:
                todo += [2 * k + 1, 2 * k + 2]
        return out


def edges_of(rows: DataFrame, features: list[str], bins: int = 256) -> list[np.ndarray]:
    """For each feature the distinct inner edges of equal-frequency bins: at most bins - 1 numbers a feature."""
    found = {r["feature"]: r["edges"] for r in order_statistics(melt(rows, features), "feature", "x", [k / bins for k in range(1, bins)]).collect()}
    return [np.unique(np.array(found.get(f, []), dtype=np.float64)) for f in features]


def binned(rows: DataFrame, features: list[str], label: str, key: str, edges: list[np.ndarray], start: float) -> DataFrame:
    """A byte a feature, the label, a hash of the key, and the margin."""
    known = rows.filter(F.col(label).isNotNull()).select(*(F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)), F.col(label).cast("double").alias("y"), F.xxhash64(key).alias("u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [b.column(k).to_numpy(zero_copy_only=False) for k in range(len(edges))]
            m = np.stack([np.searchsorted(e, np.where(np.isnan(c), np.inf, c), side="right") for e, c in zip(edges, x, strict=True)], axis=1).astype(np.uint8)
            data = pa.array([m[k].tobytes() for k in range(len(m))], pa.binary())
            yield pa.RecordBatch.from_arrays([data, b.column(len(edges)), b.column(len(edges) + 1), pa.array(np.full(len(m), start))], ["bins", "y", "u", "raw"])

    return known.mapInArrow(run, _BINNED)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), d)


def drawn(u: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Whether a row takes part in a tree, by its key's hash."""
    x = u.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1B54A32D192ED03) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) < share * 2**53


def slopes(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss, in whole numbers of 2^-24."""
    p = sigmoid(raw)
    return np.rint((p - y) * ONE), np.rint(p * (1 - p) * ONE)


def _margins(raw: np.ndarray, bins: np.ndarray, trees: list[Tree], lr: float) -> np.ndarray:
    for t in trees:
        raw = raw + lr * t.value[t.place(bins)]
    return raw


def level_sums(table: DataFrame, d: int, since: list[Tree], lr: float, tree: Tree | None, number: int, level: int, wanted: list[int], share: float, seed: int, width: int = 256) -> dict[int, np.ndarray]:
    """For each wanted node of the tree's level the sums (rows, gradient, Hessian) by feature and bin; under -1 the rows of the table and
    their loss with the trees since the margins were written."""
    slot = np.full(2 ** (level + 1) - 1, -1)
    slot[wanted] = np.arange(len(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(wanted) * d * width), dtype=np.int64)
        rows = loss = 0
        for b in batches:
            bins, y = _matrix(b.column(0), d), b.column(1).to_numpy()
            raw = _margins(b.column(3).to_numpy(), bins, since, lr)
            p = np.clip(sigmoid(raw), 1e-7, 1 - 1e-7)
            rows, loss = rows + len(y), loss + int(np.rint(-(y * np.log(p) + (1 - y) * np.log(1 - p)) * ONE).sum())
            if not wanted:
                continue
            own = slot[tree.place(bins, level)]
            here = np.flatnonzero((own >= 0) & drawn(b.column(2).to_numpy(), number, seed, share))
            g, h = slopes(raw[here], y[here])
            cell = ((own[here, None] * d + np.arange(d)) * width + bins[here]).ravel()
            for k, weight in enumerate((None, np.repeat(g, d), np.repeat(h, d))):
                sums[k] += np.bincount(cell, weight, sums.shape[1]).astype(np.int64)
        there = np.flatnonzero(sums[0])
        node, feature = np.array(wanted, dtype=np.int64)[there // (d * width)] if wanted else there, there // width % d
        cols = [np.r_[_LOSS, node], np.r_[0, feature], np.r_[0, there % width], np.r_[rows, sums[0, there]], np.r_[loss, sums[1, there]], np.r_[0, sums[2, there]]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SUMS, strict=True)], schema=_SUMS)

    total = table.mapInArrow(run, _SUMS_DDL).groupBy("node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))
    out = {k: np.zeros((3, d, width), dtype=np.int64) for k in [*wanted, _LOSS]}
    for r in total.collect():
        out[r["node"]][:, r["feature"], r["bin"]] = r["n"], r["g"], r["h"]
    return out


def best_cut(sums: np.ndarray, features: list[int], model: GBT) -> tuple[float, int, int] | None:
    """Gain, feature and bin of the best split of a node, the first of equals; None where none gains."""
    best = None
    for f in sorted(features):
        n, g, h = (np.cumsum(s[f]) for s in sums)
        left, g, h, all_g, all_h = n[:-1], g[:-1] / ONE, h[:-1] / ONE, g[-1] / ONE, h[-1] / ONE
        fine = (left > 0) & (left < n[-1]) & (h >= model.min_child) & (all_h - h >= model.min_child)
        if not fine.any():
            continue
        gain = 0.5 * (g**2 / (h + model.penalty) + (all_g - g) ** 2 / (all_h - h + model.penalty) - all_g**2 / (all_h + model.penalty)) - model.gamma
        gain[~fine] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] > 0 and (best is None or gain[k] > best[0]):
            best = float(gain[k]), f, k
    return best


def _columns(model: GBT, d: int, number: int, node: int) -> list[int]:
    rng = np.random.default_rng([model.rng_seed, number, node])
    return rng.choice(d, max(1, int(model.colsample * d)), replace=False).tolist()


def _grow(table: DataFrame, d: int, model: GBT, since: list[Tree], number: int) -> tuple[Tree, float]:
    """One more tree, and the mean loss before it."""
    tree, loss = Tree(model.depth), 0.0
    sums: dict[int, np.ndarray] = {}
    pending = [(0, None, None)]  # node to sum, its sibling, their parent
    for level in range(model.depth + 1):
        got = level_sums(table, d, since, model.lr, tree, number, level, [k for k, _, _ in pending], model.subsample, model.rng_seed)
        if level == 0:
            n, total = got[_LOSS][0, 0, 0], got[_LOSS][1, 0, 0]
            loss = total / ONE / n if n else 0.0
        here = {}
        for k, sibling, parent in pending:
            here[k] = got[k]
            if sibling is not None:
                here[sibling] = sums[parent] - got[k]
        sums, pending = here, []
        for k in sorted(here):
            n, g, h = (int(s[0].sum()) for s in here[k])
            tree.rows[k], tree.value[k] = n, -(g / ONE) / (h / ONE + model.penalty) if n else 0.0
            split = best_cut(here[k], _columns(model, d, number, k), model) if level < model.depth and n > 1 else None
            if split is not None:
                tree.gain[k], tree.feature[k], tree.cut[k] = split
                left = int(here[k][0, split[1], : split[2] + 1].sum())
                small = 2 * k + 1 if left <= n - left else 2 * k + 2
                pending.append((small, 4 * k + 3 - small, k))
        if not pending:
            break
    return tree, loss


def fit(rows: DataFrame, features: list[str], label: str, key: str, model: GBT | None = None, bins: int = 256, block: int = 8) -> tuple[GBT, list[Tree], list[float]]:
    """The model trained on all of rows, its trees over bins, and the mean loss after each; bins may be 256 at most."""
    model = model or GBT()
    if not 2 <= bins <= 256:
        raise ValueError("bins must be from 2 to 256: a bin is a byte")
    size = rows.filter(F.col(label).isNotNull()).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("p")).first()
    rate = float(np.clip((size["p"] or 0.0) / max(1, size["n"]), 1e-7, 1 - 1e-7))
    model.start, model.trees, model.d = float(np.log(rate / (1 - rate))), [], len(features)
    edges = edges_of(rows, features, bins)
    table = stored(binned(rows, features, label, key, edges, model.start), "gbt-bins")
    trees: list[Tree] = []
    losses: list[float] = []
    since: list[Tree] = []
    for number in range(model.n_trees):
        if len(since) == block:
            table, since = _rewritten(table, len(features), since, model.lr), []
        tree, before = _grow(table, len(features), model, since, number)
        losses.append(before)
        trees.append(tree)
        since.append(tree)
        model.trees.append(tree.as_dict(edges))
    last = level_sums(table, len(features), since, model.lr, None, 0, 0, [], 1.0, 0)[_LOSS]
    losses.append(last[1, 0, 0] / ONE / max(1, last[0, 0, 0]))
    forget(table)
    return model, trees, losses[1:]


def _rewritten(table: DataFrame, d: int, since: list[Tree], lr: float) -> DataFrame:
    """The table with the margins that the trees since lead to; the one before goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = _margins(b.column(3).to_numpy(), _matrix(b.column(0), d), since, lr)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(raw)], b.schema.names)

    out = stored(table.mapInArrow(run, _BINNED), "gbt-bins")
    forget(table)
    return out


def tree_rows(trees: list[Tree], features: list[str]) -> list[tuple]:
    """(tree, node, feature, cut, rows, gain, value) of every node; feature and cut are null in leaves."""
    out = []
    for number, t in enumerate(trees):
        for k in t.nodes():
            inner = t.feature[k] >= 0
            out.append((number, k, features[t.feature[k]] if inner else None, int(t.cut[k]) if inner else None, int(t.rows[k]), float(t.gain[k]), float(t.value[k])))
    return out


TREE_ROWS = "tree int, node int, feature string, cut int, rows bigint, gain double, value double"
