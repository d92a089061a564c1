import math

import numpy as np
import pytest

from tidemark.operators import boosting as B
from tidemark.operators.models import GBT, sigmoid


def table(spark, n=3_000, seed=1):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 3)), 2)
    y = (x[:, 0] + 0.5 * x[:, 1] * (x[:, 2] > 0) + r.normal(size=n) * 0.5 > 0.4).astype(int)
    rows = [(k, *(None if j == 1 and k % 50 == 0 else float("nan") if j == 2 and k % 70 == 0 else float(v) for j, v in enumerate(x[k])), int(y[k]) if k % 90 else None) for k in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int").repartition(5), rows


def greedy(bins, u, y, model, number, start, before):
    """A tree grown depth first on all rows at once."""
    raw = np.full(len(y), start)
    for t in before:
        raw = raw + model.lr * t.value[t.place(bins)]
    own = np.flatnonzero(B.drawn(u, number, model.rng_seed, model.subsample))
    g, h = B.slopes(raw, y)
    tree = B.Tree(model.depth)

    def grow(k, rows, depth):
        gs, hs = g[rows].sum() / B.ONE, h[rows].sum() / B.ONE
        tree.rows[k], tree.value[k] = len(rows), -gs / (hs + model.penalty) if len(rows) else 0.0
        if depth == 0 or len(rows) < 2:
            return
        best = None
        for f in sorted(B._columns(model, bins.shape[1], number, k)):
            for cut in range(255):
                left = bins[rows, f] <= cut
                a, b = g[rows][left].sum() / B.ONE, h[rows][left].sum() / B.ONE
                if not 0 < left.sum() < len(rows) or b < model.min_child or hs - b < model.min_child:
                    continue
                gain = 0.5 * (a**2 / (b + model.penalty) + (gs - a) ** 2 / (hs - b + model.penalty) - gs**2 / (hs + model.penalty)) - model.gamma
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, f, cut
        if best is None:
            return
        tree.gain[k], tree.feature[k], tree.cut[k] = best
        left = bins[rows, best[1]] <= best[2]
        grow(2 * k + 1, rows[left], depth - 1)
        grow(2 * k + 2, rows[~left], depth - 1)

    grow(0, own, model.depth)
    return tree


@pytest.mark.parametrize(("sub", "col"), [(1.0, 1.0), (0.7, 0.67)])
def test_trees_equal_greedy_trees_on_the_same_bins(spark, sub, col):
    df, _ = table(spark)
    model = GBT(n_trees=4, depth=3, subsample=sub, colsample=col, seed=5)
    features = ["a", "b", "c"]
    got, trees, losses = B.fit(df, features, "y", "id", model, bins=32, block=2)
    edges = B.edges_of(df, features, 32)
    rows = B.binned(df, features, "y", "id", edges, model.start).collect()
    bins = np.array([list(r["bins"]) for r in rows], dtype=np.uint8)
    u, y = np.array([r["u"] for r in rows]), np.array([r["y"] for r in rows])
    before = []
    for number, tree in enumerate(trees):
        want = greedy(bins, u, y, model, number, model.start, before)
        for name in ("feature", "cut", "rows"):
            assert getattr(tree, name).tolist() == getattr(want, name).tolist()
        assert np.allclose(tree.value, want.value) and np.allclose(tree.gain, want.gain)
        before.append(tree)
        raw = B._margins(np.full(len(y), model.start), bins, before, model.lr)
        p = np.clip(sigmoid(raw), 1e-7, 1 - 1e-7)
        assert math.isclose(losses[number], float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()), rel_tol=1e-6)
    assert losses[-1] < losses[0]


def test_model_scores_as_its_bins_do_and_rows_may_be_dealt_otherwise(spark):
    df, rows = table(spark, 800)
    features = ["a", "b", "c"]
    make = lambda: GBT(n_trees=3, depth=2, subsample=1.0, colsample=1.0)
    model, trees, _ = B.fit(df, features, "y", "id", make(), bins=16)
    again, _, _ = B.fit(df.repartition(2, "a"), features, "y", "id", make(), bins=16)
    assert again.trees == model.trees
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows])
    edges = B.edges_of(df, features, 16)
    bins = np.stack([np.searchsorted(e, np.where(np.isnan(x[:, k]), np.inf, x[:, k]), side="right") for k, e in enumerate(edges)], axis=1)
    assert np.allclose(model.predict_proba(x), sigmoid(B._margins(np.full(len(x), model.start), bins, trees, model.lr)))
    known = np.array([r[4] is not None for r in rows])
    hit = model.predict(x[known]) == np.array([r[4] for r in rows if r[4] is not None])
    assert hit.mean() > 0.75


def test_small_tables(spark):
    df, _ = table(spark, 50)
    for rows in (df.limit(0), df.filter("y = 1"), df.filter("y IS NULL"), df.limit(1)):
        model, trees, _ = B.fit(rows, ["a", "b", "c"], "y", "id", GBT(n_trees=1, depth=2))
        assert all(t.nodes() == [0] for t in trees) and len(model.trees) == 1
    with pytest.raises(ValueError, match="byte"):
        B.fit(df, ["a"], "y", "id", bins=300)
