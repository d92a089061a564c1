import copy

import numpy as np
import pytest

from tidemark.operators import network as N
from tidemark.operators.models import MLP


def table(spark, n=700, d=4, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    y = (x[:, 0] * x[:, 1] + 0.3 * r.normal(size=n) > 0).astype(int)
    return spark.createDataFrame([(k, x[k].tolist(), int(y[k])) for k in range(n)], "id bigint, v array<double>, y int").repartition(5), x, y


def grads(model):
    return [g for layer in model.layers for g in layer.grads.values()]


@pytest.mark.parametrize("hidden", [(), (6,), (7, 5, 3)])
def test_a_step_has_the_gradient_of_the_whole_table(spark, hidden):
    df, x, y = table(spark)
    model = MLP(4, hidden, dropout=0.0, seed=2)
    alone = copy.deepcopy(model)
    loss = N.gradient(N.prepared(df, "v", "y", "id"), model)
    value, d = alone.loss(alone.forward(x, True), y)
    d = d[:, None]
    for layer in reversed(alone.layers):
        d = layer.backward(d)
    assert loss == pytest.approx(value, abs=1e-12)
    for a, b in zip(model.layers, alone.layers, strict=True):
        assert set(a.grads) == set(b.grads)
        for name in a.grads:
            assert np.allclose(a.grads[name], b.grads[name], rtol=0, atol=1e-9)
        assert np.allclose(a.mean, b.mean, atol=1e-12) and np.allclose(a.var, b.var, atol=1e-9)


def test_dropped_units_and_drawn_rows_do_not_depend_on_partitions(spark):
    df, _, _ = table(spark)
    first, second = MLP(4, (8, 4), dropout=0.4, seed=3), MLP(4, (8, 4), dropout=0.4, seed=3)
    a = N.gradient(N.prepared(df, "v", "y", "id"), first, step=2, share=0.5)
    b = N.gradient(N.prepared(df.repartition(2), "v", "y", "id"), second, step=2, share=0.5)
    assert a == pytest.approx(b, abs=1e-12)
    assert all(np.allclose(p, q, atol=1e-10) for p, q in zip(grads(first), grads(second), strict=True))
    other = MLP(4, (8, 4), dropout=0.4, seed=3)
    assert N.gradient(N.prepared(df, "v", "y", "id"), other, step=3, share=0.5) != a


def test_training_learns_and_missing_rows_are_left_out(spark):
    df, x, y = table(spark, 900)
    model = MLP(4, (16,), dropout=0.0, lr=0.05, seed=1)
    losses = N.fit(df.unionByName(spark.createDataFrame([(9000, None, 1), (9001, [0.0] * 4, None)], df.schema)), "v", "y", "id", model, 25)
    assert losses[-1] < 0.6 * losses[0] and (model.predict(x) == y).mean() > 0.7
    before = copy.deepcopy(model)
    assert N.fit(df.limit(0), "v", "y", "id", model, 1) == [0.0]
    assert np.array_equal(model.predict_proba(x), before.predict_proba(x))
