"""The network trained on a whole table: each step's gradient is that of all its rows, summed where they are.

The model travels with the tasks. Batch normalisation needs every layer's moments over the step's rows before the next layer can run, and the
gradient through it two more sums, so a step with h hidden layers is h passes forward and h + 1 back over the stored rows; a
pass runs the model as far as it is known and returns sums, as many as the layer has numbers, which Spark adds up. The driver
holds the parameters and those sums, no row.

Cases. Rows without a label or vector are left out; without rows nothing is learnt and the loss is 0. Which rows a step takes and what
dropout drops follow from the key's hash, so they are the same in every pass and however rows are dealt out; equal keys go together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, stored
from .boosting import drawn
from .explain import _uniform
from .models import MLP

_SUMS = pa.schema([("k", pa.int32()), ("v", pa.float64())])


class _Pass:
    """The model on some rows as far as moments (of the first layers) and slopes (sums of the last layers' normalisation) are known."""

    def __init__(self, model: MLP, step: int, total: int, moments: list, slopes: dict):
        self.model, self.step, self.total, self.moments, self.slopes = model, step, total, moments, slopes

    def _kept(self, keys: np.ndarray, layer: int, width: int) -> np.ndarray | None:
        drop = self.model.layers[layer].dropout
        if not drop:
            return None
        return (_uniform(keys, 1_000_003 * self.step + layer, 0, width) >= drop) / (1 - drop)

    def sums(self, x: np.ndarray, y: np.ndarray, keys: np.ndarray) -> np.ndarray:
        layers, seen = self.model.layers, []
        for k, layer in enumerate(layers):
            p, z = layer.params, x @ layer.params["w"] + layer.params["b"]
            if layer.last:
                seen.append((x, None, None, None, None))
                break
            if k == len(self.moments):  # as far as is known: sums for this layer's moments, about its running mean
                return np.concatenate([[len(x)], (z - layer.mean).sum(axis=0), ((z - layer.mean) ** 2).sum(axis=0)])
            mean, var = self.moments[k]
            root = np.sqrt(var + 1e-5)
            norm = (z - mean) / root
            act, kept = p["scale"] * norm + p["shift"], self._kept(keys, k, z.shape[1])
            seen.append((x, norm, act, kept, root))
            x = np.maximum(0, act) if kept is None else np.maximum(0, act) * kept
        loss, d = self.model.loss(z[:, 0], y)
        d = d[:, None] * len(y) / self.total
        for k in range(len(layers) - 1, -1, -1):
            layer, (x, norm, act, kept, root) = layers[k], seen[k]
            if not layer.last:
                d = d * (act > 0) if kept is None else d * kept * (act > 0)
                if k not in self.slopes:  # what the normalisation's gradient needs of all rows
                    own = [(d * norm).sum(axis=0), d.sum(axis=0)]
                    return np.concatenate([[loss * len(y)], above, *own])
                scale, shift = self.slopes[k]
                n = d * layer.params["scale"]
                d = (n - layer.params["scale"] * shift / self.total - norm * layer.params["scale"] * scale / self.total) / root
            above = np.concatenate([(x.T @ d).ravel(), d.sum(axis=0)])
            d = d @ layer.params["w"].T
        return np.concatenate([[loss * len(y)], above])


def _summed(rows: DataFrame, walk: _Pass, share: float, seed: int) -> np.ndarray:
    d = walk.model.config["d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            keys = b.column(0).to_numpy()
            own = np.flatnonzero(drawn(keys, walk.step, seed, share))
            if len(own):
                x = b.column(1).flatten().to_numpy().reshape(-1, d)[own]
                got = walk.sums(x, b.column(2).to_numpy()[own], keys[own])
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], schema=_SUMS)

    got = rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(got))
    for r in got:
        out[r["k"]] = r["v"]
    return out


def prepared(rows: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """u (a hash of the key), x, y of the rows with both, written once for all passes."""
    known = rows.filter(F.col(vector).isNotNull() & F.col(label).isNotNull())
    return stored(known.select(F.xxhash64(key).alias("u"), F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y")), "network-rows")


def gradient(table: DataFrame, model: MLP, step: int = 0, share: float = 1.0, seed: int = 42) -> float | None:
    """Puts the gradient over the step's rows into the layers, moves their running moments on, and returns the mean loss; None without rows."""
    layers, hidden = model.layers, len(model.layers) - 1
    moments, slopes, total = [], {}, 0
    for k in range(hidden):
        got = _summed(table, _Pass(model, step, 1, moments, slopes), share, seed)
        if not len(got):
            return None
        total, width = int(got[0]), len(layers[k].mean)
        apart = got[1 : 1 + width] / total
        moments.append((layers[k].mean + apart, got[1 + width :] / total - apart**2))
    if not hidden:
        own = table.filter(F.lit(True)).select("u").mapInPandas(lambda bs: ((b[drawn(b["u"].to_numpy(), step, seed, share)]) for b in bs), "u bigint")
        total = own.count()
        if not total:
            return None
    loss = 0.0
    for k in range(hidden, -1, -1):
        got = _summed(table, _Pass(model, step, total, moments, slopes), share, seed)
        loss, got = got[0] / total, got[1:]
        n_in, n_out = layers[k].params["w"].shape
        layers[k].grads = {"w": got[: n_in * n_out].reshape(n_in, n_out), "b": got[n_in * n_out : (n_in + 1) * n_out]} | ({"scale": slopes[k][0], "shift": slopes[k][1]} if k in slopes else {})
        if k:
            width = len(layers[k - 1].mean)
            slopes[k - 1] = got[-2 * width : -width], got[-width:]
    for layer, (mean, var) in zip(layers, moments, strict=False):
        layer.mean, layer.var = 0.9 * layer.mean + 0.1 * mean, 0.9 * layer.var + 0.1 * var
    return float(loss)


def fit(rows: DataFrame, vector: str, label: str, key: str, model: MLP, steps: int = 10, share: float = 1.0, seed: int = 42) -> list[float]:
    """Trains the model in place, a step for all rows or for the share that the step draws; the mean loss before each."""
    table, losses = prepared(rows, vector, label, key), []
    for step in range(steps):
        loss = gradient(table, model, step, share, seed)
        losses.append(0.0 if loss is None else loss)
        if loss is not None:
            model.optimizer.step(model.layers)
    forget(table)
    return losses
