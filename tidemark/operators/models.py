"""The two models, in NumPy on bounded training matrices, and distributed scoring."""

from __future__ import annotations

import json
import os
import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -500, 500)
    return np.where(x >= 0, 1 / (1 + np.exp(-np.abs(x))), np.exp(-np.abs(x)) / (1 + np.exp(-np.abs(x))))


class FocalLoss:
    """Mean focal loss of logits, and its gradient."""

    def __init__(self, gamma: float = 2.0, alpha: float = 0.25):
        self.gamma, self.alpha = gamma, alpha

    def __call__(self, logits: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
        p = np.clip(sigmoid(logits), 1e-7, 1 - 1e-7)
        right, weight, sign = np.where(labels == 1, p, 1 - p), np.where(labels == 1, self.alpha, 1 - self.alpha), np.where(labels == 1, 1.0, -1.0)
        loss = -weight * (1 - right) ** self.gamma * np.log(right)
        slope = weight * sign * (1 - right) ** self.gamma * (self.gamma * right * np.log(right) - (1 - right))
        return float(loss.mean()), slope / len(labels)


def bce(logits: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
    p = np.clip(sigmoid(logits), 1e-7, 1 - 1e-7)
    return float(-(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()), (p - labels) / len(labels)


class Layer:
    """Linear, batch normalisation, ReLU and inverted dropout as one layer; the last layer is linear alone."""

    def __init__(self, n_in: int, n_out: int, last: bool, dropout: float, rng: np.random.Generator):
        self.last, self.dropout, self.rng = last, dropout, rng
        self.params = {"w": rng.normal(0, np.sqrt(2 / n_in), (n_in, n_out)), "b": np.zeros(n_out)}
        if not last:
            self.params |= {"scale": np.ones(n_out), "shift": np.zeros(n_out)}
        self.mean, self.var, self.grads, self.kept = np.zeros(n_out), np.ones(n_out), {}, None

    def forward(self, x: np.ndarray, training: bool) -> np.ndarray:
        p, self.x = self.params, x
        z = x @ p["w"] + p["b"]
        if self.last:
            return z
        mean, var = (z.mean(axis=0), z.var(axis=0)) if training else (self.mean, self.var)
        if training:
            self.mean, self.var = 0.9 * self.mean + 0.1 * mean, 0.9 * self.var + 0.1 * var
        self.root = np.sqrt(var + 1e-5)
        self.norm = (z - mean) / self.root
        self.act = p["scale"] * self.norm + p["shift"]
        out = np.maximum(0, self.act)
        if training and self.dropout:
            self.kept = (self.rng.random(out.shape) >= self.dropout) / (1 - self.dropout)
            out = out * self.kept
        else:
            self.kept = None
        return out

    def backward(self, d: np.ndarray) -> np.ndarray:
        p, g = self.params, {}
        if not self.last:
            if self.kept is not None:
                d = d * self.kept
            d = d * (self.act > 0)
            g["scale"], g["shift"] = (d * self.norm).sum(axis=0), d.sum(axis=0)
            n = d * p["scale"]
            d = (n - n.mean(axis=0) - self.norm * (n * self.norm).mean(axis=0)) / self.root
        g["w"], g["b"] = self.x.T @ d, d.sum(axis=0)
        self.grads = g
        return d @ p["w"].T


class Adam:
    def __init__(self, lr: float = 1e-3, decay: float = 1e-4):
        self.lr, self.decay, self.t, self.m, self.v = lr, decay, 0, {}, {}

    def step(self, layers: list[Layer]) -> None:
        self.t += 1
        for k, layer in enumerate(layers):
            for name, value in layer.params.items():
                g = layer.grads[name] + (self.decay * value if name == "w" else 0)
                key = (k, name)
                self.m[key] = 0.9 * self.m.get(key, 0) + 0.1 * g
                self.v[key] = 0.999 * self.v.get(key, 0) + 0.001 * g * g
                value -= self.lr * (self.m[key] / (1 - 0.9**self.t)) / (np.sqrt(self.v[key] / (1 - 0.999**self.t)) + 1e-8)


class MLP:
    """Hidden layers with batch normalisation and dropout, focal loss, Adam."""

    def __init__(self, d: int, hidden: tuple[int, ...] = (128, 64, 32), dropout: float = 0.3, lr: float = 1e-3, gamma: float = 2.0, alpha: float = 0.25, seed: int = 42):
        self.rng = np.random.default_rng(seed)
        sizes = [d, *hidden, 1]
        self.config = {"d": d, "hidden": tuple(hidden), "dropout": dropout, "lr": lr, "gamma": gamma, "alpha": alpha, "seed": seed}
        self.layers = [Layer(a, b, k == len(sizes) - 2, dropout, self.rng) for k, (a, b) in enumerate(zip(sizes[:-1], sizes[1:], strict=True))]
        self.loss, self.optimizer = FocalLoss(gamma, alpha), Adam(lr)

    def forward(self, x: np.ndarray, training: bool = False) -> np.ndarray:
        for layer in self.layers:
            x = layer.forward(x, training)
        return x[:, 0]

    def train_step(self, x: np.ndarray, y: np.ndarray) -> float:
        value, d = self.loss(self.forward(x, True), y)
        d = d[:, None]
        for layer in reversed(self.layers):
            d = layer.backward(d)
        self.optimizer.step(self.layers)
        return value

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch_size: int = 256) -> list[float]:
        out = []
        for _ in range(epochs):
            order, losses = self.rng.permutation(len(x)), []
            for at in range(0, len(x), batch_size):
                part = order[at : at + batch_size]
                if len(part) > 1:
                    losses.append(self.train_step(x[part], y[part]))
            out.append(float(np.mean(losses)) if losses else 0.0)
        return out

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward(np.asarray(x, dtype=np.float64)))

    def predict(self, x: np.ndarray, threshold: float = 0.5) -> np.ndarray:
        return (self.predict_proba(x) >= threshold).astype(int)

    def save(self, path: str) -> None:
        arrays = {f"{k}.{n}": v for k, layer in enumerate(self.layers) for n, v in (layer.params | {"mean": layer.mean, "var": layer.var}).items()}
        np.savez(path, config=np.array(repr(self.config)), **arrays)

    @classmethod
    def load(cls, path: str) -> MLP:
        import ast

        data = np.load(path, allow_pickle=False)
        model = cls(**ast.literal_eval(str(data["config"])))
        for k, layer in enumerate(model.layers):
            layer.params = {n: data[f"{k}.{n}"] for n in layer.params}
            layer.mean, layer.var = data[f"{k}.mean"], data[f"{k}.var"]
        return model


class GBT:
    """Second-order boosted trees; each node's split is the best of a random share of features."""

    def __init__(self, n_trees: int = 100, lr: float = 0.1, depth: int = 4, subsample: float = 0.8, penalty: float = 1.0, min_child: float = 1.0, colsample: float = 0.8, gamma: float = 0.0, seed: int = 42):
        self.n_trees, self.lr, self.depth, self.subsample, self.penalty, self.min_child, self.colsample, self.gamma = n_trees, lr, depth, subsample, penalty, min_child, colsample, gamma
        self.rng, self.rng_seed, self.trees, self.start, self.d = np.random.default_rng(seed), seed, [], 0.0, 0

    def _best(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float] | None:
        best, total_g, total_h = None, g.sum(), h.sum()
        for f in self.rng.choice(x.shape[1], max(1, int(self.colsample * x.shape[1])), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, gs, hs = x[order, f], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
            fine = (v[1:] > v[:-1]) & (hs >= self.min_child) & (total_h - hs >= self.min_child)
            if not fine.any():
                continue
            gain = 0.5 * (gs**2 / (hs + self.penalty) + (total_g - gs) ** 2 / (total_h - hs + self.penalty) - total_g**2 / (total_h + self.penalty)) - self.gamma
            gain[~fine] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > 0 and (best is None or gain[k] > best[0]):
                best = float(gain[k]), int(f), float((v[k] + v[k + 1]) / 2)
        return best

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> dict:
        leaf = {"value": float(-g.sum() / (h.sum() + self.penalty))}
        split = self._best(x, g, h) if depth and len(x) > 1 else None
        if split is None:
            return leaf
        left = x[:, split[1]] <= split[2]
        return {"feature": split[1], "threshold": split[2], "left": self._grow(x[left], g[left], h[left], depth - 1), "right": self._grow(x[~left], g[~left], h[~left], depth - 1)}

    @staticmethod
    def _apply(node: dict, x: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
        if "value" in node:
            out[rows] = node["value"]
            return
        left = x[rows, node["feature"]] <= node["threshold"]
        GBT._apply(node["left"], x, out, rows[left])
        GBT._apply(node["right"], x, out, rows[~left])

    def fit(self, x: np.ndarray, y: np.ndarray) -> list[float]:
        x, y, self.d = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64), x.shape[1]
        p = np.clip(y.mean(), 1e-7, 1 - 1e-7)
        self.start, self.trees, losses = float(np.log(p / (1 - p))), [], []
        raw = np.full(len(x), self.start)
        for _ in range(self.n_trees):
            p = sigmoid(raw)
            rows = self.rng.random(len(x)) < self.subsample
            rows = rows if rows.any() else ~rows
            self.trees.append(self._grow(x[rows], (p - y)[rows], (p * (1 - p))[rows], self.depth))
            step = np.zeros(len(x))
            self._apply(self.trees[-1], x, step, np.arange(len(x)))
            raw += self.lr * step
            q = np.clip(sigmoid(raw), 1e-7, 1 - 1e-7)
            losses.append(float(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()))
        return losses

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=np.float64)
        raw = np.full(len(x), self.start)
        for tree in self.trees:
            step = np.zeros(len(x))
            self._apply(tree, x, step, np.arange(len(x)))
            raw += self.lr * step
        return sigmoid(raw)

    def predict(self, x: np.ndarray, threshold: float = 0.5) -> np.ndarray:
        return (self.predict_proba(x) >= threshold).astype(int)

    def feature_importance(self) -> np.ndarray:
        """Share of splits by feature."""
        counts, todo = np.zeros(self.d), list(self.trees)
        while todo:
            node = todo.pop()
            if "feature" in node:
                counts[node["feature"]] += 1
                todo += [node["left"], node["right"]]
        return counts / counts.sum() if counts.sum() else counts

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump({"lr": self.lr, "start": self.start, "d": self.d, "trees": self.trees}, f)

    @classmethod
    def load(cls, path: str) -> GBT:
        with open(path) as f:
            held = json.load(f)
        model = cls(len(held["trees"]), held["lr"])
        model.start, model.trees, model.d = held["start"], held["trees"], held["d"]
        return model

    def column(self, features: list[str]) -> Column:
        """The probability as nested conditions: JVM code, no Python."""
        raw = F.lit(self.start)
        for tree in self.trees:
            raw = raw + self.lr * tree_column(tree, features)
        return F.when(raw >= 0, 1 / (1 + F.exp(-raw))).otherwise(F.exp(raw) / (1 + F.exp(raw)))


def tree_column(node: dict, features: list[str]) -> Column:
    if "value" in node:
        return F.lit(float(node["value"]))
    return F.when(F.col(features[node["feature"]]) <= node["threshold"], tree_column(node["left"], features)).otherwise(tree_column(node["right"], features))


class Ensemble:
    """Weighted mean of the models at hand; 0.5 for one row and 0 in a batch if there is none."""

    def __init__(self, mlp: MLP | None = None, gbt: GBT | None = None, weights: tuple[float, float] = (0.4, 0.6)):
        self.mlp, self.gbt, self.weights, self.mean, self.std = mlp, gbt, weights, None, None

    def fit_normalizer(self, x: np.ndarray) -> None:
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-8

    def normalize(self, x: np.ndarray) -> np.ndarray:
        return x if self.mean is None else (x - self.mean) / self.std

    def score_batch(self, x: np.ndarray, none: float = 0.0) -> np.ndarray:
        parts = [(w, m.predict_proba(self.normalize(x) if m is self.mlp else x)) for w, m in zip(self.weights, (self.mlp, self.gbt), strict=True) if m is not None]
        return sum(w * p for w, p in parts) / sum(w for w, _ in parts) if parts else np.full(len(x), none)

    def save(self, folder: str) -> None:
        """The parts at hand, the weights and the normaliser, a file each."""
        os.makedirs(folder, exist_ok=True)
        if self.mlp is not None:
            self.mlp.save(os.path.join(folder, "mlp.npz"))
        if self.gbt is not None:
            self.gbt.save(os.path.join(folder, "gbt.json"))
        with open(os.path.join(folder, "ensemble.json"), "w") as f:
            json.dump({"weights": self.weights, "mean": None if self.mean is None else self.mean.tolist(), "std": None if self.std is None else self.std.tolist()}, f)

    @classmethod
    def load(cls, folder: str) -> Ensemble:
        part = lambda name: os.path.join(folder, name)
        with open(part("ensemble.json")) as f:
            held = json.load(f)
        model = cls(MLP.load(part("mlp.npz")) if os.path.exists(part("mlp.npz")) else None, GBT.load(part("gbt.json")) if os.path.exists(part("gbt.json")) else None, tuple(held["weights"]))
        if held["mean"] is not None:
            model.mean, model.std = np.array(held["mean"]), np.array(held["std"])
        return model

    def score(self, vector: np.ndarray) -> float:
        return round(float(self.score_batch(np.asarray(vector)[None, :], 0.5)[0]), 4)


def score(df: DataFrame, model, vector: str = "vector", name: str = "ml_score") -> DataFrame:
    """Adds the model's score of each vector, null for a null one; the model is broadcast, of the size of its weights."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(vectors: pd.Series) -> pd.Series:
        m, out = shared.value, pd.Series(np.nan, index=vectors.index, dtype="float64").astype(object)
        there = vectors.notna()
        if there.any():
            x = np.stack(vectors[there].to_list()).astype(np.float64)
            out[there] = m.score_batch(x) if hasattr(m, "score_batch") else m.predict_proba(x)
        return out.where(there, None).astype("Float64")

    return df.withColumn(name, run(F.col(vector)))


class ReplayBuffer:
    """A reservoir of labelled vectors."""

    def __init__(self, capacity: int = 10_000, seed: int = 42):
        self.capacity, self.rng, self.seen, self.rows = capacity, np.random.default_rng(seed), 0, []

    def add(self, x: np.ndarray, label: int) -> None:
        self.seen += 1
        if len(self.rows) < self.capacity:
            self.rows.append((x, label))
        elif (k := int(self.rng.integers(self.seen))) < self.capacity:
            self.rows[k] = (x, label)

    def sample(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        chosen = self.rng.choice(len(self.rows), min(n, len(self.rows)), replace=False)
        return np.stack([self.rows[k][0] for k in chosen]), np.array([self.rows[k][1] for k in chosen])

    @property
    def size(self) -> int:
        return len(self.rows)

    @property
    def fraud_rate(self) -> float:
        return float(np.mean([y for _, y in self.rows])) if self.rows else 0.0


class OnlineLearner:
    """A training step every so many labels, once the buffer holds a training batch; five times the rate when the last 50 labels' losses exceed the slow average of training losses by 5 %."""

    def __init__(self, model: MLP, every: int = 100, batch: int = 64, capacity: int = 10_000, lr: float = 1e-4, threshold: float = 0.05, seed: int = 42):
        self.model, self.every, self.batch, self.lr, self.threshold = model, every, batch, lr, threshold
        self.buffer, self.losses, self.baseline, self.updates, self.bursts = ReplayBuffer(capacity, seed), [], None, 0, 0

    def update(self, x: np.ndarray, label: int) -> float | None:
        x = np.asarray(x, dtype=np.float64)
        self.buffer.add(x, label)
        self.losses.append(self.model.loss(self.model.forward(x[None, :]), np.array([label]))[0])
        del self.losses[:-500]
        if self.buffer.seen % self.every or self.buffer.size < self.batch:
            return None
        drifting = self.baseline is not None and len(self.losses) >= 50 and float(np.mean(self.losses[-50:])) > self.baseline * (1 + self.threshold)
        self.model.optimizer.lr = self.lr * (5 if drifting else 1)
        self.bursts += drifting
        loss = self.model.train_step(*self.buffer.sample(self.batch))
        self.baseline = loss if self.baseline is None else 0.99 * self.baseline + 0.01 * loss
        self.updates += 1
        return loss
