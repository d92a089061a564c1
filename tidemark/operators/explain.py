"""Attributions by kernel-weighted regression over feature coalitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import kernel_weights


#: Numbers that the masked rows of one call of the model hold at most.
_AT_ONCE = 1 << 22


def _uniform(keys: np.ndarray, seed: int, first: int, n: int) -> np.ndarray:
    """n draws from [0, 1) for each key, from counters: the same for the same key, seed and counter."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1B54A32D192ED03) % 2**64)
        for _ in range(2):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
            if x.shape[1] == 1:
                x = x + np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(11)).astype(np.float64) / 2**53


class KernelExplainer:
    """Attributions of a batch of rows by one call of the model for all their coalitions. Where the budget holds all proper coalitions each
    is taken, as often as it goes into the budget; else pairs of a drawn one and its complement."""

    def __init__(self, predict: Callable[[np.ndarray], np.ndarray], background: np.ndarray, coalitions: int = 512, seed: int = 42):
        self.predict, self.background, self.m, self.seed = predict, np.asarray(background, dtype=np.float64), coalitions, seed
        self.baseline, self.d = float(np.mean(predict(self.background))), self.background.shape[1]
        self.weights = np.array(kernel_weights(self.d))
        proper = 2**self.d - 2 if self.d < 40 else self.m + 1
        self.all = None
        if 0 < proper <= self.m:
            masks = np.arange(1, proper + 1)
            self.all = np.tile((masks[:, None] >> np.arange(self.d)) & 1, (self.m // proper, 1)).astype(np.float64)

    def coalitions(self, keys: np.ndarray) -> np.ndarray:
        """For each key its coalitions as rows of zeros and ones."""
        if self.all is not None:
            return np.broadcast_to(self.all, (len(keys), *self.all.shape))
        half = -(-self.m // 2)
        u = _uniform(keys, self.seed, 0, half * (self.d + 1)).reshape(len(keys), half, self.d + 1)
        sizes = 1 + np.floor(u[:, :, 0] * (max(2, self.d) - 1)).astype(np.int64)
        z = u[:, :, 1:].argsort(axis=2).argsort(axis=2) < sizes[:, :, None]
        return np.concatenate([z, ~z], axis=1)[:, : self.m].astype(np.float64)

    def batch(self, x: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Predictions of the rows and their values, which add up to prediction less baseline."""
        prediction, values = np.asarray(self.predict(x), dtype=np.float64), np.zeros(x.shape)
        size = max(1, _AT_ONCE // (self.m * self.d))
        for at in range(0, len(x), size):
            part, own = x[at : at + size], keys[at : at + size]
            z = self.coalitions(own)
            n, m = z.shape[:2]
            chosen = (_uniform(own, self.seed + 1, 0, m) * len(self.background)).astype(np.int64)
            masked = np.where(z > 0, part[:, None, :], self.background[chosen])
            target = np.asarray(self.predict(masked.reshape(n * m, self.d)), dtype=np.float64).reshape(n, m) - self.baseline
            values[at : at + size] = wls(z, target, self.weights[z.sum(axis=2).astype(int)], prediction[at : at + size] - self.baseline)
        return prediction, values

    def explain(self, x: np.ndarray, key: int = 0) -> dict:
        """baseline, prediction and values of one row."""
        prediction, values = self.batch(np.asarray(x, dtype=np.float64)[None, :], np.array([key]))
        return {"baseline": self.baseline, "prediction": float(prediction[0]), "values": values[0]}


def wls(z: np.ndarray, y: np.ndarray, w: np.ndarray, total: np.ndarray | None = None, ridge: float = 1e-9) -> np.ndarray:
    """Weighted least squares in closed form, a problem for each first index; weights are scaled to a mean of one. With totals, the best of
    the solutions that add up to them: rescaling to them would blow up or wipe out values that cancel out."""
    w = w / np.maximum(w.mean(axis=-1, keepdims=True), 1e-300)
    zw = np.swapaxes(z * w[..., None], -1, -2)
    a, b = zw @ z + ridge * np.eye(z.shape[-1]), zw @ y[..., None]
    if total is None:
        return np.linalg.solve(a, b)[..., 0]
    phi, step = np.moveaxis(np.linalg.solve(a, np.concatenate([b, np.ones_like(b)], axis=-1)), -1, 0)
    return phi + step * ((total - phi.sum(axis=-1)) / step.sum(axis=-1))[..., None]


def explain(df: DataFrame, explainer: KernelExplainer, features: list[str], key: str = "event_id", vector: str = "vector", keep: tuple[str, ...] = (), top: int | None = None) -> DataFrame:
    """key, baseline, prediction, feature, value and the row's columns to keep: one row per feature; prediction and value are null for a null
    vector. Rows are explained where they are, an Arrow batch at once, seeded by their key; keys may repeat or be null. The
    explainer travels with the function, so its predict may be any callable. With top, only so many features of a row go out, with
    their place, in the order of top_features: nothing is shuffled for them."""
    rows = df.select(F.col(key).cast("bigint"), F.col(vector).cast("array<double>").alias("_vector"), *keep)
    d = len(features)
    names = np.array(list(features), dtype=object)
    rank = np.argsort(np.array(sorted(range(d), key=lambda k: features[k].encode())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            prediction, values = np.full(len(b), np.nan), np.full((len(b), d), np.nan)
            if known.any():
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                keys = b.column(0).fill_null(0).to_numpy()[known]
                prediction[known], values[known] = explainer.batch(x, keys)
            if top is None:
                chosen = np.tile(np.arange(d), (len(b), 1))
            else:  # largest first, NaN before all, ties by name
                size, nan = np.abs(values), np.isnan(values)
                chosen = np.lexsort((np.broadcast_to(rank, size.shape), np.where(nan, 0.0, -size), ~nan), axis=-1)[:, :top]
            n = chosen.shape[1]
            each = b.take(pa.array(np.repeat(np.arange(len(b)), n)))
            gone = np.repeat(~known, n)
            new = {
                "baseline": pa.array(np.full(len(b) * n, explainer.baseline)),
                "prediction": pa.array(np.repeat(prediction, n), mask=gone),
                "feature": pa.array(names[chosen.ravel()], pa.string()),
                "value": pa.array(np.take_along_axis(values, chosen, axis=1).ravel(), mask=gone),
            } | ({} if top is None else {"place": pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(b)))})
            yield pa.RecordBatch.from_arrays([each.column(0), *new.values(), *each.columns[2:]], [key, *new, *keep])

    schema = T.StructType([rows.schema[0], *T.StructType.fromDDL("baseline double, prediction double, feature string, value double" + ("" if top is None else ", place int")), *rows.schema[2:]])
    return rows.mapInArrow(run, schema)


def top_features(values: DataFrame, key: str = "event_id", k: int = 5) -> DataFrame:
    """The k features of largest absolute value for each row."""
    w = Window.partitionBy(key).orderBy(F.abs("value").desc(), "feature")
    return values.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def mean_magnitude(values: DataFrame, k: int = 10) -> DataFrame:
    """The k features whose values are largest on average over all rows: feature, mean_magnitude."""
    return values.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_magnitude")).orderBy(F.desc("mean_magnitude"), "feature").limit(k)


def text(values: DataFrame, key: str = "event_id", k: int = 4) -> DataFrame:
    """A sentence for each row: the score, the base rate and the top features with signs."""
    top = top_features(values, key, k)
    one = F.format_string("%s %+.3f", F.col("feature"), F.col("value"))
    parts = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", one.alias("t")))).alias("l"), F.first("prediction").alias("prediction"), F.first("baseline").alias("baseline"))
    return parts.select(key, F.format_string("score %.3f (base %.3f): %s", F.col("prediction"), F.col("baseline"), F.array_join(F.transform("l", lambda x: x["t"]), ", ")).alias("explanation"))
