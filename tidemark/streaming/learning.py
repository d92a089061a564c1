"""Samples, learners, quantiles and feedback of streams, each safe to replay: a batch that runs again changes nothing.

A reservoir is the k rows of least hash, so those of two parts merge to that of both: partitions merge in a top-k, batches in a table
of k rows under the batch's number. A learner keeps its model, its counters and the last batch's number in one place, written at once:
a batch that it has learnt from is passed over, and a new process goes on with model and sample as they were.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.models import MLP


def random_key(seed: int, *of: str) -> Column:
    """The row's place in a random order that is the same wherever it is computed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in of)))


class Versions:
    """Tables below a path, one a batch. The last whole one is what counts; older ones go when a newer one stands."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        root, fs = self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        made = [n for n in names if n.startswith(f"{self.name}-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix(f"{self.name}-")) for n in made)

    def last(self) -> int:
        return max(self.numbers(), default=-1)

    def read(self, schema) -> DataFrame:
        number = self.last()
        return self.spark.createDataFrame([], schema) if number < 0 else self.spark.read.schema(schema).parquet(f"{self.path}/{self.name}-{number}")

    def write(self, rows: DataFrame, number: int) -> None:
        before = self.numbers()
        rows.write.mode("overwrite").parquet(f"{self.path}/{self.name}-{number}")
        _, fs = self._fs()
        for k in before[:-1]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.name}-{k}"), True)


class Reservoir:
    """foreachBatch: k rows of all so far, each with equal chance; the columns of key tell rows apart."""

    def __init__(self, path: str, k: int, key: list[str], seed: int = 42):
        self.path, self.k, self.key, self.seed = path, k, key, seed

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        kept = Versions(batch.sparkSession, self.path, "sample")
        if batch_id > kept.last():
            rows = kept.read(batch.schema).unionByName(batch)
            kept.write(rows.orderBy(random_key(self.seed, *self.key), *self.key).limit(self.k), batch_id)

    def sample(self, spark: SparkSession, schema) -> DataFrame:
        return Versions(spark, self.path, "sample").read(schema)


class StreamLearner:
    """foreachBatch: an update of the model for every `every` labelled rows so far, on rows drawn from the reservoir; none while it holds fewer
    than a training batch. Five times the rate while the batch's mean loss exceeds the slow average of training losses by the threshold.
    The driver holds the reservoir, of at most k rows; losses of the batch are taken where its rows are."""

    SCHEMA = "model binary, seen bigint, updates bigint, bursts bigint, baseline double"

    def __init__(self, path: str, make: Callable[[], MLP], every: int = 100, size: int = 64, k: int = 10_000, lr: float = 1e-4, threshold: float = 0.05, key: str = "event_id", vector: str = "vector", label: str = "is_fraud", seed: int = 42):
        self.path, self.make, self.every, self.size, self.lr, self.threshold = path, make, every, size, lr, threshold
        self.key, self.vector, self.label, self.seed = key, vector, label, seed
        self.reservoir = Reservoir(f"{path}/reservoir", k, [key], seed)

    def state(self, spark: SparkSession) -> dict:
        row = Versions(spark, self.path, "model").read(self.SCHEMA).first()
        if row is None:
            return {"model": self.make(), "seen": 0, "updates": 0, "bursts": 0, "baseline": None}
        return row.asDict() | {"model": pickle.loads(bytes(row["model"]))}

    def _loss(self, rows: DataFrame, model: MLP) -> tuple[int, float]:
        """How many rows, and their mean loss under the model."""

        def run(batches):
            for b in batches:
                x, y = np.stack(b[self.vector].to_list()).astype(np.float64), b[self.label].to_numpy(dtype=np.float64)
                yield pd.DataFrame({"n": [len(b)], "loss": [model.loss(model.forward(x), y)[0] * len(b)]})

        got = rows.mapInPandas(run, "n bigint, loss double").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss")).first()
        return got["n"] or 0, (got["loss"] or 0.0) / max(1, got["n"] or 0)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = Versions(spark, self.path, "model")
        if batch_id <= kept.last():
            return
        rows = batch.select(self.key, self.vector, self.label).filter(F.col(self.vector).isNotNull() & F.col(self.label).isNotNull())
        self.reservoir(rows, batch_id)
        state = self.state(spark)
        model = state["model"]
        n, loss = self._loss(rows, model)
        steps = (state["seen"] + n) // self.every - state["seen"] // self.every
        held = self.reservoir.sample(spark, rows.schema).orderBy(self.key).collect() if steps else []
        if len(held) >= self.size:
            x, y = np.array([r[self.vector] for r in held], dtype=np.float64), np.array([r[self.label] for r in held], dtype=np.float64)
            drifting = state["baseline"] is not None and loss > state["baseline"] * (1 + self.threshold)
            model.optimizer.lr = self.lr * (5 if drifting else 1)
            for step in range(steps):
                chosen = np.random.default_rng([self.seed, state["updates"]]).choice(len(held), self.size, replace=False)
                value = model.train_step(x[chosen], y[chosen])
                state["baseline"] = value if state["baseline"] is None else 0.99 * state["baseline"] + 0.01 * value
                state["updates"] += 1
                state["bursts"] += int(drifting)
        row = (bytearray(pickle.dumps(model)), state["seen"] + n, state["updates"], state["bursts"], state["baseline"])
        kept.write(spark.createDataFrame([row], self.SCHEMA).coalesce(1), batch_id)


def quantiles(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.99), k: int = 200) -> DataFrame:
    """n and the quantiles of all rows so far, for complete or update mode. The state is one KLL sketch, of a size that k alone bounds; the rank
    of what it gives is off by less than 1.33 % of n in 99 of 100 cases for k = 200."""
    sketch = rows.agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("_s"))
    return sketch.select(F.kll_sketch_get_n_double("_s").alias("n"), *(F.kll_sketch_get_quantile_double("_s", F.lit(p)).alias(f"p{round(100 * p)}") for p in shares))


def decisions_with_feedback(decisions: DataFrame, labels: DataFrame, key: str = "transaction_id", within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """A stream of decisions(key, at, decision) with the labels(key, labelled_at, confirmed) that come within an interval after them;
    decisions that got none go out with null once the watermark has passed the interval. State goes with the watermark. A watermark counts
    whole milliseconds and state ends one of them early, so both go by times cut to milliseconds, while labels are held against the times
    as they are. The interval is one of whole milliseconds."""
    d = decisions.withColumn("_at", F.date_trunc("millisecond", "at")).withWatermark("_at", delay)
    f = labels.select(F.col(key).alias("_key"), "labelled_at", "confirmed", F.date_trunc("millisecond", "labelled_at").alias("_labelled")).withWatermark("_labelled", delay)
    length = F.expr(f"INTERVAL {within}")
    exact = (F.col("labelled_at") >= F.col("at")) & (F.col("labelled_at") <= F.col("at") + length)
    cut = (F.col("_labelled") >= F.col("_at")) & (F.col("_labelled") <= F.col("_at") + length)  # follows from exact; bounds the state
    return d.join(f, (F.col(key) == F.col("_key")) & cut & exact, "leftOuter").drop("_key", "_at", "_labelled")
