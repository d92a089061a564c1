"""Rolling windows over a stream in event time: state in small buckets of time, timers that drop them, and late rows kept apart.

An entity's rows lie in a map from bucket of time to the rows in it. A batch reads the entity's live buckets once and writes only those
that it adds rows to. An entity has a timer at the time of the watermark from which no window can reach its first bucket any more; then all
such buckets go and a timer is set for the next. Buckets that the watermark after this batch puts out of reach, whatever it brought to
others, are not written at all: that watermark is no earlier than the entity's own last row less the delay. The watermark is known to the
operator but doesn't drop its input: a row behind it goes out as late, touches no state, and can be written to a table of its own. State is
what the longest window and the watermark's delay span, however long the stream runs.

Cases. Rows of one batch and entity are taken in order of time; each sees its peers of the batch and what earlier batches brought, rows that
came out of order but not late included. Rows without an entity or a time are left out; a null amount is 0; null and empty cities and
devices aren't counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import SECOND, _codes, _distinct, _Lifts
from .stateful import use_rocksdb

#: Name and length in seconds of the windows.
DEFAULT = {"1m": 60, "5m": 300, "1h": 3600, "24h": 86_400}
_STATS = ("n", "mean", "std", "max", "cities", "devices")
_TYPES = {"n": "bigint", "mean": "double", "std": "double", "max": "double", "cities": "bigint", "devices": "bigint"}


def output_schema(windows: dict[str, int]) -> str:
    return "event_id bigint, us bigint, late boolean" + "".join(f", {s}_{w} {_TYPES[s]}" for w in windows for s in _STATS)


class EventWindows(StatefulProcessor):
    """See above. bucket_us: the length of a bucket of state; delay_ms: the watermark's delay, None if it isn't known."""

    def __init__(self, windows: dict[str, int], bucket_us: int, delay_ms: int | None = None):
        self.windows, self.bucket_us, self.delay_ms = windows, bucket_us, delay_ms
        self.longest = max(windows.values()) * SECOND
        self.columns = [c.split()[0] for c in output_schema(windows).split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "bucket bigint", "us array<bigint>, amount array<double>, city array<string>, device array<string>")

    def _expires(self, bucket: int) -> int:
        """The watermark in milliseconds from which no row that isn't late can see the bucket."""
        return -(-((bucket + 1) * self.bucket_us + self.longest) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = list(rows)
        new = chunks[0] if len(chunks) == 1 else pd.concat(chunks)
        ids, now = new["event_id"].to_numpy(), new["us"].to_numpy()
        sorted_ = np.lexsort((ids, now))
        late = now[sorted_] < timerValues.getCurrentWatermarkInMs() * 1000
        if late.any():
            gone = sorted_[late]
            yield pd.DataFrame({"event_id": ids[gone], "us": now[gone], "late": True} | {c: None for c in self.columns[3:]}, columns=self.columns)
            sorted_ = sorted_[~late]
        if not len(sorted_):
            return
        held = {k[0]: v for k, v in self.buckets.iterator()}
        parts = [v for _, v in sorted(held.items())]
        fresh = [new[c].to_numpy()[sorted_].tolist() for c in ("us", "amount", "payer_city", "device_id")]
        old = sum(len(p[0]) for p in parts)
        us, amount, city, device = ([x for p in (*parts, fresh) for x in p[c]] for c in range(4)) if parts else fresh
        order = np.argsort(np.array(us, dtype=np.int64), kind="stable")
        t = np.array(us, dtype=np.int64)[order]
        own = np.flatnonzero(order >= old)
        high = np.searchsorted(t, t, side="right") - 1
        lifts = _Lifts(np.array([0.0 if x is None or x != x else x for x in amount])[order])
        codes = [_codes(pa.array([c[k] for k in order], pa.string())) for c in (city, device)]
        out = {"event_id": ids[sorted_], "us": t[own], "late": False}
        for w, seconds in self.windows.items():
            low = np.searchsorted(t, t - seconds * SECOND)
            n = high[own] - low[own] + 1
            got = lifts.over(low[own], high[own], {"sum", "m2", "max"})
            values = (n, got["sum"] / n, np.sqrt(got["m2"] / n), got["max"], *(_distinct(c, low, high)[own] for c in codes))
            out |= {f"{s}_{w}": v for s, v in zip(_STATS, values, strict=True)}
        yield pd.DataFrame(out, columns=self.columns)
        self._write(held, fresh, now[sorted_] // self.bucket_us, None if self.delay_ms is None else int(t[-1]) // 1000 - self.delay_ms)

    def _write(self, held: dict, fresh: list[list], touched: np.ndarray, soon: int | None) -> None:
        """The buckets that got rows. soon: the watermark that the next batch has at least; what it puts out of reach is not kept."""
        gone = set() if soon is None else {b for b in (*held, *touched.tolist()) if self._expires(b) <= soon}
        for bucket in gone & set(held):
            self.buckets.removeKey((bucket,))
        starts = np.flatnonzero(np.r_[True, touched[1:] != touched[:-1]])
        written = []
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(touched)], strict=True):
            bucket = int(touched[at])
            if bucket not in gone:
                before = held.get(bucket)
                add = [[None if isinstance(x, float) and x != x else x for x in c[at:end]] for c in fresh]
                self.buckets.updateValue((bucket,), tuple((list(before[c]) if before is not None else []) + add[c] for c in range(4)))
                written.append(bucket)
        # a key with buckets has a timer no later than the first of them ends
        if written and (not held or min(written) < min(held)):
            self.handle.registerTimer(self._expires(min(written)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = timerValues.getCurrentWatermarkInMs()
        left = []
        for bucket in [k[0] for k in self.buckets.keys()]:
            if self._expires(bucket) <= at:
                self.buckets.removeKey((bucket,))
            else:
                left.append(bucket)
        if left:
            self.handle.registerTimer(self._expires(min(left)))
        return iter(())

    def close(self) -> None:
        pass


def _milliseconds(spark: SparkSession, length: str) -> int | None:
    """Of an interval; None for one of months, which have no fixed length."""
    value = spark.sql(f"SELECT INTERVAL {length} AS length").first()["length"] if "month" not in length.lower() and "year" not in length.lower() else None
    return None if value is None else -(-value // timedelta(milliseconds=1))


def event_windows(txns: DataFrame, delay: str = "10 minutes", windows: dict[str, int] | None = None, bucket_us: int | None = None) -> DataFrame:
    """A stream of (event_id, us, late, statistics by window) of txns(event_id, us, payer_vpa, amount, payer_city, device_id); us counts
    microseconds of event time from 1970. Late rows have no statistics."""
    windows = dict(windows or DEFAULT)
    use_rocksdb(txns.sparkSession)
    rows = txns.filter((F.coalesce(F.col("payer_vpa"), F.lit("")) != "") & F.col("us").isNotNull())
    rows = rows.withColumn("_time", F.timestamp_micros("us")).withWatermark("_time", delay)
    rows = rows.select("event_id", "us", "payer_vpa", F.col("amount").cast("double").alias("amount"), "payer_city", "device_id")
    processor = EventWindows(windows, bucket_us or max(1, max(windows.values()) * SECOND // 48), _milliseconds(txns.sparkSession, delay))
    return rows.groupBy("payer_vpa").transformWithStateInPandas(processor, output_schema(windows), "Append", "EventTime")


def run_apart(query: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Runs the stream over what there is now; rows in time and late ones in tables of their own, each batch under its number, so a batch that
    runs again replaces what it wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.filter("NOT late").drop("late").write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")
        batch.filter("late").select("event_id", "us").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        batch.unpersist()

    q = query.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = query.sparkSession
    out = [f for f in query.schema if f.name != "late"]
    schema = type(query.schema)(out)
    return spark.read.schema(schema).parquet(f"{path}/out/*"), spark.read.schema("event_id bigint, us bigint").parquet(f"{path}/late/*")


def live_state(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """key, bucket, rows: what the operator's state holds, read from the checkpoint of a stream that runs or has stopped."""
    state = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "buckets").load(checkpoint)
    return state.select(F.col("key.payer_vpa").alias("key"), F.col("user_map_key.bucket").alias("bucket"), F.size("user_map_value.us").cast("bigint").alias("rows"))


def live_counters(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """One row: keys, buckets and rows in state."""
    return live_state(spark, checkpoint, operator).agg(F.count_distinct("key").alias("keys"), F.count("*").alias("buckets"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
