"""Stateful streaming operators: per-entity windows, anchored dedup, running sketches, drift windows, model updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sketch import CountMin
from ..operators.windows import LENGTHS, SECOND, _codes, _distinct, _Lifts

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEPT_US = LENGTHS["24h"] * SECOND


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _mode(ttl_ms: int | None) -> str:
    return "None" if ttl_ms is None else "ProcessingTime"


class RollingWindows(StatefulProcessor):
    """State of an entity: its rows of the last 24 hours of its own time. Each row is added first and then reads the windows that
    end at it. With ttl_ms, state of an entity from which nothing comes for so long goes."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    schema = "event_id bigint, user_txn_count_1m bigint, user_txn_count_5m bigint, user_txn_count_1h bigint, user_txn_count_24h bigint, user_amount_mean_1h double, user_amount_std_1h double, user_amount_max_24h double, user_unique_cities_1h bigint, user_unique_devices_24h bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "us bigint, amount double, city string, device string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = list(rows)
        new = chunks[0] if len(chunks) == 1 else pd.concat(chunks)
        ids, now = new["event_id"].to_numpy(), new["us"].to_numpy()
        order = np.lexsort((ids, now))
        ids, now = ids[order], now[order]
        # a row sees the peers of its batch with its own time, and late rows count where their time says
        incoming = [new[c].to_numpy()[order].tolist() for c in ("us", "amount", "payer_city", "device_id")]
        old = [list(c) for c in zip(*self.rows.get(), strict=True)] or [[], [], [], []]
        us, amount, city, device = (a + b for a, b in zip(old, incoming, strict=True))
        us, amount = np.array(us, dtype=np.int64), np.array(amount, dtype=np.float64)
        place = np.argsort(us, kind="stable")
        us, amount = us[place], amount[place]
        city, device = ([c[k] for k in place.tolist()] for c in (city, device))
        high = np.searchsorted(us, us, side="right") - 1
        end = np.searchsorted(us, now, side="right") - 1
        low = {k: np.searchsorted(us, us - LENGTHS[k] * SECOND) for k in ("1h", "24h")}
        start = {k: np.searchsorted(us, now - s * SECOND) for k, s in LENGTHS.items()}
        lifts = _Lifts(np.nan_to_num(amount))
        hour, day = lifts.over(start["1h"], end, {"sum", "m2"}), lifts.over(start["24h"], end, {"max"})
        n = end - start["1h"] + 1
        cities, devices = (_distinct(_codes(pa.array(c, pa.string())), low[k], high)[end] for c, k in ((city, "1h"), (device, "24h")))
        out = [ids, *(end - start[k] + 1 for k in LENGTHS), hour["sum"] / n, np.sqrt(hour["m2"] / n), day["max"], cities, devices]
        kept = int(np.searchsorted(us, us[-1] - KEPT_US))
        self.rows.put(list(zip(us[kept:].tolist(), amount[kept:].tolist(), city[kept:], device[kept:], strict=True)))
        yield pd.DataFrame(dict(zip((c.split()[0] for c in self.schema.split(", ")), out, strict=True)))

    def close(self) -> None:
        pass


def rolling_user_windows(txns: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of per-event user features; txns has event_id, us, payer_vpa, amount, payer_city, device_id.

    ttl_ms: processing time after which an idle entity's state goes, for streams that stand (a day fits live data). Spark
    runs batches without data for state that can expire, so a run over what there is now ends only without it or with
    spark.sql.streaming.noDataMicroBatches.enabled off."""
    use_rocksdb(txns.sparkSession)
    rows = txns.filter(F.coalesce(F.col("payer_vpa"), F.lit("")) != "").select("event_id", "us", "payer_vpa", "amount", "payer_city", "device_id")
    return rows.groupBy("payer_vpa").transformWithStateInPandas(RollingWindows(ttl_ms), RollingWindows.schema, "Append", _mode(ttl_ms))


def anchored_dedup(alerts: DataFrame, window_us: int, ttl_ms: int | None = None) -> DataFrame:
    """Alerts (event_id, us, user, alert_type) that fire: none within the window after the last that fired. With ttl_ms, which
    should be the window or more, state of a key goes so long after it was last written, in processing time (see rolling_user_windows)."""
    use_rocksdb(alerts.sparkSession)

    class Anchor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", "us bigint", ttl_ms)

        def handleInputRows(self, key, rows, timerValues):
            last = self.last.get()[0] if self.last.exists() else None
            fired = []
            for r in pd.concat(list(rows)).sort_values(["us", "event_id"]).itertuples(index=False):
                if last is None or r.us - last >= window_us:
                    fired.append((r.event_id, r.us, key[0], key[1]))
                    last = int(r.us)
            self.last.update((last,))
            yield pd.DataFrame(fired, columns=["event_id", "us", "user", "alert_type"])

        def close(self) -> None:
            pass

    return alerts.groupBy("user", "alert_type").transformWithStateInPandas(Anchor(), "event_id bigint, us bigint, user string, alert_type string", "Append", _mode(ttl_ms))


def running_sketch(rows: DataFrame, key: str, sketch: CountMin | None = None) -> DataFrame:
    """The cells as a stream, for update or complete mode: state has a fixed size."""
    sketch = sketch or CountMin()
    return sketch._cells(rows.select(key), key).groupBy("row", "col").count().withColumnRenamed("count", "cnt")


def tumbling(rows: DataFrame, at: str, length: str, late: str = "24 hours") -> DataFrame:
    """Counts and sums by window of event time; rows later than the watermark are dropped."""
    return rows.withWatermark(at, late).groupBy(F.window(at, length)).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


def sessions(rows: DataFrame, at: str, key: str, gap: str, late: str = "24 hours") -> DataFrame:
    return rows.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n"))


class DriftWindows:
    """foreachBatch: rows gather until a window is full; then the report function gets it and the buffer is empty again.

    All state lies in files below path, each batch under its number: a batch that runs again replaces its own rows, one that
    a report has taken already is left out, and a new process goes on where the last one stopped."""

    def __init__(self, report: Callable[[DataFrame], None], path: str, size: int = 500):
        self.report, self.path, self.size, self.buffered = report, path, size, 0

    def _numbers(self, spark, prefix: str) -> list[int]:
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        done = max(self._numbers(spark, "reported-"), default=-1)
        if batch_id <= done:
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/rows-{batch_id}")
        waiting = [f"{self.path}/rows-{k}" for k in self._numbers(spark, "rows-") if k > done]
        gathered = spark.read.schema(batch.schema).parquet(*waiting)
        self.buffered = gathered.count()
        if self.buffered >= self.size:
            self.report(gathered)
            fs = path("").getFileSystem(spark._jsc.hadoopConfiguration())
            fs.mkdirs(path(f"reported-{batch_id}"))
            for k in self._numbers(spark, "rows-"):
                if k <= batch_id:
                    fs.delete(path(f"rows-{k}"), True)
            self.buffered = 0


def run_to_files(query: DataFrame, path: str) -> DataFrame:
    """Runs an append-mode stream over what there is now into files below path; exactly once, by its checkpoint."""
    q = query.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return query.sparkSession.read.schema(query.schema).parquet(f"{path}/out")


def run_complete(query: DataFrame, path: str) -> DataFrame:
    """The same for complete mode: the last batch's whole result stays."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    q = query.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return query.sparkSession.read.schema(query.schema).parquet(f"{path}/out")
