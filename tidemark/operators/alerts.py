"""Alerts: who gets one, dedup anchored at the last that fired, delivery with retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import LEAST, running
from .windows import with_previous

BLOCK_AT, REVIEW_AT, WINDOW_S = 0.90, 0.70, 300


def alert_type(score: Column) -> Column:
    return F.when(score >= BLOCK_AT, "AUTO_BLOCK").otherwise("REVIEW_FLAGGED")


def eligible(scored: DataFrame, score: str = "score", decision: str = "decision") -> DataFrame:
    """Rows with a score from 0.70 or a decision other than PASS, with their alert type."""
    return scored.filter(~((F.col(score) < REVIEW_AT) & (F.col(decision) == "PASS"))).withColumn("alert_type", alert_type(F.col(score)))


def dedup(alerts: DataFrame, keys: list[str], at: str = "us", window_us: int = WINDOW_S * 1_000_000, rows: str = "event_id", least: int = LEAST) -> DataFrame:
    """Alerts that fire: none within the window after the last of its key that fired. A gap of the window or more parts a key's
    alerts into chains; the sorted rows of chains then pass with the last time that fired. A chain's steps go from one that fires
    to the next, found by bisection, so a storm costs as many steps as alerts that it leaves, and only a batch is held."""
    base = alerts.withColumn("_key", F.to_json(F.struct(*keys)))
    started = with_previous(base, "_key", at, rows, least, "_previous")
    new = F.coalesce((F.col(at) - F.col("_previous") >= window_us).cast("int"), F.lit(1))
    chained = running(started.withColumn("_new", new).drop("_previous"), ["_key"], [at, rows], {"_chain": F.col("_new")}, least=least).drop("_new")
    place = alerts.columns.index(at)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last = None, 0
        for b in batches:
            if not len(b):
                continue
            t, numbers = b.column(place).to_numpy(), b.column(len(b.columns) - 1).to_numpy()
            names = pc.dictionary_encode(b.column(len(b.columns) - 2)).indices.to_numpy()
            begins = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (numbers[1:] != numbers[:-1])])
            ends = np.r_[begins[1:], len(t)]
            keep = np.zeros(len(t), dtype=bool)
            first = (b.column(len(b.columns) - 2)[0].as_py(), int(numbers[0]))
            fresh = begins if first != chain else begins[1:]
            keep[fresh] = True
            # chains that go on from the batch before, or last as long as the window at least, have more to fire
            for s, e in zip(begins.tolist(), ends.tolist(), strict=True):
                if s == 0 and first == chain:
                    now = s + int(np.searchsorted(t[s:e], last + window_us))
                elif t[e - 1] - t[s] >= window_us or e == len(t):
                    now = s
                else:
                    continue
                while now < e:
                    keep[now], last = True, int(t[now])
                    now += int(np.searchsorted(t[now:e], last + window_us))
            chain = (b.column(len(b.columns) - 2)[len(b) - 1].as_py(), int(numbers[-1]))
            yield b.filter(pa.array(keep))

    ordered = chained.select(*alerts.columns, "_key", "_chain").repartition("_key", "_chain").sortWithinPartitions("_key", "_chain", at, rows)
    return ordered.mapInArrow(walk, ordered.schema).select(*alerts.columns)


def counters(alerts: DataFrame, fired: DataFrame) -> DataFrame:
    return alerts.agg(F.count("*").alias("seen")).crossJoin(fired.agg(F.count("*").alias("fired"))).select("seen", "fired", (F.col("seen") - F.col("fired")).alias("suppressed"))


def drift_alerts(overall: DataFrame) -> DataFrame:
    """Alert rows for a drift report that calls for one."""
    return overall.filter("alert").select(
        F.lit("DRIFT_DETECTED").alias("alert_type"), F.lit("system").alias("user_id"), F.lit("MONITOR").alias("decision"),
        F.coalesce("score_psi", F.lit(0.0)).alias("risk_score"), F.array_join("features", ",").alias("features"),
    )


def deliver(post: Callable[[dict], bool], dead_letters: str, tries: int = 5, cap_s: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that posts each alert, waiting 1, 2, 4 ... seconds between tries. What can't be delivered is
    written below dead_letters, a folder that all machines share, under its batch's number: a batch that runs again replaces
    its own. post runs on the executors, at least once for each alert."""

    def send(batches):
        for pdf in batches:
            failed = []
            for place, record in enumerate(pdf.to_dict("records")):
                for k in range(tries):
                    try:
                        if post(record):
                            break
                    except Exception:  # noqa: BLE001, S110  a failed post is tried again
                        pass
                    if k + 1 < tries:
                        sleep(min(cap_s, 2.0**k))
                else:
                    failed.append(place)
            yield pdf.iloc[failed]

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.mapInPandas(send, batch.schema).write.mode("overwrite").parquet(f"{dead_letters}/batch={batch_id}")

    return run


def drain_dead_letters(spark, dead_letters: str, to: str) -> DataFrame:
    """Moves all dead letters to the folder `to`, which must not exist yet, and returns them; those of later batches come with the next drain."""
    root = spark._jvm.org.apache.hadoop.fs.Path(dead_letters)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [x.getPath() for x in fs.listStatus(root)] if fs.exists(root) else []
    parts = [p for p in parts if p.getName().startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not parts:
        return spark.createDataFrame([], "batch bigint")
    rows = spark.read.option("basePath", dead_letters).parquet(*(p.toString() for p in parts))
    rows.write.parquet(to)
    for p in parts:
        fs.delete(p, True)
    return spark.read.parquet(to)
