"""Registered queries of streams with event time, replay-safe state and sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from ..sources.transactions import transaction_stream, transactions
from ..streaming import event_time, learning, stateful
from .catalogue import SCORED, TXN, query
from . import scoring

_WINDOWS = {"1m": 60, "5m": 300}
_BUCKET = 300_000_000 // 48
_DELAY_MS = 600_000
#: `us` counts from 2024.
_EPOCH_US = 1_704_067_200_000_000


@query(
    "stream_event_windows",
    f"""WITH {TXN} SELECT event_id, count(*) OVER a AS n_1m, max(amount) OVER a AS max_1m, len(list_distinct(list(payer_city) OVER a))::BIGINT AS cities_1m, count(*) OVER b AS n_5m, round(avg(amount) OVER b, 4) AS mean_5m, round(stddev_pop(amount) OVER b, 3) AS std_5m,
        len(list_distinct(list(device_id) OVER b))::BIGINT AS devices_5m FROM txn
        WINDOW a AS (PARTITION BY payer_vpa ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW), b AS (PARTITION BY payer_vpa ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW)""",
)
def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Rolling windows from state in buckets of event time."""
    out, _ = event_time.run_apart(event_time.event_windows(transaction_stream(spark, d), windows=_WINDOWS, bucket_us=_BUCKET), shared_path(spark, "stream-event-windows"))
    return out.select("event_id", "n_1m", "max_1m", "cities_1m", "n_5m", F.round("mean_5m", 4).alias("mean_5m"), F.round("std_5m", 3).alias("std_5m"), "devices_5m")


@query(
    "stream_live_counters",
    f"""WITH {TXN}, b AS (SELECT payer_vpa, us, us // {_BUCKET} AS bucket, (SELECT max(us) // 1000 - {_DELAY_MS} FROM txn) AS mark FROM txn)
        SELECT count(DISTINCT payer_vpa) AS keys, count(DISTINCT (payer_vpa, bucket)) AS buckets, count(*) AS rows FROM b WHERE ceil(((bucket + 1) * {_BUCKET} + 300000000) / 1000) > mark""",
)
def stream_live_counters(spark: SparkSession, d: str) -> DataFrame:
    """What the state of the windows holds when the stream has stopped, read from its checkpoint."""
    path = shared_path(spark, "stream-live-counters")
    event_time.run_apart(event_time.event_windows(transaction_stream(spark, d), windows=_WINDOWS, bucket_us=_BUCKET), path)
    return event_time.live_counters(spark, f"{path}/checkpoint")


@query("stream_reservoir", f"WITH {TXN} SELECT event_id, amount FROM txn ORDER BY md5('42:' || event_id) LIMIT 100")
def stream_reservoir(spark: SparkSession, d: str) -> DataFrame:
    """A hundred of all transactions, each with equal chance, by merging batches."""
    rows, path = transaction_stream(spark, d).select("event_id", "amount"), shared_path(spark, "stream-reservoir")
    reservoir = learning.Reservoir(f"{path}/sample", 100, ["event_id"])
    rows.writeStream.foreachBatch(reservoir).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return reservoir.sample(spark, rows.schema)


@query(
    "stream_feedback_join",
    f"""WITH {SCORED}, f AS (SELECT transaction_id, us + (event_id * 37) % 900 * 1000000 AS labelled, is_fraud FROM txn WHERE event_id % 3 = 0),
        m AS (SELECT least((SELECT max(us) FROM txn), (SELECT max(labelled) FROM f)) // 1000 * 1000 - {_DELAY_MS} * 1000 AS mark)
        SELECT s.event_id, s.decision, f.is_fraud::INT AS confirmed FROM scored s LEFT JOIN f ON f.transaction_id = s.transaction_id AND f.labelled BETWEEN s.us AND s.us + 600000000, m
        WHERE f.transaction_id IS NOT NULL OR s.us + 600000000 < m.mark""",
)
def stream_feedback_join(spark: SparkSession, d: str) -> DataFrame:
    """Decisions and the labels that came within ten minutes; the others once the watermark has passed them."""
    path = shared_path(spark, "stream-feedback")
    t = transaction_stream(spark, d).withColumn("score", F.expr("cast((event_id * 7919) % 1000 as double) / 1000.0D"))
    at = F.col("us") + _EPOCH_US  # a first watermark of 1970 would call rows of the first microsecond late
    decisions = t.select("event_id", "transaction_id", F.timestamp_micros(at).alias("at"), scoring.threshold(F.col("score")).alias("decision"))
    late = F.timestamp_micros(at + F.expr("event_id * 37 % 900 * 1000000"))
    labels = transaction_stream(spark, d).filter("event_id % 3 = 0").select("transaction_id", late.alias("labelled_at"), F.col("is_fraud").alias("confirmed"))
    joined = learning.decisions_with_feedback(decisions, labels, within="10 minutes")
    return stateful.run_to_files(joined, path).select("event_id", "decision", F.col("confirmed").cast("int").alias("confirmed"))


@query("stream_quantiles", f"WITH {TXN} SELECT count(*) AS n, true AS p50_near, true AS p99_near FROM txn")
def stream_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of a stream from one sketch: whether their ranks among all amounts are within two hundredths."""
    got = stateful.run_complete(learning.quantiles(transaction_stream(spark, d), "amount"), shared_path(spark, "stream-quantiles"))
    near = lambda c, p: (F.abs(F.count_if(F.col("amount") <= F.col(c)) / F.count("*") - p) < 0.02).alias(f"{c}_near")
    return transactions(spark, d).crossJoin(F.broadcast(got)).agg(F.max("n").alias("n"), near("p50", 0.5), near("p99", 0.99))


@query("stream_learner")
def stream_learner(spark: SparkSession, d: str) -> DataFrame:
    """A network that learns from every labelled event once; what it has seen."""
    from ..operators.models import MLP

    path = shared_path(spark, "stream-learner")
    rows = transaction_stream(spark, d).select("event_id", F.array(F.log1p("amount"), F.col("device_age_hours") / 8760).alias("vector"), F.col("is_fraud").cast("int").alias("is_fraud"))
    learner = learning.StreamLearner(path, lambda: MLP(2, (8,)), every=1_000)
    rows.writeStream.foreachBatch(learner).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return learning.Versions(spark, path, "model").read(learner.SCHEMA).select("seen", "updates")
