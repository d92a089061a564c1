import random

import numpy as np
import pytest

from tidemark.operators.models import MLP
from tidemark.streaming import learning as L
from pyspark.sql import functions as F


def test_reservoirs_merge_and_survive_replays(spark, tmp_path):
    """In one batch, in many, dealt otherwise, with batches run again and by a new process: the same k rows."""
    rows = spark.range(500).select(F.col("id").alias("event_id"), (F.col("id") * 2).alias("x"))
    want = sorted(r["event_id"] for r in rows.orderBy(L.random_key(7, "event_id")).limit(40).collect())
    for name, parts in (("one", [rows.repartition(7)]), ("many", [rows.filter(F.col("event_id") % 5 == k) for k in range(5)])):
        path = str(tmp_path / name)
        for k, part in enumerate(parts):
            for _ in range(2):
                L.Reservoir(path, 40, ["event_id"], 7)(part, k)
        L.Reservoir(path, 40, ["event_id"], 7)(parts[0], 0)
        sample = L.Reservoir(path, 40, ["event_id"], 7).sample(spark, rows.schema).collect()
        assert sorted(r["event_id"] for r in sample) == want and all(r["x"] == 2 * r["event_id"] for r in sample)


def test_samples_are_uniform(spark):
    """Chi-square of how often each of 50 rows is among the 10 of least hash, over 400 seeds."""
    seeds = spark.range(400).withColumnRenamed("id", "seed")
    keys = spark.range(50).crossJoin(seeds).select("id", "seed", F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("id").cast("string"))).alias("h"))
    assert spark.range(1).select(L.random_key(3, "id").alias("h")).first()["h"] == keys.filter("seed = 3 AND id = 0").first()["h"]
    counts = np.zeros(50)
    by_seed = {}
    for r in keys.collect():
        by_seed.setdefault(r["seed"], []).append((r["h"], r["id"]))
    for own in by_seed.values():
        for _, k in sorted(own)[:10]:
            counts[k] += 1
    chi = (((counts - 80) ** 2) / (80 * 0.8)).sum()
    assert chi < 85  # 49 degrees of freedom: 0.999 quantile


def batches(n, parts, seed=1):
    r = random.Random(seed)
    rows = [(k, [r.gauss(0, 1), r.gauss(0, 1)], None) for k in range(n)]
    rows = [(k, x, int(x[0] > 0)) for k, x, _ in rows]
    return [rows[k::parts] for k in range(parts)]


SCHEMA = "event_id bigint, vector array<double>, is_fraud int"


def test_a_batch_is_learnt_from_once(spark, tmp_path):
    """Replays change nothing; a new process ends where one that ran through does."""
    parts = [spark.createDataFrame(p, SCHEMA) for p in batches(600, 3)]
    make = lambda path: L.StreamLearner(str(path), lambda: MLP(2, (6,), seed=3), every=50, size=32, k=100, lr=0.01)
    through = make(tmp_path / "through")
    for k, p in enumerate(parts):
        through(p, k)
    for k, p in enumerate(parts):
        again = make(tmp_path / "again")
        for _ in range(2):
            again(p, k)
        again(parts[0], 0)
    a, b = through.state(spark), make(tmp_path / "again").state(spark)
    assert (a["seen"], a["updates"], a["bursts"], a["baseline"]) == (b["seen"], b["updates"], b["bursts"], b["baseline"]) and a["seen"] == 600 and a["updates"] == 12
    x = np.random.default_rng(1).normal(size=(50, 2))
    assert np.array_equal(a["model"].predict_proba(x), b["model"].predict_proba(x))
    assert not np.array_equal(a["model"].predict_proba(x), MLP(2, (6,), seed=3).predict_proba(x))


def test_no_update_before_a_training_batch(spark, tmp_path):
    learner = L.StreamLearner(str(tmp_path), lambda: MLP(2, (6,)), every=5, size=64)
    rows = batches(20, 1)[0] + [(900, None, 1), (901, [0.0, 0.0], None)]
    learner(spark.createDataFrame(rows, SCHEMA), 0)
    learner(spark.createDataFrame([], SCHEMA), 1)
    state = learner.state(spark)
    assert (state["seen"], state["updates"], state["baseline"]) == (20, 0, None)


@pytest.mark.parametrize("order", ["up", "shuffled"])
def test_quantile_sketch_on_every_batch(spark, order):
    """Ranks are off by less than the sketch's bound, whatever the order of values, and so are those of merged sketches."""
    n = 20_000
    rows = spark.range(n).select((F.col("id") if order == "up" else F.pmod(F.col("id") * 7919, F.lit(n))).cast("double").alias("x"))
    got = L.quantiles(rows, "x").first()
    assert got["n"] == n and abs(got["p50"] / n - 0.5) < 0.0266 and abs(got["p99"] / n - 0.99) < 0.0266


def test_decisions_meet_labels_in_time_and_state_drops(spark, tmp_path):
    at = lambda s: f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    d = [(f"t{k}", at(k * 60), "BLOCK") for k in range(200)]
    f = [("t0", at(10), True), ("t1", at(60 + 3600), False), ("t2", at(120 + 3601), True), ("t5", at(299), True), ("t190", at(190 * 60 + 5), True), ("t3", None, True)]
    for name, rows, ddl in (("d", d, "transaction_id string, at string, decision string"), ("f", f, "transaction_id string, labelled_at string, confirmed boolean")):
        column = ddl.split(", ")[1].split()[0]
        spark.createDataFrame(rows, ddl).withColumn(column, F.to_timestamp(column)).coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda name: spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
    joined = L.decisions_with_feedback(read("d"), read("f"))
    q = joined.writeStream.format("memory").queryName("met").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {r["transaction_id"]: r["confirmed"] for r in spark.table("met").collect()}
    assert {k: got[k] for k in ("t0", "t1", "t190")} == {"t0": True, "t1": False, "t190": True}
    mark = 190 * 60 + 5 - 600  # the labels' watermark is the lesser
    unmatched = {f"t{k}" for k in range(200) if k * 60 + 3600 < mark} - {"t0", "t1"}
    assert {k for k, v in got.items() if v is None} == unmatched
    held = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert held <= 2 * (200 - len(unmatched)) + 4


def test_feedback_join_ends_within_a_millisecond_as_its_sql_does(spark, tmp_path):
    """Waiting decisions at the watermark's edge by less than a millisecond, and one at the first microsecond."""
    import duckdb

    from tidemark.plans.catalogue import ORACLE
    from tidemark.plans.streams import stream_feedback_join

    last = 3_000_000_499  # microseconds from 2024, as the view counts them
    edge = last // 1000 * 1000 - 1_200_000_000
    us = [0, 1, edge - 1001, edge - 1000, edge - 999, edge - 500, edge - 1, edge, edge + 1, edge + 999, last]
    rows = spark.createDataFrame([(3 * k + 1, x) for k, x in enumerate(us)] + [(299_997 + 900 * k, last) for k in range(3)], "event_id bigint, x bigint")
    rows = rows.select("event_id", F.timestamp_micros(F.col("x") * 600 + 1_704_067_200_000_000).alias("ts"), F.lit(7).cast("bigint").alias("user_id"), F.lit("error").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT event_id, ts::TIMESTAMP AS ts, user_id, event_type, value, props FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(db.execute(ORACLE["stream_feedback_join"]).fetchall())
    got = sorted(map(tuple, stream_feedback_join(spark, str(tmp_path)).select("event_id", "decision", "confirmed").collect()))
    assert {3 * k + 1 for k in (0, 1, 2, 3, 4, 5, 6)} <= {r[0] for r in want}
    assert got == want
