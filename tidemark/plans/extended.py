"""More registered queries: logs and key-value runs on disk, feedback and service views, decision modes, saved models, scalar functions."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import alerts, drift, explain, features, kv, metrics, windows
from ..operators.rules import RuleEngine
from ..schema import FEATURES
from ..session import shared_path
from ..sources import logs
from ..sources.transactions import transaction_stream, transactions
from ..streaming import stateful
from . import scoring
from .catalogue import _DRIFT, _KV, _SCORE, _TREE_SQL, LIMITS, RULED, SCORED, TREE, TXN, entries, query, scored

_ML = "CASE WHEN event_id % 10 <> 0 THEN ((event_id * 7919) % 1000) / 1000.0 END"


def _partial_model(df: DataFrame) -> DataFrame:
    """A model that gives nothing for every tenth row, nor for rows without a vector."""
    return df.withColumn("ml_score", F.expr("CASE WHEN event_id % 10 <> 0 AND vector IS NOT NULL THEN cast((event_id * 7919) % 1000 as double) / 1000.0D END"))


def _decisions(score: str, failed: str = "false") -> str:
    return f"CASE WHEN stop > 0 OR {failed} THEN 'BLOCK' WHEN {score} >= 0.9 THEN 'BLOCK' WHEN {score} >= 0.7 THEN 'REVIEW' ELSE 'PASS' END"


_FUSED = f"least(1.0, 0.4 * coalesce({_ML}, rule_score) + 0.6 * rule_score)"


@query("decide_live", f"WITH {RULED} SELECT event_id, round(CASE WHEN stop > 0 THEN 1.0 ELSE {_FUSED} END, 4) AS risk_score, {_decisions(_FUSED)} AS decision FROM decided")
def decide_live(spark: SparkSession, d: str) -> DataFrame:
    """Where the model gives nothing the rule score stands in."""
    out = scoring.decide(transactions(spark, d), _partial_model, RuleEngine(LIMITS))
    return out.select("event_id", F.col("score").alias("risk_score"), "decision")


@query("decide_fail_closed", f"WITH {RULED} SELECT event_id, round(CASE WHEN stop > 0 OR event_id % 10 = 0 THEN 1.0 ELSE {_FUSED} END, 4) AS risk_score, {_decisions(_FUSED, 'event_id % 10 = 0')} AS decision FROM decided")
def decide_fail_closed(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.decide(transactions(spark, d), _partial_model, RuleEngine(LIMITS), "fail_closed")
    return out.select("event_id", F.col("score").alias("risk_score"), "decision")


@query("decide_degraded", f"WITH {RULED} SELECT event_id, round(CASE WHEN stop > 0 THEN 1.0 ELSE rule_score END, 4) AS risk_score, {_decisions('rule_score')} AS decision FROM decided")
def decide_degraded(spark: SparkSession, d: str) -> DataFrame:
    """The rule score alone, whatever the model says."""
    out = scoring.decide(transactions(spark, d), _partial_model, RuleEngine(LIMITS), "degraded", vectors=False)
    return out.select("event_id", F.col("score").alias("risk_score"), "decision")


@query("first_seen_entities", f"WITH {TXN} SELECT device_id, arg_min(event_id, (us, event_id)) AS event_id, min(us) AS us FROM txn GROUP BY 1")
def first_seen_entities(spark: SparkSession, d: str) -> DataFrame:
    return windows.first_seen(transactions(spark, d), "device_id")


@query("feedback_precision", f"WITH {SCORED} SELECT decision, count(*) FILTER (is_fraud) AS confirmed, count(*) FILTER (NOT is_fraud) AS false_alarms, round(count(*) FILTER (is_fraud) / greatest(1, count(*)), 8) AS precision FROM scored WHERE event_id % 3 = 0 GROUP BY 1")
def feedback_precision(spark: SparkSession, d: str) -> DataFrame:
    """Analysts change their minds: each label comes twice, and the later one counts."""
    s = scored(spark, d)
    last = s.filter("event_id % 3 = 0").select("transaction_id", F.col("is_fraud").alias("confirmed"), F.lit(2).alias("seq"))
    labels = last.unionByName(last.select("transaction_id", (~F.col("confirmed")).alias("confirmed"), F.lit(1).alias("seq")))
    return metrics.feedback_precision(metrics.feedback(s, labels)).withColumn("precision", F.round("precision", 8))


@query("review_queue", f"WITH {SCORED} SELECT event_id, score FROM scored WHERE decision = 'REVIEW' ORDER BY us DESC, event_id DESC LIMIT 10")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return metrics.review_queue(scored(spark, d), ["us", "event_id"]).select("event_id", "score")


@query("latest_feed", f"WITH {SCORED} SELECT event_id, decision FROM scored ORDER BY us DESC, event_id DESC LIMIT 30")
def latest_feed(spark: SparkSession, d: str) -> DataFrame:
    return metrics.feed(scored(spark, d), ["us", "event_id"]).select("event_id", "decision")


@query(
    "service_metrics",
    f"""WITH {SCORED}, t AS (SELECT round(quantile_disc(latency_ms, 0.5), 2) AS p50_ms, round(quantile_disc(latency_ms, 0.99), 2) AS p99_ms FROM (SELECT latency_ms FROM scored ORDER BY us DESC, event_id DESC LIMIT 10000))
        SELECT count(*) AS total_scored, count(*) FILTER (decision = 'BLOCK') AS block, count(*) FILTER (decision = 'REVIEW') AS review, count(*) FILTER (decision = 'PASS') AS pass, any_value(p50_ms) AS p50_ms, any_value(p99_ms) AS p99_ms, true AS shadow_mode FROM scored, t""",
)
def service_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.service_metrics(scored(spark, d), ["us", "event_id"], "shadow")


@query("audit_of_transaction", f"WITH {SCORED}, w AS (SELECT unnest(['txn_0', 'txn_none']) AS t) SELECT count(transaction_id) > 0 AS found, count(transaction_id) AS n, min(decision) AS decision FROM w LEFT JOIN scored ON transaction_id = t GROUP BY t")
def audit_of_transaction(spark: SparkSession, d: str) -> DataFrame:
    log = scored(spark, d).select("transaction_id", "decision")
    got = scoring.audit_response(log, "txn_0").unionByName(scoring.audit_response(log, "txn_none"))
    return got.select("found", F.size("entries").cast("bigint").alias("n"), F.try_element_at(F.col("entries"), F.lit(1))["decision"].alias("decision"))


@query(
    "feature_store_invalidate",
    f"""WITH {TXN}, s AS (SELECT payer_vpa, us, event_id AS value, event_id % 10 = 4 AS gone FROM txn WHERE event_id % 2 = 0), p AS (SELECT payer_vpa, us AS now, event_id AS probe FROM txn WHERE event_id % 2 = 1)
        SELECT p.payer_vpa, p.now, p.probe, CASE WHEN p.now - max(s.us) <= 600000000 AND NOT arg_max(s.gone, (s.us, s.value)) THEN arg_max(s.value, (s.us, s.value)) END AS value
        FROM p LEFT JOIN s ON s.payer_vpa = p.payer_vpa AND s.us <= p.now GROUP BY 1, 2, 3""",
)
def feature_store_invalidate(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    even = t.filter("event_id % 2 = 0")
    store = kv.put(even.filter("event_id % 10 < 2").select("payer_vpa", "us", F.col("event_id").alias("value")), even.filter("event_id % 10 IN (2, 6, 8)").select("payer_vpa", "us", F.col("event_id").alias("value")))
    store = kv.invalidate(store, even.filter("event_id % 10 = 4").select("payer_vpa", "us"), "payer_vpa")
    probes = t.filter("event_id % 2 = 1").select("payer_vpa", F.col("us").alias("now"), F.col("event_id").alias("probe"))
    return kv.ttl_lookup(store, probes, "payer_vpa", 600_000_000)


@query("drift_saved_reference", f"WITH {_DRIFT} SELECT feature, round(psi, 6) AS psi, status, round(mean_shift, 6) AS mean_shift FROM rep")
def drift_saved_reference(spark: SparkSession, d: str) -> DataFrame:
    """The report against a reference that was written and read again."""
    t = transactions(spark, d).select("event_id", "amount", F.col("us").cast("double").alias("us"))
    base, current = t.filter("event_id % 2 = 0"), t.filter("event_id % 2 = 1").withColumn("amount", F.col("amount") * 1.3)
    path = shared_path(spark, "drift-reference")
    drift.save_reference(drift.reference(base, ["amount", "us"]), path)
    rep = drift.report(base, current, ["amount", "us"], ref=drift.load_reference(spark, path))
    return rep.select("feature", F.round("psi", 6).alias("psi"), "status", F.round("mean_shift", 6).alias("mean_shift"))


@query(
    "rolling_loss",
    f"""WITH RECURSIVE {TXN}, e AS (SELECT payer_vpa, event_id, ln(1 + amount) AS loss, row_number() OVER w AS k, avg(ln(1 + amount)) OVER (PARTITION BY payer_vpa ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS recent FROM txn WINDOW w AS (PARTITION BY payer_vpa ORDER BY event_id)),
        walk AS (SELECT payer_vpa, event_id, k, recent, loss AS slow FROM e WHERE k = 1 UNION ALL SELECT e.payer_vpa, e.event_id, e.k, e.recent, w.slow * 0.99 + e.loss * 0.01 FROM walk w JOIN e ON e.payer_vpa = w.payer_vpa AND e.k = w.k + 1)
        SELECT event_id, round(recent, 6) AS recent_loss, round(slow, 6) AS baseline_loss FROM walk""",
)
def rolling_loss(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d).select("payer_vpa", "event_id", F.log(1 + F.col("amount")).alias("loss"))
    return metrics.rolling_loss(t, "payer_vpa", "event_id", "loss").select("event_id", F.round("recent_loss", 6).alias("recent_loss"), F.round("baseline_loss", 6).alias("baseline_loss"))


@query("saved_ensemble_score", f"WITH {TXN} SELECT event_id, round(1 / (1 + exp(-(-1.0 + 0.1 * {_TREE_SQL}))), 8) AS score FROM txn")
def saved_ensemble_score(spark: SparkSession, d: str) -> DataFrame:
    """An ensemble that was written and read again, scored in Arrow batches."""
    import tempfile

    from ..operators.models import GBT, Ensemble, score

    model = GBT()
    model.start, model.trees, model.d = -1.0, [TREE], 2
    with tempfile.TemporaryDirectory() as folder:  # the driver's own; executors get the model by broadcast
        Ensemble(gbt=model).save(folder)
        again = Ensemble.load(folder)
    rows = transactions(spark, d).select("event_id", F.array("amount", "device_age_hours").alias("vector"))
    return score(rows, again).select("event_id", F.round("ml_score", 8).alias("score"))


_SHAP = f"{TXN}, x AS (SELECT event_id, amount / 10000 AS a, device_age_hours / 10000 AS b, is_new_device::INT AS c FROM txn)"


@query("shap_exact_values", f"WITH {_SHAP} SELECT event_id, f AS feature, round(v, 6) + 0.0 AS value FROM (SELECT event_id, unnest(['amount', 'age', 'new']) AS f, unnest([a - 1.5, -2.0 * (b - 0.5), 0.5 * (c - 1.0)]) AS v FROM x)")
def shap_exact_values(spark: SparkSession, d: str) -> DataFrame:
    """Against one background row a linear model's attributions are its weights times the differences."""
    import numpy as np

    w = np.array([1.0, -2.0, 0.5])
    vectors = transactions(spark, d).select("event_id", F.array(F.col("amount") / 10000, F.col("device_age_hours") / 10000, F.col("is_new_device").cast("double")).alias("vector"))
    values = explain.explain(vectors, explain.KernelExplainer(lambda x: x @ w, np.array([[1.5, 0.5, 1.0]]), 64), ["amount", "age", "new"])
    return values.select("event_id", "feature", (F.round("value", 6) + F.lit(0.0)).alias("value"))


def _product(spark: SparkSession, d: str) -> DataFrame:
    """Attributions of amount x age + new against one background row; a model with an interaction."""
    import numpy as np

    vectors = transactions(spark, d).select("event_id", F.array(F.col("amount") / 10000, F.col("device_age_hours") / 10000, F.col("is_new_device").cast("double")).alias("vector"))
    explainer = explain.KernelExplainer(lambda x: x[:, 0] * x[:, 1] + x[:, 2], np.array([[1.5, 0.5, 1.0]]), 6)
    return explain.explain(vectors, explainer, ["amount", "age", "new"])


_RANKED = f"""{_SHAP}, v AS (SELECT event_id, a * b + c AS prediction, unnest(['amount', 'age', 'new']) AS feature,
    unnest([(a - 1.5) * (b + 0.5) / 2, (b - 0.5) * (a + 1.5) / 2, c - 1.0]) AS value FROM x)"""


@query("shap_top_features", f"WITH {_RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(round(value, 6)) DESC, feature) AS place FROM v) SELECT event_id, feature, place::INT AS place FROM r WHERE place <= 2")
def shap_top_features(spark: SparkSession, d: str) -> DataFrame:
    """The two features that count most in each row: exact Shapley values of a product share its interaction."""
    values = _product(spark, d).withColumn("value", F.round("value", 6))
    return explain.top_features(values, k=2).select("event_id", "feature", "place")


@query("shap_mean_magnitude", f"WITH {_RANKED} SELECT feature, round(avg(abs(value)), 5) AS mean_magnitude FROM v GROUP BY 1")
def shap_mean_magnitude(spark: SparkSession, d: str) -> DataFrame:
    return explain.mean_magnitude(_product(spark, d), 10).select("feature", F.round("mean_magnitude", 5).alias("mean_magnitude"))


@query("shap_vector_23")
def shap_vector_23(spark: SparkSession, d: str) -> DataFrame:
    """All 23 features of every event, 64 coalitions: the three that count most."""
    import numpy as np

    w = np.linspace(-1, 1, len(FEATURES))
    rows = features.features(transactions(spark, d)).select("event_id", features.vector().alias("vector"))
    explainer = explain.KernelExplainer(lambda x: np.tanh(x @ w / 1e4), np.zeros((1, len(FEATURES))), 64)
    return explain.explain(rows, explainer, list(FEATURES), top=3).select("event_id", "place", "feature")


@query(
    "scalar_functions",
    f"""WITH {TXN}, x AS (SELECT event_id, (event_id % 41 - 20) / 2.0 AS v, (event_id % 11) / 10.0 AS p FROM txn)
        SELECT event_id, round(1 / (1 + exp(-v)), 10) AS sigmoid, round(ln(greatest(1e-7, least(1 - 1e-7, p)) / (1 - greatest(1e-7, least(1 - 1e-7, p)))), 6) AS log_odds,
               CASE WHEN event_id % 4 = 3 THEN v ELSE 0.0 END AS cleaned, CASE WHEN event_id % 4 = 3 THEN v WHEN event_id % 4 = 2 THEN 'Infinity'::DOUBLE ELSE 9.5 END AS defaulted, CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 ELSE 2.5 END AS flag,
               CASE event_id % 3 WHEN 0 THEN 1704164645000000 ELSE 0 END::BIGINT AS micros, round((v - 3.0) / 2.5, 10) AS z FROM x""",
)
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    x = transactions(spark, d).select("event_id", F.expr("cast(event_id % 41 - 20 as double) / 2.0D").alias("v"), F.expr("cast(event_id % 11 as double) / 10.0D").alias("p"))
    broken = F.expr("CASE event_id % 4 WHEN 1 THEN double('NaN') WHEN 2 THEN double('Infinity') WHEN 3 THEN v END")
    flag = F.expr("CASE event_id % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'F' WHEN 2 THEN 'what' ELSE '2.5' END")
    stamp = F.expr("CASE event_id % 3 WHEN 0 THEN '2024-01-02T03:04:05' WHEN 1 THEN 'never' END")
    return x.select(
        "event_id", F.round(scalar.sigmoid(F.col("v")), 10).alias("sigmoid"), F.round(scalar.log_odds(F.col("p")), 6).alias("log_odds"), scalar.clean_number(broken).alias("cleaned"),
        scalar.number_default(broken, 9.5).alias("defaulted"), scalar.flag_number(flag).alias("flag"), scalar.epoch_micros(stamp).alias("micros"), F.round(scalar.zscore(F.col("v"), F.lit(3.0), F.lit(2.5)), 10).alias("z"),
    )


@query("fnv_hashes", f"WITH {TXN} SELECT event_id, list_reduce([14695981039346656037::HUGEINT] || list_transform(range(1, length(transaction_id) + 1), lambda i: ascii(transaction_id[i])::HUGEINT), lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616)::VARCHAR AS hash FROM txn")
def fnv_hashes(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).select("event_id", scalar.fnv1a(F.col("transaction_id")).cast("string").alias("hash"))


@query("log_roundtrip", f"WITH {TXN} SELECT count(*) AS records, sum(length(transaction_id))::BIGINT AS bytes, 5::BIGINT AS first_offset, (5 + sum(length(transaction_id) + 8) - 8 - max_by(length(transaction_id), event_id))::BIGINT AS last_offset, 0::BIGINT AS broken FROM txn")
def log_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """An append log in segments that ends in a cut-off record, written by the tasks that hold its rows and scanned as a data source."""
    path = os.path.join(_local(shared_path(spark, "append-log")), "log")
    segments = logs.write_segments(transactions(spark, d).select("transaction_id", "event_id"), path, "transaction_id", ["event_id"])
    with open(segments[-1], "ab") as f:
        f.write(b"\x00\x00\x00\x20cut off")
    rows = logs.read_log(spark, path)
    return rows.agg(F.count("*").alias("records"), F.sum(F.length("payload")).alias("bytes"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.count_if(F.crc32("payload") != F.col("crc")).alias("broken"))


@query("wal_replay", f"WITH {TXN}, n AS (SELECT row_number() OVER (ORDER BY event_id) AS lsn, transaction_id FROM txn) SELECT lsn, transaction_id FROM n WHERE lsn > 100")
def wal_replay(spark: SparkSession, d: str) -> DataFrame:
    """What a write-ahead log holds after a checkpoint."""
    path = os.path.join(_local(shared_path(spark, "wal")), "wal")
    logs.write_segments(transactions(spark, d).select(F.to_json(F.struct("transaction_id")).alias("payload"), "event_id"), path, "payload", ["event_id"], "wal")
    return logs.replay(spark, path, 100).select("lsn", F.get_json_object("payload", "$.transaction_id").alias("transaction_id"))


@query("kv_runs_on_disk", f"WITH {_KV} SELECT key, seq, value FROM newest WHERE NOT deleted")
def kv_runs_on_disk(spark: SparkSession, d: str) -> DataFrame:
    """Three sorted runs on two levels, written, read and compacted; keys and newest entries as in one table."""
    path, e = shared_path(spark, "kv-runs"), entries(spark, d)
    for k in range(3):
        kv.write_run(e.filter(F.col("seq") % 3 == k), path, k // 2)
    return kv.scan(kv.read_runs(spark, path))


@query("kv_run_stats", f"WITH {TXN} SELECT event_id % 3 AS run, count(*) AS entries, min(device_id) AS min_key, max(device_id) AS max_key FROM txn GROUP BY 1")
def kv_run_stats(spark: SparkSession, d: str) -> DataFrame:
    """Entries and key range of each run, over its files."""
    path, e = shared_path(spark, "kv-stats"), entries(spark, d)
    for k in range(3):
        kv.write_run(e.filter(F.col("seq") % 3 == k), f"{path}/{k}")
    stats = [kv.run_stats(kv.read_runs(spark, f"{path}/{k}")).agg(F.sum("entries").alias("entries"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key")).withColumn("run", F.lit(k).cast("bigint")) for k in range(3)]
    return stats[0].unionByName(stats[1]).unionByName(stats[2])


@query("alert_dead_letters", f"WITH {SCORED} SELECT event_id, CASE WHEN score >= 0.9 THEN 'AUTO_BLOCK' ELSE 'REVIEW_FLAGGED' END AS alert_type FROM scored WHERE decision <> 'PASS' AND event_id % 2 = 0")
def alert_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """A stream of alerts to a receiver that takes odd ones alone: the rest are drained from the dead letters."""
    t = transaction_stream(spark, d).withColumn("score", F.expr("cast((event_id * 7919) % 1000 as double) / 1000.0D"))
    e = alerts.eligible(t.withColumn("decision", scoring.threshold(F.col("score")))).select("event_id", "alert_type")
    path = shared_path(spark, "alerts")
    send = alerts.deliver(_takes_odd, f"{path}/dead", tries=2, sleep=_no_wait)
    e.writeStream.foreachBatch(send).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return alerts.drain_dead_letters(spark, f"{path}/dead", f"{path}/drained").select("event_id", "alert_type")


def _takes_odd(record: dict) -> bool:
    return record["event_id"] % 2 == 1


def _no_wait(seconds: float) -> None:
    pass


@query("stream_tumbling", f"WITH {TXN} SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, round(sum(amount), 2) AS total FROM txn GROUP BY 1")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    rows = transaction_stream(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "amount")
    got = stateful.run_complete(stateful.tumbling(rows, "ts", "1 day"), shared_path(spark, "stream-tumbling"))
    return got.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "n", F.round("total", 2).alias("total"))


@query(
    "stream_sessions",
    f"""WITH {TXN}, g AS (SELECT payer_vpa, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM txn WINDOW w AS (PARTITION BY payer_vpa ORDER BY ts)),
        s AS (SELECT payer_vpa, ts, sum(fresh) OVER (PARTITION BY payer_vpa ORDER BY ts) AS k FROM g) SELECT payer_vpa, min(ts) AS first, count(*) AS n FROM s GROUP BY payer_vpa, k""",
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = transaction_stream(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "payer_vpa")
    got = stateful.run_complete(stateful.sessions(rows, "ts", "payer_vpa", "6 hours"), shared_path(spark, "stream-sessions"))
    return got.select("payer_vpa", F.col("session_window.start").cast("timestamp_ntz").alias("first"), "n")


@query(
    "window_statistics",
    f"""WITH {TXN}, s AS ("""
    + " UNION ALL ".join(
        f"""SELECT event_id, '{k}' AS "window", count(*) OVER w AS n, round(sum(amount) OVER w, 2) AS total, max(amount) OVER w AS most, min(amount) OVER w AS least, len(list_distinct(list(payer_city) OVER w))::BIGINT AS cities,
            len(list_distinct(list(device_id) OVER w))::BIGINT AS devices, round(count(*) OVER w / {v / 60}, 4) AS velocity FROM txn WINDOW w AS (PARTITION BY payer_vpa ORDER BY us RANGE BETWEEN {v * 1000000} PRECEDING AND CURRENT ROW)"""
        for k, v in windows.LENGTHS.items()
    )
    + ") SELECT * FROM s",
)
def window_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Seven statistics of all four windows; deviation and mean, which round at ties, are in other queries."""
    s = windows.all_stats(transactions(spark, d), "payer_vpa")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("window"), F.col(f"stats_{k}").alias("s")) for k in windows.LENGTHS)))
    names = {"count": "n", "sum": "total", "max": "most", "min": "least", "unique_cities": "cities", "unique_devices": "devices", "velocity": "velocity"}
    return s.select("event_id", each.alias("e")).select("event_id", "e.window", *(F.col(f"e.s.{a}").alias(b) for a, b in names.items()))


@query(
    "best_split",
    f"""WITH {TXN}, b AS (SELECT (event_id % 13)::INT AS x, (event_id % 7)::INT AS y, 0.5 - is_fraud::INT AS g, 0.25 AS h FROM txn), m AS (SELECT 'x' AS feature, x AS bin, g, h FROM b UNION ALL SELECT 'y', y, g, h FROM b),
        s AS (SELECT feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM m GROUP BY 1, 2), c AS (SELECT feature, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER (PARTITION BY feature) AS ga, sum(h) OVER (PARTITION BY feature) AS ha, sum(n) OVER (PARTITION BY feature) AS na FROM s WINDOW w AS (PARTITION BY feature ORDER BY bin))
        SELECT feature, bin, round(0.5 * (gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1)), 6) AS gain FROM c WHERE nl >= 1 AND na - nl >= 1 ORDER BY gain DESC, feature, bin LIMIT 1""",
)
def best_split(spark: SparkSession, d: str) -> DataFrame:
    rows = transactions(spark, d).select((F.col("event_id") % 13).alias("x"), (F.col("event_id") % 7).alias("y"), (F.lit(0.5) - F.col("is_fraud").cast("int")).alias("g"), F.lit(0.25).alias("h"))
    return metrics.best_split(rows, ["x", "y"], "g", "h").select("feature", "bin", F.round("gain", 6).alias("gain"))


def _local(path: str) -> str:
    """A path for files that driver and tasks write themselves: logs lie in a folder that all machines have mounted."""
    return path.removeprefix("file://").removeprefix("file:")
