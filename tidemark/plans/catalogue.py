"""The registered queries and the SQL that DuckDB checks them with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts, attacks, drift, features, index, kv, metrics, windows
from ..operators.rules import Limits, RuleEngine
from ..operators.sketch import CountMin
from ..schema import FEATURES
from ..sources import card
from ..session import shared_path, stored
from ..sources.transactions import CITIES, VIEW_CODES, generate, transaction_stream, transactions
from ..streaming import stateful
from . import scoring

#: Means can fall on ties of a rounding, which engines break by their last bits: 1e-7 is added before rounding on both sides.
#: The events view holds about 100 transactions a device at the smallest scale factor checked.
LIMITS = Limits(device_total=90)
SKETCH = CountMin()
QUERIES, ORACLE = {}, {}

TXN = f"""txn AS (
    SELECT event_id, 'txn_' || event_id AS transaction_id, (epoch_us(ts) - 1704067200000000) // 600 AS us, ts, 'user' || user_id AS payer_vpa, 'merchant_' || event_type AS payee_vpa,
           'dev_' || (props::JSON ->> '$.k') AS device_id, value * 100.0 AS amount, ({list(CITIES)})[event_id % 10 + 1] AS payer_city, ({VIEW_CODES})[event_id % 7 + 1] AS merchant_category_code,
           event_id % 33 = 0 AS is_new_device, (event_id % 8760)::DOUBLE AS device_age_hours, event_type = 'error' AS is_fraud FROM events)"""

WINDOWED = (
    TXN
    + """, f AS (
    SELECT t.*, count(*) OVER u1 AS user_txn_count_1m, count(*) OVER u5 AS user_txn_count_5m, count(*) OVER uh AS user_txn_count_1h, count(*) OVER ud AS user_txn_count_24h,
           avg(amount) OVER uh AS user_amount_mean_1h, stddev_pop(amount) OVER uh AS user_amount_std_1h, max(amount) OVER ud AS user_amount_max_24h,
           count(DISTINCT payer_city) OVER uh AS user_unique_cities_1h, count(DISTINCT device_id) OVER ud AS user_unique_devices_24h,
           count(*) OVER dh AS device_txn_count_1h, count(*) OVER dd AS device_txn_count_24h, count(*) OVER mh AS merchant_txn_count_1h, avg(amount) OVER mh AS merchant_amount_mean_1h,
           count(*) OVER (PARTITION BY payer_vpa ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS user_global_freq,
           count(*) OVER (PARTITION BY device_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS device_global_freq,
           count(*) OVER (PARTITION BY payee_vpa ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS merchant_global_freq,
           hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week, (isodow(ts) >= 6)::INT AS is_weekend
    FROM txn t
    WINDOW u1 AS (PARTITION BY payer_vpa ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW), u5 AS (PARTITION BY payer_vpa ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW),
           uh AS (PARTITION BY payer_vpa ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), ud AS (PARTITION BY payer_vpa ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW),
           dh AS (PARTITION BY device_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), dd AS (PARTITION BY device_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW),
           mh AS (PARTITION BY payee_vpa ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)),
    z AS (SELECT *, (amount - round(user_amount_mean_1h, 2)) / greatest(round(user_amount_std_1h, 2), 1.0) AS zraw FROM f)"""
)

RULED = (
    WINDOWED
    + """, fired AS (
    SELECT z.*, round(zraw, 4) AS amount_zscore_1h,
        CASE WHEN user_txn_count_1m >= 5 THEN {'n': 'txn_velocity_1m', 'b': true, 's': 0.7::DOUBLE} WHEN user_txn_count_5m >= 12 THEN {'n': 'txn_velocity_5m', 'b': true, 's': 0.65::DOUBLE} WHEN user_txn_count_1h >= 40 THEN {'n': 'txn_velocity_1h', 'b': false, 's': 0.25::DOUBLE} END AS r1,
        CASE WHEN user_amount_mean_1h < 10 THEN NULL WHEN round(zraw, 4) > 8 THEN {'n': 'amount_velocity', 'b': true, 's': 0.6::DOUBLE} WHEN round(zraw, 4) > 5 THEN {'n': 'amount_velocity', 'b': false, 's': 0.3::DOUBLE} END AS r2,
        CASE WHEN NOT is_new_device AND device_age_hours > 24 THEN NULL WHEN user_amount_mean_1h > 0 AND amount > user_amount_mean_1h * 5 THEN {'n': 'new_device_high_amount', 'b': true, 's': 0.55::DOUBLE} WHEN is_new_device OR device_age_hours < 2 THEN {'n': 'new_device', 'b': false, 's': 0.2::DOUBLE} END AS r3,
        CASE WHEN user_unique_cities_1h >= 3 THEN {'n': 'geo_velocity', 'b': true, 's': 0.65::DOUBLE} WHEN user_unique_cities_1h = 2 THEN {'n': 'geo_velocity', 'b': false, 's': 0.2::DOUBLE} END AS r4,
        CASE WHEN device_global_freq > 90 THEN {'n': 'device_farm', 'b': true, 's': 0.6::DOUBLE} END AS r5,
        CASE WHEN merchant_category_code IN ('6051', '7995', '5933', '6211') THEN {'n': 'high_risk_mcc', 'b': false, 's': 0.15::DOUBLE} END AS r6,
        CASE WHEN hour_of_day BETWEEN 2 AND 5 AND amount > 10000 THEN {'n': 'off_hours_high_amount', 'b': false, 's': 0.2::DOUBLE} END AS r7 FROM z),
    listed AS (SELECT *, list_filter([r1, r2, r3, r4, r5, r6, r7], lambda r: r IS NOT NULL) AS hits FROM fired),
    cut AS (SELECT *, coalesce(list_position(list_transform(hits, lambda r: r.b), true), 0) AS stop FROM listed),
    ruled AS (SELECT *, CASE WHEN stop > 0 THEN hits[1:stop] ELSE hits END AS kept FROM cut),
    decided AS (SELECT *, least(1.0, coalesce(list_sum(list_transform(kept, lambda r: r.s)), 0.0)) AS rule_score,
                CASE WHEN stop > 0 THEN 'BLOCK' WHEN len(kept) > 0 THEN 'REVIEW' ELSE 'PASS' END AS rule_decision FROM ruled)"""
)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def ruled(spark: SparkSession, d: str) -> DataFrame:
    engine = RuleEngine(LIMITS)
    return engine.evaluate(features.features(transactions(spark, d), engine.reads()))


@query("rule_decision_counts", f"WITH {RULED} SELECT rule_decision AS decision, count(*) AS n FROM decided GROUP BY 1")
def rule_decision_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.decision_counts(ruled(spark, d), "rule_decision")


@query(
    "user_velocity_decisions",
    f"""WITH {TXN}, c AS (SELECT count(*) OVER (PARTITION BY payer_vpa ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS m, count(*) OVER (PARTITION BY payer_vpa ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) AS f,
        count(*) OVER (PARTITION BY payer_vpa ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS h FROM txn)
        SELECT CASE WHEN m >= 5 OR f >= 12 THEN 'BLOCK' WHEN h >= 40 THEN 'REVIEW' ELSE 'PASS' END AS decision, count(*) AS n FROM c GROUP BY 1""",
)
def user_velocity_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The flagship slice: canonical view, user windows, the velocity rule, decisions counted."""
    engine = RuleEngine(LIMITS)
    engine.rules = engine.rules[:1]
    return metrics.decision_counts(engine.evaluate(windows.user_windows(transactions(spark, d))), "rule_decision")


@query("user_window_features", f"WITH {WINDOWED} SELECT event_id, user_txn_count_1m, user_txn_count_5m, user_txn_count_1h, user_txn_count_24h, round(user_amount_mean_1h, 4) AS mean_1h, round(user_amount_std_1h, 4) AS std_1h, user_amount_max_24h AS max_24h FROM f")
def user_window_features(spark: SparkSession, d: str) -> DataFrame:
    return windows.user_windows(transactions(spark, d)).select("event_id", *(f"user_txn_count_{k}" for k in windows.LENGTHS), F.round("user_amount_mean_1h", 4).alias("mean_1h"), F.round("user_amount_std_1h", 4).alias("std_1h"), F.col("user_amount_max_24h").alias("max_24h"))


@query("window_distinct_cities_devices", f"WITH {WINDOWED} SELECT event_id, user_unique_cities_1h AS cities_1h, user_unique_devices_24h AS devices_24h FROM f")
def window_distinct(spark: SparkSession, d: str) -> DataFrame:
    return windows.user_windows(transactions(spark, d)).select("event_id", F.col("user_unique_cities_1h").alias("cities_1h"), F.col("user_unique_devices_24h").alias("devices_24h"))


@query("device_window_features", f"WITH {WINDOWED} SELECT event_id, device_txn_count_1h AS n_1h, device_txn_count_24h AS n_24h FROM f")
def device_window_features(spark: SparkSession, d: str) -> DataFrame:
    return windows.entity_windows(transactions(spark, d), "device_id", ["1h", "24h"]).select("event_id", "n_1h", "n_24h")


@query("merchant_window_features", f"WITH {WINDOWED} SELECT event_id, merchant_txn_count_1h AS n_1h, round(merchant_amount_mean_1h + 1e-7, 4) AS mean_1h FROM f")
def merchant_window_features(spark: SparkSession, d: str) -> DataFrame:
    w = windows.entity_windows(transactions(spark, d), "payee_vpa", ["1h"])
    return w.select("event_id", "n_1h", F.round(F.col("total_1h") / F.col("n_1h") + 1e-7, 4).alias("mean_1h"))


@query(
    "all_window_stats",
    f"""WITH {TXN} SELECT event_id, count(*) OVER w AS n, round(round(sum(amount) OVER w, 2), 2) AS total, round(stddev_pop(amount) OVER w, 2) AS std, min(amount) OVER w AS least, round(count(*) OVER w / 5.0, 4) AS velocity FROM txn
        WINDOW w AS (PARTITION BY payer_vpa ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW)""",
)
def all_window_stats(spark: SparkSession, d: str) -> DataFrame:
    s = windows.all_stats(transactions(spark, d), "payer_vpa")
    return s.select("event_id", F.col("stats_5m.count").alias("n"), F.col("stats_5m.sum").alias("total"), F.col("stats_5m.std").alias("std"), F.col("stats_5m.min").alias("least"), F.col("stats_5m.velocity").alias("velocity"))


@query(
    "window_stats_asof",
    f"""WITH {TXN}, probes AS (SELECT payer_vpa, unnest(range(0, 4500000000, 500000000)) AS now FROM (SELECT DISTINCT payer_vpa FROM txn))
        SELECT p.payer_vpa, p.now, count(t.us) AS count, round(coalesce(sum(amount), 0.0), 2) AS sum, round(coalesce(avg(amount), 0.0), 4) AS mean
        FROM probes p LEFT JOIN txn t ON t.payer_vpa = p.payer_vpa AND t.us BETWEEN p.now - 300000000 AND p.now GROUP BY 1, 2""",
)
def window_stats_asof(spark: SparkSession, d: str) -> DataFrame:
    txns = transactions(spark, d)
    probes = txns.select("payer_vpa").distinct().withColumn("now", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4_000_000_000).cast("bigint"), F.lit(500_000_000).cast("bigint"))))
    return windows.stats_asof(txns, probes, "payer_vpa", "5m").select("payer_vpa", "now", "count", F.round("sum", 2).alias("sum"), F.round("mean", 4).alias("mean"))


@query("amount_zscore", f"WITH {WINDOWED} SELECT event_id, round(zraw, 4) AS z FROM z")
def amount_zscore(spark: SparkSession, d: str) -> DataFrame:
    u = windows.user_windows(transactions(spark, d))
    return u.select("event_id", features.amount_zscore(F.col("amount"), F.col("user_amount_mean_1h"), F.col("user_amount_std_1h")).alias("z"))


@query("feature_vector_23", "WITH " + WINDOWED + " SELECT event_id, " + ", ".join({"amount_zscore_1h": "round(zraw, 4)", "is_new_device": "is_new_device::INT"}.get(c, f"round({c} + 1e-7, 3)" if ("mean" in c or "std" in c) else c) + f" AS {c}" for c in FEATURES) + " FROM z")
def feature_vector_23(spark: SparkSession, d: str) -> DataFrame:
    f = features.features(transactions(spark, d))
    return f.select("event_id", *(F.round(F.col(c) + 1e-7, 3).alias(c) if "mean" in c or "std" in c else F.col(c).cast("int").alias(c) if c == "is_new_device" else F.col(c) for c in FEATURES))


@query("rule_decisions", f"WITH {RULED} SELECT event_id, rule_decision, round(rule_score, 6) AS rule_score, array_to_string(list_transform(kept, lambda r: r.n), ',') AS rules, (rule_decision <> 'BLOCK' AND (rule_decision = 'REVIEW' OR rule_score > 0.1)) AS passed_to_ml FROM decided")
def rule_decisions(spark: SparkSession, d: str) -> DataFrame:
    r = ruled(spark, d)
    return r.select("event_id", "rule_decision", F.round("rule_score", 6).alias("rule_score"), F.array_join(F.transform("rule_results", lambda x: x["rule_name"]), ",").alias("rules"), "passed_to_ml")


@query("rule_trigger_histogram", f"WITH {RULED} SELECT h.n AS rule_name, CASE WHEN h.b THEN 'block' ELSE 'review' END AS decision, count(*) AS n FROM (SELECT unnest(kept) AS h FROM decided) GROUP BY 1, 2")
def rule_trigger_histogram(spark: SparkSession, d: str) -> DataFrame:
    r = ruled(spark, d).select(F.explode("rule_results").alias("r"))
    return r.groupBy("r.rule_name", "r.decision").agg(F.count("*").alias("n"))


@query("rule_flags", f"WITH {RULED} SELECT event_id, r1 IS NOT NULL AS transaction_velocity, r2 IS NOT NULL AS amount_velocity, r3 IS NOT NULL AS new_device_high_amount, r4 IS NOT NULL AS geo_velocity, r5 IS NOT NULL AS device_sharing, r6 IS NOT NULL AS high_risk_mcc, r7 IS NOT NULL AS off_hours_high_amount FROM fired")
def rule_flags(spark: SparkSession, d: str) -> DataFrame:
    f = features.features(transactions(spark, d), RuleEngine().reads())
    return f.select("event_id", *(factory(LIMITS).isNotNull().alias(name) for name, factory in RuleEngine().rules))


@query("running_entity_frequency", f"WITH {TXN} SELECT event_id, count(*) OVER (PARTITION BY device_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS freq FROM txn")
def running_entity_frequency(spark: SparkSession, d: str) -> DataFrame:
    return windows.running_frequency(transactions(spark, d), "device_id")


_CELL = "('0x' || substr(sha256(unhex(printf('%08x', r)) || encode(k)), 1, 16))::UBIGINT % 544"
CMS = TXN + f""", keys AS (SELECT device_id AS k, count(*) AS n FROM txn GROUP BY 1), cells AS (SELECT k, n, r, {_CELL} AS c FROM keys, range(7) t(r)),
    sketch AS (SELECT r, c, sum(n)::BIGINT AS cnt FROM cells GROUP BY 1, 2), est AS (SELECT k, min(cnt) AS estimate FROM cells JOIN sketch USING (r, c) GROUP BY 1)"""


@query("cms_cells", f"WITH {CMS} SELECT r::INT AS row, c::INT AS col, cnt FROM sketch")
def cms_cells(spark: SparkSession, d: str) -> DataFrame:
    return SKETCH.build(transactions(spark, d), "device_id")


@query("cms_estimates", f"WITH {CMS} SELECT k AS device_id, estimate FROM est")
def cms_estimates(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    return SKETCH.query(SKETCH.build(t, "device_id"), t, "device_id")


@query("cms_asof_estimates", f"WITH {TXN}, each AS (SELECT event_id, us, r, {_CELL.replace('encode(k)', 'encode(device_id)')} AS c FROM txn, range(7) t(r)), seen AS (SELECT event_id, count(*) OVER (PARTITION BY r, c ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS n FROM each) SELECT event_id, min(n) AS estimate FROM seen GROUP BY 1")
def cms_asof_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The sketch's estimate for each event's device at that event."""
    return SKETCH.asof(transactions(spark, d), "device_id")


@query("cms_heavy_hitters", f"WITH {CMS} SELECT k AS device_id, estimate FROM est WHERE estimate > 0.011 * (SELECT count(*) FROM txn)")
def cms_heavy_hitters(spark: SparkSession, d: str) -> DataFrame:
    return SKETCH.heavy_hitters(transactions(spark, d), "device_id", 0.011)


@query("cms_error_check", f"WITH {CMS} SELECT count(*) AS keys, count(*) FILTER (estimate < n) AS under, count(*) FILTER (estimate - n > 0.005 * (SELECT count(*) FROM txn)) AS over FROM est JOIN keys USING (k)")
def cms_error_check(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    exact = t.groupBy("device_id").agg(F.count("*").alias("n"))
    est = SKETCH.query(SKETCH.build(t, "device_id"), t, "device_id").join(exact, "device_id").crossJoin(F.broadcast(t.agg(F.count("*").alias("total"))))
    return est.agg(F.count("*").alias("keys"), F.count_if(F.col("estimate") < F.col("n")).alias("under"), F.count_if(F.col("estimate") - F.col("n") > SKETCH.epsilon * F.col("total")).alias("over"))


@query("ts_range_scan", f"WITH {TXN} SELECT us, transaction_id FROM txn WHERE us BETWEEN 1000000000 AND 1500000000")
def ts_range_scan(spark: SparkSession, d: str) -> DataFrame:
    return index.range_query(transactions(spark, d), 1_000_000_000, 1_500_000_000, order=["event_id"]).select("us", "transaction_id")


@query("ts_point_lookup", f"WITH {TXN} SELECT us, transaction_id FROM txn WHERE us = (SELECT us FROM txn WHERE event_id = 77)")
def ts_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    at = t.filter("event_id = 77").select(F.col("us").alias("at"))
    return t.join(F.broadcast(at), F.col("us") == F.col("at"), "left_semi").select("us", "transaction_id")


@query("index_delete", f"WITH {TXN} SELECT us, transaction_id FROM txn WHERE event_id % 3 <> 0")
def index_delete(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d).withColumn("seq", F.col("event_id"))
    return index.delete_entries(t, t.filter("event_id % 3 = 0").select("us", "transaction_id"), ["us", "transaction_id"]).select("us", "transaction_id")


@query("index_stats", f"WITH {TXN} SELECT count(*) AS size, min(us) AS min_key, max(us) AS max_key, count(DISTINCT payer_vpa) AS users, count(DISTINCT device_id) AS devices, count(DISTINCT payee_vpa) AS merchants FROM txn")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return index.index_stats(transactions(spark, d))


_POSTED = TXN + ", p AS (SELECT payer_vpa, transaction_id, row_number() OVER (PARTITION BY payer_vpa ORDER BY us DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY payer_vpa) AS n FROM txn)"


@query("posting_lists", f"WITH {_POSTED} SELECT payer_vpa, string_agg(transaction_id, ',' ORDER BY back DESC) AS items, max(n) AS n_inserted FROM p WHERE back <= CASE WHEN n <= 50 THEN n ELSE 26 + (n - 51) % 25 END GROUP BY 1")
def posting_lists(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(transactions(spark, d), "payer_vpa", "transaction_id", ["us", "event_id"], 50).select("payer_vpa", F.array_join("items", ",").alias("items"), "n_inserted")


@query("posting_capped_length", f"WITH {TXN} SELECT device_id, (CASE WHEN n <= 20 THEN n ELSE 11 + (n - 21) % 10 END)::BIGINT AS kept FROM (SELECT device_id, count(*) AS n FROM txn GROUP BY 1)")
def posting_capped_length(spark: SparkSession, d: str) -> DataFrame:
    lists = index.postings(transactions(spark, d), "device_id", "transaction_id", ["us", "event_id"], 20)
    return lists.select("device_id", F.size("items").cast("bigint").alias("kept"))


@query("posting_recent_n", f"WITH {_POSTED} SELECT payer_vpa, transaction_id FROM p WHERE back <= 3")
def posting_recent_n(spark: SparkSession, d: str) -> DataFrame:
    return windows.recent(transactions(spark, d), "payer_vpa", 3, ["us", "event_id"]).select("payer_vpa", "transaction_id")


_KV = TXN + ", newest AS (SELECT device_id AS key, max(event_id) AS seq, max_by(transaction_id, event_id) AS value, max_by(is_fraud, event_id) AS deleted FROM txn GROUP BY 1)"


def entries(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).select(F.col("device_id").alias("key"), F.col("event_id").alias("seq"), F.col("transaction_id").alias("value"), F.col("is_fraud").alias("deleted"))


@query("kv_latest_wins", f"WITH {_KV} SELECT key, seq, value FROM newest WHERE NOT deleted")
def kv_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return kv.compact(entries(spark, d))


@query("kv_compaction", f"WITH {_KV} SELECT key, seq, value FROM newest WHERE NOT deleted")
def kv_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Four runs merged pairwise, then compacted: the same as all at once."""
    e = entries(spark, d)
    runs = [e.filter(F.col("seq") % 4 == k) for k in range(4)]
    return kv.compact(kv.merge_runs(kv.merge_runs(*runs[:2]), kv.merge_runs(*runs[2:])))


@query("kv_point_get", f"WITH {_KV} SELECT key, seq, value FROM newest WHERE NOT deleted AND key = 'dev_7'")
def kv_point_get(spark: SparkSession, d: str) -> DataFrame:
    return kv.get(entries(spark, d), "dev_7")


@query(
    "feature_store_ttl_lookup",
    f"""WITH {TXN}, s AS (SELECT payer_vpa, us, event_id FROM txn WHERE event_id % 2 = 0), p AS (SELECT payer_vpa, us AS now, event_id AS probe FROM txn WHERE event_id % 2 = 1)
        SELECT p.payer_vpa, p.now, p.probe, CASE WHEN p.now - max(s.us) <= 60000000 THEN arg_max(s.event_id, (s.us, s.event_id)) END AS value
        FROM p LEFT JOIN s ON s.payer_vpa = p.payer_vpa AND s.us <= p.now GROUP BY 1, 2, 3""",
)
def feature_store_ttl_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    store = t.filter("event_id % 2 = 0").select("payer_vpa", "us", F.col("event_id").alias("value"))
    probes = t.filter("event_id % 2 = 1").select("payer_vpa", F.col("us").alias("now"), F.col("event_id").alias("probe"))
    return kv.ttl_lookup(store, probes, "payer_vpa", 60_000_000)


_SCORE = "((event_id * 7919) % 1000) / 1000.0"


def scored(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d).withColumn("score", F.expr("cast((event_id * 7919) % 1000 as double) / 1000.0D"))
    return t.withColumns({"decision": scoring.threshold(F.col("score")), "latency_ms": F.expr("cast((event_id * 104729) % 5000 as double) / 100.0D")})


SCORED = TXN + f", scored AS (SELECT *, {_SCORE} AS score, CASE WHEN {_SCORE} >= 0.9 THEN 'BLOCK' WHEN {_SCORE} >= 0.7 THEN 'REVIEW' ELSE 'PASS' END AS decision, ((event_id * 104729) % 5000) / 100.0 AS latency_ms FROM txn)"


@query(
    "dedup_alerts",
    f"""WITH RECURSIVE {SCORED}, e AS (SELECT payer_vpa, CASE WHEN score >= 0.9 THEN 'AUTO_BLOCK' ELSE 'REVIEW_FLAGGED' END AS alert_type, us, event_id, row_number() OVER (PARTITION BY payer_vpa, score >= 0.9 ORDER BY us, event_id) AS k FROM scored WHERE NOT (score < 0.7 AND decision = 'PASS')),
        walk AS (SELECT payer_vpa, alert_type, k, us, event_id, us AS last, true AS fires FROM e WHERE k = 1
                 UNION ALL SELECT e.payer_vpa, e.alert_type, e.k, e.us, e.event_id, CASE WHEN e.us - w.last >= 300000000 THEN e.us ELSE w.last END, e.us - w.last >= 300000000 FROM walk w JOIN e ON e.payer_vpa = w.payer_vpa AND e.alert_type = w.alert_type AND e.k = w.k + 1)
        SELECT event_id, payer_vpa, alert_type, us FROM walk WHERE fires""",
)
def dedup_alerts(spark: SparkSession, d: str) -> DataFrame:
    e = alerts.eligible(scored(spark, d)).select("event_id", "payer_vpa", "alert_type", "us")
    return alerts.dedup(e, ["payer_vpa", "alert_type"])


@query("alert_eligibility", f"WITH {SCORED} SELECT CASE WHEN score >= 0.9 THEN 'AUTO_BLOCK' ELSE 'REVIEW_FLAGGED' END AS alert_type, count(*) AS n FROM scored WHERE NOT (score < 0.7 AND decision = 'PASS') GROUP BY 1")
def alert_eligibility(spark: SparkSession, d: str) -> DataFrame:
    return alerts.eligible(scored(spark, d)).groupBy("alert_type").agg(F.count("*").alias("n"))


_DRIFT = TXN + """, base AS (SELECT amount, us::DOUBLE AS us FROM txn WHERE event_id % 2 = 0), cur AS (SELECT amount * 1.3 AS amount, us::DOUBLE AS us FROM txn WHERE event_id % 2 = 1),
    b AS (SELECT unnest(['amount', 'us']) AS feature, unnest([amount, us]) AS x FROM base), c AS (SELECT unnest(['amount', 'us']) AS feature, unnest([amount, us]) AS x FROM cur),
    ref AS (SELECT feature, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges, avg(x) AS mean, stddev_pop(x) + 1e-8 AS std FROM b GROUP BY 1),
    hb AS (SELECT feature, len(list_filter(edges, lambda e: e <= x)) AS bin, count(*) AS n FROM b JOIN ref USING (feature) GROUP BY 1, 2), hc AS (SELECT feature, len(list_filter(edges, lambda e: e <= x)) AS bin, count(*) AS n FROM c JOIN ref USING (feature) GROUP BY 1, 2),
    grid AS (SELECT feature, r AS bin FROM ref, range(10) t(r)),
    shares AS (SELECT g.feature, g.bin, greatest(coalesce(hb.n, 0) / sum(hb.n) OVER (PARTITION BY g.feature), 1e-4) AS e, greatest(coalesce(hc.n, 0) / sum(hc.n) OVER (PARTITION BY g.feature), 1e-4) AS a
               FROM grid g LEFT JOIN hb ON hb.feature = g.feature AND hb.bin = g.bin LEFT JOIN hc ON hc.feature = g.feature AND hc.bin = g.bin),
    scaled AS (SELECT feature, e / sum(e) OVER (PARTITION BY feature) AS e, a / sum(a) OVER (PARTITION BY feature) AS a FROM shares),
    psi AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM scaled GROUP BY 1),
    rep AS (SELECT p.feature, psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.2 THEN 'monitor' ELSE 'alert' END AS status, ((SELECT avg(x) FROM c WHERE c.feature = p.feature) - mean) / std AS mean_shift FROM psi p JOIN ref USING (feature))"""


def drift_report(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d).select("event_id", "amount", F.col("us").cast("double").alias("us"))
    return drift.report(t.filter("event_id % 2 = 0"), t.filter("event_id % 2 = 1").withColumn("amount", F.col("amount") * 1.3), ["amount", "us"])


@query("psi_by_feature", f"WITH {_DRIFT} SELECT feature, round(psi, 6) AS psi, status, round(mean_shift, 6) AS mean_shift FROM rep")
def psi_by_feature(spark: SparkSession, d: str) -> DataFrame:
    return drift_report(spark, d).select("feature", F.round("psi", 6).alias("psi"), "status", F.round("mean_shift", 6).alias("mean_shift"))


@query("top_drifted", f"WITH {_DRIFT} SELECT feature, round(psi, 6) AS psi FROM rep ORDER BY rep.psi DESC LIMIT 1")
def top_drifted(spark: SparkSession, d: str) -> DataFrame:
    return drift.top_drifted(drift_report(spark, d), 1).select("feature", F.round("psi", 6).alias("psi"))


@query("psi_status_counts", f"WITH {_DRIFT} SELECT count(*) FILTER (status = 'alert') AS alert, count(*) FILTER (status = 'monitor') AS monitor, count(*) FILTER (status = 'stable') AS stable FROM rep")
def psi_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return drift.status_counts(drift_report(spark, d))


@query("psi_alerts", f"WITH {_DRIFT} SELECT round(max(psi) FILTER (feature = 'amount'), 6) AS score_psi, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (feature <> 'amount' AND psi >= 0.2), '') AS features, coalesce(max(psi) FILTER (feature = 'amount'), 0) >= 0.1 OR count(*) FILTER (feature <> 'amount' AND psi >= 0.2) > 0 AS alert FROM rep")
def psi_alerts(spark: SparkSession, d: str) -> DataFrame:
    return drift.overall(drift_report(spark, d), "amount").select(F.round("score_psi", 6).alias("score_psi"), F.array_join("features", ",").alias("features"), "alert")


@query("normalizer_stats", f"WITH {TXN} SELECT 'amount' AS feature, round(avg(amount), 4) AS mean, round(stddev_pop(amount), 4) AS std FROM txn UNION ALL SELECT 'device_age_hours', round(avg(device_age_hours), 4), round(stddev_pop(device_age_hours), 4) FROM txn")
def normalizer_stats(spark: SparkSession, d: str) -> DataFrame:
    return drift.normalizer(transactions(spark, d), ["amount", "device_age_hours"]).select("feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("normalize_rows", f"WITH {TXN} SELECT event_id, round((amount - (SELECT avg(amount) FROM txn)) / ((SELECT stddev_pop(amount) FROM txn) + 1e-8), 5) AS amount FROM txn")
def normalize_rows(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    return drift.normalize(t, ["amount"], drift.normalizer(t, ["amount"]), ["event_id"]).select("event_id", F.round("amount", 5).alias("amount"))


@query("score_histogram20", f"WITH {SCORED} SELECT r::INT AS bin, count(event_id) AS cnt FROM range(20) t(r) LEFT JOIN scored ON least(floor(score * 20), 19) = r GROUP BY 1")
def score_histogram20(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram_fixed(scored(spark, d), "score")


@query("decision_breakdown", f"WITH {SCORED} SELECT decision, count(*) AS n FROM scored GROUP BY 1")
def decision_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return metrics.decision_counts(scored(spark, d), "decision")


@query("dashboard_kpis", f"WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (decision = 'BLOCK') AS blocked, count(*) FILTER (decision = 'REVIEW') AS review, round(count(*) FILTER (decision = 'BLOCK') / count(*), 6) AS block_rate, round(avg(score), 6) AS avg_score FROM (SELECT * FROM scored ORDER BY us DESC, event_id DESC LIMIT 500)")
def dashboard_kpis(spark: SparkSession, d: str) -> DataFrame:
    return metrics.kpis(scored(spark, d), ["us", "event_id"]).select("n", "blocked", "review", F.round("block_rate", 6).alias("block_rate"), F.round("avg_score", 6).alias("avg_score"))


@query("latency_percentiles", f"WITH {SCORED} SELECT count(*) AS n, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.99) AS p99 FROM (SELECT latency_ms FROM scored ORDER BY us DESC, event_id DESC LIMIT 10000)")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latencies(scored(spark, d), "latency_ms", ["us", "event_id"])


@query(
    "roc_auc",
    f"""WITH {SCORED}, g AS (SELECT score, sum(is_fraud::INT) AS p, sum(1 - is_fraud::INT) AS q FROM scored GROUP BY 1), r AS (SELECT p, q, coalesce(sum(p) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g)
        SELECT round(sum(q * b + p * q / 2) / (sum(p) * sum(q)), 8) AS auc, sum(p)::BIGINT AS positives, sum(q)::BIGINT AS negatives FROM r""",
)
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auc(scored(spark, d), "score", "is_fraud").select(F.round("auc", 8).alias("auc"), "positives", "negatives")


@query(
    "confusion_metrics",
    f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (score >= 0.5 AND is_fraud) AS tp, count(*) FILTER (score >= 0.5 AND NOT is_fraud) AS fp, count(*) FILTER (score < 0.5 AND is_fraud) AS fn, count(*) FILTER (score < 0.5 AND NOT is_fraud) AS tn FROM scored),
        p AS (SELECT *, tp / (tp + fp + 1e-8) AS pr, tp / (tp + fn + 1e-8) AS re FROM c) SELECT tp, fp, fn, tn, round(pr, 8) AS precision, round(re, 8) AS recall, round(2 * pr * re / (pr + re + 1e-8), 8) AS f1 FROM p""",
)
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(scored(spark, d), "score", "is_fraud").select("tp", "fp", "fn", "tn", *(F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")))


@query(
    "loss_means",
    f"""WITH {SCORED}, q AS (SELECT greatest(1e-7, least(1 - 1e-7, score)) AS p, is_fraud AS y FROM scored), r AS (SELECT CASE WHEN y THEN p ELSE 1 - p END AS pt, CASE WHEN y THEN 0.25 ELSE 0.75 END AS a FROM q)
        SELECT round(avg(-ln(pt)), 8) AS bce, round(avg(-a * (1 - pt) ** 2 * ln(pt)), 8) AS focal FROM r""",
)
def loss_means(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("is_fraud").cast("int")
    return scored(spark, d).agg(F.round(F.avg(metrics.bce(F.col("score"), y)), 8).alias("bce"), F.round(F.avg(metrics.focal(F.col("score"), y)), 8).alias("focal"))


@query("class_weights", f"WITH {TXN} SELECT count(*) AS n, sum(is_fraud::INT)::BIGINT AS positives, round(sum(is_fraud::INT) / count(*), 8) AS fraud_rate, round(count(*) / (2 * (count(*) - sum(is_fraud::INT))), 8) AS weight_0, round(count(*) / (2 * sum(is_fraud::INT)), 8) AS weight_1 FROM txn")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    w = metrics.class_weights(transactions(spark, d), "is_fraud")
    return w.select("n", "positives", *(F.round(c, 8).alias(c) for c in ("fraud_rate", "weight_0", "weight_1")))


@query("stratified_subsample", f"WITH {TXN} SELECT event_id, is_fraud FROM txn WHERE is_fraud UNION ALL SELECT event_id, is_fraud FROM (SELECT * FROM txn WHERE NOT is_fraud ORDER BY (event_id * 7919) % 100003, event_id LIMIT (SELECT 2 * count(*) FROM txn WHERE is_fraud))")
def stratified_subsample(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d).withColumn("shuffled", F.expr("(event_id * 7919) % 100003"))
    return metrics.stratified(t, "is_fraud", ["shuffled", "event_id"], 2).select("event_id", "is_fraud")


@query("bin_features", f"WITH {TXN}, e AS (SELECT quantile_cont(amount, list_transform(range(1, 16), lambda k: k / 16.0)) AS edges FROM txn) SELECT event_id, len(list_filter(edges, lambda x: x <= amount))::INT AS amount FROM txn, e")
def bin_features(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bin_features(transactions(spark, d), ["amount"], ["event_id"], 16)


@query("positional_split", f"WITH {TXN} SELECT event_id, row_number() OVER (ORDER BY us, event_id) <= floor(0.8 * count(*) OVER ()) AS train FROM txn")
def positional_split(spark: SparkSession, d: str) -> DataFrame:
    return metrics.split_positional(transactions(spark, d), ["us", "event_id"]).select("event_id", "train")


@query("drift_windows", f'WITH {TXN} SELECT "window"::BIGINT AS "window", count(*) AS n, min(us) AS first FROM (SELECT us, (row_number() OVER (ORDER BY us, event_id) - 1) // 500 AS "window" FROM txn) GROUP BY 1')
def drift_windows(spark: SparkSession, d: str) -> DataFrame:
    return drift.windows_of(transactions(spark, d), ["us", "event_id"]).groupBy("window").agg(F.count("*").alias("n"), F.min("us").alias("first"))


@query("identity_left_join", "SELECT o_orderkey, o_custkey, c_name AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def identity_left_join(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet")
    return orders.join(customer.filter("c_custkey % 2 = 0"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_custkey", F.col("c_name").alias("name"))


@query("timing_regularity", f"WITH {TXN}, g AS (SELECT device_id, (us - lag(us) OVER (PARTITION BY device_id ORDER BY us, event_id)) / 1000000.0 AS gap FROM txn) SELECT device_id, count(gap) AS n_gaps, CASE WHEN count(gap) >= 2 THEN round(stddev_pop(gap) / avg(gap), 6) END AS regularity FROM g GROUP BY 1")
def timing_regularity(spark: SparkSession, d: str) -> DataFrame:
    return windows.timing_regularity(transactions(spark, d), "device_id").select("device_id", "n_gaps", F.round("regularity", 6).alias("regularity"))


def _unit(attack: str) -> str:
    return f"((i * 7919 + {len(attack)} * 104729) % 10007) / 10007.0"


_SPLIT_SUM = sum(0.5 + ((k * 7919 + len("amount_splitting") * 104729) % 10007) / 10007.0 for k in range(8))
SUITE = f"""suite AS (SELECT 'velocity' AS attack, i, 4500 - 50 + 100 * {_unit("velocity")} AS amount, i * 30.0 AS s FROM range(30) t(i)
    UNION ALL SELECT 'device_farm', i, 500 + 1500 * {_unit("device_farm")}, i * 20.0 FROM range(150) t(i)
    UNION ALL SELECT 'low_and_slow', i, greatest(100, (500 + 49500 * (i // 4 / 4.0) ** 2) * (0.9 + 0.2 * {_unit("low_and_slow")})), i // 4 * 86400.0 + i % 4 * 21600 FROM range(20) t(i)
    UNION ALL SELECT 'amount_splitting', i, round((0.5 + {_unit("amount_splitting")}) / {_SPLIT_SUM!r} * 100000, 2), i * 21600.0 FROM range(8) t(i)
    UNION ALL SELECT 'geo_spoofing', i, 500 + 4500 * {_unit("geo_spoofing")}, i * 3660.0 FROM range(20) t(i)
    UNION ALL SELECT 'bot', i, 999 + (i % 3) * 0.01, i * 60.0 FROM range(40) t(i))"""


@query("attack_suite", f"WITH {SUITE} SELECT attack, i AS step, round(amount, 2) AS amount, (s * 1000000)::BIGINT AS us FROM suite")
def attack_suite(spark: SparkSession, d: str) -> DataFrame:
    return attacks.suite(spark).select("attack", "step", F.round("amount", 2).alias("amount"), "us")


@query(
    "attack_suite_report",
    f"""WITH {SUITE}, s AS (SELECT coalesce(attack, 'ALL') AS attack, CASE WHEN least(1.0, amount / 5000) >= 0.9 THEN 'BLOCK' WHEN least(1.0, amount / 5000) >= 0.7 THEN 'REVIEW' ELSE 'PASS' END AS decision, (i % 7 + 1) / 10.0 AS latency_ms FROM suite),
        a AS (SELECT * FROM s UNION ALL SELECT 'ALL', decision, latency_ms FROM s)
        SELECT attack, count(*) AS n, count(*) FILTER (decision = 'BLOCK') AS blocked, count(*) FILTER (decision = 'REVIEW') AS reviewed, count(*) FILTER (decision = 'PASS') AS passed, round(count(*) FILTER (decision <> 'PASS') / count(*), 6) AS detection_rate,
               round(count(*) FILTER (decision = 'BLOCK') / count(*), 6) AS block_rate, round(avg(latency_ms), 6) AS avg_latency_ms, quantile_disc(latency_ms, 0.99) AS p99_latency_ms FROM a GROUP BY 1""",
)
def attack_suite_report(spark: SparkSession, d: str) -> DataFrame:
    score = lambda df: df.withColumns({"decision": scoring.threshold(F.least(F.lit(1.0), F.col("amount") / 5000)), "latency_ms": (F.col("step") % 7 + 1) / F.lit(10.0)})
    rep = attacks.run(spark, score)
    return rep.select("attack", "n", "blocked", "reviewed", "passed", *(F.round(c, 6).alias(c) for c in ("detection_rate", "block_rate", "avg_latency_ms")), "p99_latency_ms")


@query("attack_split_totals", f"WITH {SUITE} SELECT round(sum(amount), 1) AS total, count(*) AS n FROM suite WHERE attack = 'amount_splitting'")
def attack_split_totals(spark: SparkSession, d: str) -> DataFrame:
    return attacks.suite(spark).filter("attack = 'amount_splitting'").agg(F.round(F.sum("amount"), 1).alias("total"), F.count("*").alias("n"))


@query("audit_stats", f"WITH {SCORED} SELECT coalesce(decision, 'ALL') AS decision, count(*) AS n, count(*) FILTER (event_id % 5 = 0) AS shadow FROM scored GROUP BY ROLLUP (decision)")
def audit_stats(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.registry import audit_stats as stats

    return stats(scored(spark, d).withColumn("shadow_mode", F.col("event_id") % 5 == 0))


@query("audit_latest", f"WITH {SCORED} SELECT payer_vpa AS transaction_id, max_by(decision, event_id) AS decision, max(event_id) AS seq FROM scored GROUP BY 1")
def audit_latest(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.registry import audit_latest as latest

    return latest(scored(spark, d).select(F.col("payer_vpa").alias("transaction_id"), "decision", F.col("event_id").alias("seq")), "seq")


TREE = {"feature": 0, "threshold": 20_000.0, "left": {"feature": 1, "threshold": 100.0, "left": {"value": -0.4}, "right": {"value": -0.1}}, "right": {"feature": 1, "threshold": 4000.0, "left": {"value": 0.7}, "right": {"value": 0.2}}}
_TREE_SQL = "CASE WHEN amount <= 20000.0 THEN CASE WHEN device_age_hours <= 100.0 THEN -0.4 ELSE -0.1 END ELSE CASE WHEN device_age_hours <= 4000.0 THEN 0.7 ELSE 0.2 END END"


@query("tree_score", f"WITH {TXN} SELECT event_id, round(1 / (1 + exp(-(-1.0 + 0.1 * {_TREE_SQL}))), 8) AS score FROM txn")
def tree_score(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.models import GBT

    model = GBT()
    model.start, model.trees, model.d = -1.0, [TREE], 2
    return transactions(spark, d).select("event_id", F.round(model.column(["amount", "device_age_hours"]), 8).alias("score"))


@query("ensemble_blend", f"WITH {SCORED} SELECT event_id, round(0.4 * score + 0.6 * (1 / (1 + exp(-{_TREE_SQL}))), 6) AS risk, CASE WHEN event_id % 2 = 0 THEN 'PASS' ELSE decision END AS enforced FROM scored")
def ensemble_blend(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.scalar import sigmoid
    from ..operators.models import tree_column

    s = scored(spark, d)
    return s.select("event_id", F.round(scoring.fuse(F.col("score"), sigmoid(tree_column(TREE, ["amount", "device_age_hours"]))), 6).alias("risk"), F.when(F.col("event_id") % 2 == 0, scoring.enforced(F.col("decision"), "shadow")).otherwise(scoring.enforced(F.col("decision"), "live")).alias("enforced"))


@query("ewma_by_user", f"WITH {TXN} SELECT payer_vpa, round(list_reduce(list(amount ORDER BY us, event_id), lambda a, x: a * 0.95 + x * 0.05), 4) AS ewma FROM txn GROUP BY 1")
def ewma_by_user(spark: SparkSession, d: str) -> DataFrame:
    return windows.ewma_last(transactions(spark, d), "payer_vpa", "amount", "us", "event_id").select("payer_vpa", F.round("ewma", 4).alias("ewma"))


@query("crc_verify_log", f"WITH {TXN} SELECT count(*) AS n, count(*) FILTER (event_id % 50 = 0) AS broken FROM txn")
def crc_verify_log(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.scalar import crc_matches

    log = transactions(spark, d).select("event_id", F.to_json(F.struct("transaction_id", "amount")).cast("binary").alias("payload")).withColumn("crc", F.crc32("payload"))
    log = log.withColumn("payload", F.when(F.col("event_id") % 50 == 0, F.concat("payload", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("payload")))  # every fiftieth record is damaged
    return log.agg(F.count("*").alias("n"), F.count_if(~crc_matches(F.col("payload"), F.col("crc"))).alias("broken"))


@query("json_roundtrip", f"WITH {TXN} SELECT event_id, payer_vpa, amount FROM txn")
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d).select(F.to_json(F.struct("event_id", "payer_vpa", "amount")).alias("j"))
    return t.select(F.from_json("j", "event_id bigint, payer_vpa string, amount double").alias("r")).select("r.*")


@query("card_normalize", "SELECT 'ieee_' || o_orderkey AS transaction_id, o_totalprice::DOUBLE AS amount, lower(o_orderstatus) AS card_type, 'unknown' AS card_category, -1.0::DOUBLE AS d1, 0.0::DOUBLE AS c1, 'T' AS m1, o_orderkey % 7 = 0 AS is_fraud FROM orders")
def card_normalize(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    raw = o.select(F.col("o_orderkey").alias("TransactionID"), F.col("o_totalprice").cast("string").alias("TransactionAmt"), F.col("o_orderstatus").alias("card4"), F.lit("T").alias("M1"), (F.col("o_orderkey") % 7 == 0).cast("int").alias("isFraud"))
    n = card.normalize(raw)
    return n.select("transaction_id", "amount", "card_type", "card_category", F.element_at("timedelta_features", F.lit("D1")).alias("d1"), F.element_at("count_features", F.lit("C1")).alias("c1"), F.element_at("match_features", F.lit("M1")).alias("m1"), "is_fraud")


@query("decide_end_to_end", f"WITH {RULED} SELECT event_id, round(CASE WHEN stop > 0 THEN 1.0 ELSE rule_score END, 4) AS risk_score, CASE WHEN stop > 0 THEN 'BLOCK' WHEN rule_score >= 0.9 THEN 'BLOCK' WHEN rule_score >= 0.7 THEN 'REVIEW' ELSE 'PASS' END AS decision FROM decided")
def decide_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.decide(transactions(spark, d), engine=RuleEngine(LIMITS), vectors=False)
    return out.select("event_id", F.col("score").alias("risk_score"), "decision")


@query("quality_label_auc", """WITH s AS (SELECT quality AS y, (doc_id * 7919 % 101) / 101.0 AS score FROM labels WHERE quality IS NOT NULL), g AS (SELECT score, sum(y) AS p, sum(1 - y) AS q FROM s GROUP BY 1), r AS (SELECT p, q, coalesce(sum(p) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g)
    SELECT round(sum(q * b + p * q / 2) / (sum(p) * sum(q)), 8) AS auc, sum(p)::BIGINT AS positives, sum(q)::BIGINT AS negatives FROM r""")
def quality_label_auc(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/labels.parquet").filter("quality IS NOT NULL").select("quality", F.expr("cast(doc_id * 7919 % 101 as double) / 101.0D").alias("score"))
    return metrics.auc(rows, "score", "quality").select(F.round("auc", 8).alias("auc"), "positives", "negatives")


@query("stream_user_windows", ORACLE["user_window_features"].replace("round(user_amount_std_1h, 4)", "round(user_amount_std_1h, 3)"))
def stream_user_windows(spark: SparkSession, d: str) -> DataFrame:
    got = stateful.run_to_files(stateful.rolling_user_windows(transaction_stream(spark, d)), shared_path(spark, "stream-windows"))
    return got.select("event_id", *(f"user_txn_count_{k}" for k in windows.LENGTHS), F.round("user_amount_mean_1h", 4).alias("mean_1h"), F.round("user_amount_std_1h", 3).alias("std_1h"), F.col("user_amount_max_24h").alias("max_24h"))


@query("stream_anchored_dedup", ORACLE["dedup_alerts"].replace("SELECT event_id, payer_vpa, alert_type, us FROM walk", 'SELECT event_id, payer_vpa AS "user", alert_type, us FROM walk'))
def stream_anchored_dedup(spark: SparkSession, d: str) -> DataFrame:
    t = transaction_stream(spark, d).withColumn("score", F.expr("cast((event_id * 7919) % 1000 as double) / 1000.0D"))
    e = alerts.eligible(t.withColumn("decision", scoring.threshold(F.col("score")))).select("event_id", "us", F.col("payer_vpa").alias("user"), "alert_type")
    return stateful.run_to_files(stateful.anchored_dedup(e, alerts.WINDOW_S * windows.SECOND), shared_path(spark, "stream-dedup"))


@query("stream_sketch_cells", ORACLE["cms_cells"])
def stream_sketch_cells(spark: SparkSession, d: str) -> DataFrame:
    return stateful.run_complete(stateful.running_sketch(transaction_stream(spark, d), "device_id", SKETCH), shared_path(spark, "stream-sketch"))


@query("shap_linear_model", f"WITH {TXN} SELECT event_id, round(amount / 10000 - 2 * device_age_hours / 10000 + 0.5 * (event_id % 33 = 0)::INT, 6) AS prediction, 0.0::DOUBLE AS gap FROM txn")
def shap_linear_model(spark: SparkSession, d: str) -> DataFrame:
    """Attributions of a linear model add up to its score less the base rate."""
    import numpy as np

    from ..operators.explain import KernelExplainer, explain

    w = np.array([1.0, -2.0, 0.5])
    background = np.stack([np.linspace(0, 4, 50), np.linspace(0.8, 0, 50), np.arange(50) % 2], axis=1)
    vectors = transactions(spark, d).select("event_id", F.array(F.col("amount") / 10000, F.col("device_age_hours") / 10000, F.col("is_new_device").cast("double")).alias("vector"))
    values = explain(vectors, KernelExplainer(lambda x: x @ w, background, 32), ["amount", "age", "new"])
    return values.groupBy("event_id").agg(F.round(F.first("prediction"), 6).alias("prediction"), F.abs(F.round(F.first("prediction") - F.first("baseline") - F.sum("value"), 6)).alias("gap"))


@query("model_decisions")
def model_decisions(spark: SparkSession, d: str, sample: int = 2_000) -> DataFrame:
    """The whole decision with an ensemble of both models, trained on a bounded sample: the first `sample` rows in a hashed order. Features
    are taken once, for the sample and for the decisions."""
    import numpy as np

    from ..operators.models import GBT, MLP, Ensemble, score

    t = stored(features.features(transactions(spark, d)), "features")
    f = t.select("event_id", features.vector().alias("vector"), F.col("is_fraud").cast("int").alias("y"))
    rows = metrics.reservoir(f, sample, 42, "event_id").collect()
    x, y = np.array([r["vector"] for r in rows]), np.array([r["y"] for r in rows])
    mlp, gbt = MLP(x.shape[1], (16, 8)), GBT(10, depth=3)
    model = Ensemble(mlp, gbt)
    model.fit_normalizer(x)
    mlp.fit(model.normalize(x), y, epochs=3)
    gbt.fit(x, y)
    out = scoring.decide_featured(t, lambda df: score(df, model), RuleEngine(LIMITS), model_version="ensemble")
    return scoring.response(out)


@query("synthetic_transactions")
def synthetic_transactions(spark: SparkSession, d: str) -> DataFrame:
    return generate(spark, 5_000).drop("ts")


@query("audit_roundtrip", f"WITH {SCORED} SELECT decision, count(*) AS n, count(*) AS shadow FROM scored GROUP BY 1 UNION ALL SELECT 'ALL', count(*), count(*) FROM scored")
def audit_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.registry import append_audit, audit_entries, audit_stats, load_audit

    path = shared_path(spark, "audit")
    s = scored(spark, d).withColumns({"vector": F.array("amount", "score"), "rule_score": F.lit(0.0), "ml_score": F.col("score")})
    append_audit(audit_entries(s, "v1", True), path)
    return audit_stats(load_audit(spark, path))


from . import extended, learning, streams, covering  # noqa: E402, F401  registers their queries
