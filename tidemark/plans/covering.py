"""Registered queries of the smaller operators: posting lists, alerts, rule lists, versions, card files, saved ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import alerts, boosting, drift, features, index, metrics
from ..operators.models import GBT
from ..operators.rules import RuleEngine, result
from ..session import shared_path
from ..sources import card
from ..sources.transactions import transactions
from . import scoring
from .catalogue import _DRIFT, LIMITS, RULED, SCORED, TXN, drift_report, query, scored
from .learning import _FEATURES, _FIRST, _training

_LISTED = TXN + ", p AS (SELECT payer_vpa, transaction_id, row_number() OVER (PARTITION BY payer_vpa ORDER BY us DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY payer_vpa) AS n FROM txn), l AS (SELECT * FROM p WHERE back <= CASE WHEN n <= 20 THEN n ELSE 11 + (n - 21) % 10 END)"


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(transactions(spark, d), "payer_vpa", "transaction_id", ["us", "event_id"], 20)


@query("posting_lookup", f"WITH {_LISTED} SELECT who, coalesce(string_agg(transaction_id, ',' ORDER BY back DESC), '') AS items FROM (VALUES ('user1'), ('nobody')) w(who) LEFT JOIN l ON payer_vpa = who GROUP BY 1")
def posting_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A list, and the empty one of an entity that has none."""
    lists = _lists(spark, d)
    both = [index.postings_of(lists, "payer_vpa", who).select(F.lit(who).alias("who"), F.array_join("items", ",").alias("items")) for who in ("user1", "nobody")]
    return both[0].unionByName(both[1])


@query("posting_last_items", f"WITH {_LISTED} SELECT payer_vpa, string_agg(transaction_id, ',' ORDER BY back DESC) FILTER (back <= 5) AS last, count(*) AS n FROM l WHERE payer_vpa <> 'user3' GROUP BY 1")
def posting_last_items(spark: SparkSession, d: str) -> DataFrame:
    """The last five of each list after one entity's was taken out."""
    lists = index.remove_entity(_lists(spark, d), "payer_vpa", "user3")
    return lists.select("payer_vpa", F.array_join(index.recent_of(F.col("items"), 5), ",").alias("last"), F.size(index.recent_of(F.col("items"), 0)).cast("bigint").alias("n"))


@query(
    "alert_counters",
    f"""WITH {SCORED}, e AS (SELECT payer_vpa, us, lag(us) OVER (PARTITION BY payer_vpa, score >= 0.9 ORDER BY us, event_id) AS before FROM scored WHERE NOT (score < 0.7 AND decision = 'PASS'))
        SELECT count(*) AS seen, count(*) FILTER (before IS NULL) AS fired, count(*) FILTER (before IS NOT NULL) AS suppressed FROM e""",
)
def alert_counters(spark: SparkSession, d: str) -> DataFrame:
    """A window longer than all time: each key fires once."""
    e = alerts.eligible(scored(spark, d)).select("event_id", "payer_vpa", "alert_type", "us")
    return alerts.counters(e, alerts.dedup(e, ["payer_vpa", "alert_type"], window_us=1 << 60))


@query("drift_alert_rows", f"WITH {_DRIFT} SELECT 'DRIFT_DETECTED' AS alert_type, 'system' AS user_id, 'MONITOR' AS decision, round(coalesce(max(psi) FILTER (feature = 'amount'), 0), 6) AS risk_score, string_agg(feature, ',') FILTER (feature <> 'amount' AND psi >= 0.2) AS features FROM rep HAVING coalesce(max(psi) FILTER (feature = 'amount'), 0) >= 0.1 OR count(*) FILTER (feature <> 'amount' AND psi >= 0.2) > 0")
def drift_alert_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = alerts.drift_alerts(drift.overall(drift_report(spark, d), "amount"))
    return rows.withColumn("risk_score", F.round("risk_score", 6))


@query("rule_list_changed", f"WITH {RULED} SELECT count(*) FILTER (d = 'BLOCK') AS blocked, count(*) FILTER (d = 'REVIEW') AS review, count(*) FILTER (d = 'PASS') AS passed, count(*) FILTER (d = 'REVIEW') AS needs_review FROM (SELECT CASE WHEN amount > 30000 THEN 'BLOCK' WHEN r4.b THEN 'BLOCK' WHEN r4 IS NOT NULL THEN 'REVIEW' ELSE 'PASS' END AS d FROM fired)")
def rule_list_changed(spark: SparkSession, d: str) -> DataFrame:
    """A list of one standing rule and one that was added, all others removed."""
    engine = RuleEngine(LIMITS)
    for name, _ in list(engine.rules):
        if name != "geo_velocity":
            engine.remove_rule(name)
    engine.add_rule("large", lambda limits: F.when(F.col("amount") > 30_000, result("large", "block", F.lit("large"), 0.9)))
    out = engine.evaluate(features.features(transactions(spark, d)))
    return out.agg(F.count_if("blocked").alias("blocked"), F.count_if(F.col("rule_decision") == "REVIEW").alias("review"), F.count_if(F.col("rule_decision") == "PASS").alias("passed"), F.count_if("needs_review").alias("needs_review"))


@query("version_strings", f"WITH {TXN} SELECT event_id, replace(payee_vpa, 'merchant_', '') || '-' || strftime(ts, '%Y%m%d') || '-' || sha256(transaction_id)[1:4] AS version FROM txn")
def version_strings(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    return t.select("event_id", scalar.version_string(F.replace("payee_vpa", F.lit("merchant_"), F.lit("")), F.col("ts"), F.sha2("transaction_id", 256)).alias("version"))


@query("mcc_labels", f"WITH {TXN} SELECT event_id, CASE merchant_category_code WHEN '5411' THEN 'groceries' WHEN '6051' THEN 'quasi cash' WHEN '7995' THEN 'betting' END AS label FROM txn")
def mcc_labels(spark: SparkSession, d: str) -> DataFrame:
    names = {"5411": "groceries", "6051": "quasi cash", "7995": "betting"}
    return transactions(spark, d).select("event_id", scalar.mcc_label(F.col("merchant_category_code"), names).alias("label"))


@query("gbt_split_shares", f"{_FIRST} SELECT ({_FEATURES})[f + 1] AS feature, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM every WHERE f IS NOT NULL GROUP BY f")
def gbt_split_shares(spark: SparkSession, d: str) -> DataFrame:
    """Feature importance of one boosted tree over all events: each feature's share of splits."""
    model, _, _ = boosting.fit(_training(spark, d), _FEATURES, "y", "event_id", GBT(n_trees=1, depth=2, subsample=1.0, colsample=1.0), 8)
    rows = [(f, round(float(x), 6)) for f, x in zip(_FEATURES, model.feature_importance(), strict=True) if x]
    return spark.createDataFrame(rows, "feature string, share double")


@query("card_files", "SELECT 'ieee_' || o_orderkey AS transaction_id, round(o_totalprice::DOUBLE, 2) AS amount, c_mktsegment AS device_type, round(o_totalprice::DOUBLE + 2 - 4, 2) AS total, 33::BIGINT AS width FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def card_files(spark: SparkSession, d: str) -> DataFrame:
    """Orders and customers as the adapter's two CSV files, read, joined and made vectors of 33 numbers."""
    path = shared_path(spark, "card-files")
    o, c = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet").filter("c_custkey % 2 = 0")
    main = o.select(F.col("o_orderkey").alias("TransactionID"), F.col("o_totalprice").cast("double").alias("TransactionAmt"), F.lit("visa").alias("card4"), F.lit(2).alias("C1"), F.lit("F").alias("M1"), F.lit("x").alias("unwanted"))
    main.write.option("header", True).csv(f"{path}/transactions")
    known = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("TransactionID"), F.col("c_mktsegment").alias("DeviceType"))
    known.write.option("header", True).csv(f"{path}/identity")
    n = card.normalize(card.load(spark, f"{path}/transactions", f"{path}/identity"))
    v = card.vector(n)
    return n.select("transaction_id", F.round("amount", 2).alias("amount"), "device_type", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 2).alias("total"), F.size(v).cast("bigint").alias("width"))


_NETWORK = "1 / (1 + exp(-(0.5 * (amount - 10000) / 5000 - 0.25 * (device_age_hours - 4000) / 2000 + 0.1)))"
_TREE = "CASE WHEN amount <= 20000.0 THEN -0.4 ELSE 0.7 END"


@query("saved_ensemble_of_both", f"WITH {TXN} SELECT event_id, round(0.4 * {_NETWORK} + 0.6 / (1 + exp(-(-1.0 + 0.1 * {_TREE}))), 8) AS score, round({_NETWORK}, 4) AS alone FROM txn")
def saved_ensemble_of_both(spark: SparkSession, d: str) -> DataFrame:
    """Network, trees and normaliser written and read again, scored as a batch; and the network on its own."""
    import tempfile

    import numpy as np

    from ..operators.models import MLP, Ensemble, score

    gbt, mlp = GBT(), MLP(2, ())
    gbt.start, gbt.trees, gbt.d = -1.0, [{"feature": 0, "threshold": 20_000.0, "left": {"value": -0.4}, "right": {"value": 0.7}}], 2
    mlp.layers[0].params = {"w": np.array([[0.5], [-0.25]]), "b": np.array([0.1])}
    both = Ensemble(mlp, gbt)
    both.mean, both.std = np.array([10_000.0, 4_000.0]), np.array([5_000.0, 2_000.0])
    with tempfile.TemporaryDirectory() as folder:  # the driver's own; executors get the model by broadcast
        both.save(folder)
        again = Ensemble.load(folder)
    rows = transactions(spark, d).select("event_id", F.array("amount", "device_age_hours").alias("vector"))
    alone = Ensemble(again.mlp)
    alone.mean, alone.std = again.mean, again.std
    return score(score(rows, again), alone, name="alone").select("event_id", F.round("ml_score", 8).alias("score"), F.round("alone", 4).alias("alone"))


@query("audit_entries_of_transactions", f"WITH {SCORED} SELECT transaction_id, count(*) AS n, string_agg(decision, ',' ORDER BY event_id) AS decisions FROM scored WHERE transaction_id IN ('txn_0', 'txn_7') GROUP BY 1")
def audit_entries_of_transactions(spark: SparkSession, d: str) -> DataFrame:
    log = scored(spark, d).select("event_id", "transaction_id", "decision")
    got = [scoring.audit_response(log, t).select(F.lit(t).alias("transaction_id"), F.size("entries").cast("bigint").alias("n"), F.array_join(F.transform(F.array_sort("entries"), lambda e: e["decision"]), ",").alias("decisions")) for t in ("txn_0", "txn_7")]
    return got[0].unionByName(got[1])


@query("decisions_by_label", f"WITH {SCORED} SELECT decision, is_fraud, count(*) AS n FROM scored GROUP BY ALL")
def decisions_by_label(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("decision", "is_fraud").agg(F.count("*").alias("n"))


def waiting(messages: DataFrame, acks: DataFrame) -> DataFrame:
    """consumer, waiting, first: for each group of acks(consumer, acked) the messages(offset) after what it has acknowledged last; null is the start."""
    last = acks.groupBy("consumer").agg(F.max("acked").alias("acked"))
    counted = metrics.global_place(messages.select("offset"), ["offset"], "_place")
    # as-of by place: what waits follows from the place of the acknowledged message, no group meets all messages
    at = last.join(counted, F.col("acked") == F.col("offset"), "left").select("consumer", F.coalesce("_place", F.lit(0)).alias("_done"))
    total = messages.agg(F.count("*").alias("_all"))
    found = at.crossJoin(F.broadcast(total)).withColumn("waiting", F.col("_all") - F.col("_done"))
    return found.join(counted, F.col("_place") == F.col("_done") + 1, "left").select("consumer", "waiting", F.col("offset").alias("first"))


@query(
    "queue_groups",
    f"""WITH {TXN}, m AS (SELECT event_id AS o, row_number() OVER (ORDER BY event_id) AS k FROM txn), a AS (SELECT payee_vpa AS consumer, max(event_id) FILTER (is_fraud OR event_id % 3 = 0) - 50 AS acked FROM txn GROUP BY 1)
        SELECT consumer, (SELECT count(*) FROM m WHERE o > coalesce(acked, -1)) AS waiting, (SELECT min(o) FROM m WHERE o > coalesce(acked, -1)) AS first FROM a""",
)
def queue_groups(spark: SparkSession, d: str) -> DataFrame:
    """Events as a queue, merchants as its consumer groups: what each has still to take after the last event that it has acknowledged."""
    t = transactions(spark, d)
    acks = t.groupBy(F.col("payee_vpa").alias("consumer")).agg((F.max(F.when(F.col("is_fraud") | (F.col("event_id") % 3 == 0), F.col("event_id"))) - 50).alias("acked"))
    return waiting(t.select(F.col("event_id").alias("offset")), acks)


@query(
    "model_registry",
    f"""WITH {TXN}, r AS (SELECT payee_vpa AS model_type, event_id AS seq, 'v' || event_id % 50 AS version FROM txn)
        SELECT model_type, count(*) AS registered, count(DISTINCT version) AS versions, arg_max(version, seq) FILTER (seq % 7 = 0) AS active FROM r GROUP BY 1""",
)
def model_registry(spark: SparkSession, d: str) -> DataFrame:
    """Events as registrations of versions, every seventh as an activation: versions by kind and the one that is active."""
    r = transactions(spark, d).select(F.col("payee_vpa").alias("model_type"), F.col("event_id").alias("seq"), F.concat(F.lit("v"), (F.col("event_id") % 50).cast("string")).alias("version"))
    active = F.max_by(F.when(F.col("seq") % 7 == 0, F.col("version")), F.when(F.col("seq") % 7 == 0, F.col("seq")))
    return r.groupBy("model_type").agg(F.count("*").alias("registered"), F.count_distinct("version").alias("versions"), active.alias("active"))
