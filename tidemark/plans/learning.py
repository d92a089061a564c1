"""Registered queries of models that are trained over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting, network
from ..operators.models import GBT, MLP, score
from ..sources.transactions import transactions
from .catalogue import TXN, query

_FEATURES = ["amount", "device_age_hours", "hour_of_day"]
_BINS = 8


def _edges(column: str) -> str:
    return f"(SELECT list_distinct(quantile_cont({column}, {[k / _BINS for k in range(1, _BINS)]})) FROM t)"


def _level(source: str, out: str) -> str:
    """The best split of each node of source(event_id, node, x0, x1, x2, g, h), as out(node, f, cut, rows, gain, value)."""
    each = " UNION ALL ".join(f"SELECT node, {k} AS f, x{k} AS bin, g, h FROM {source}" for k in range(3))
    gain = "0.5 * (gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1))"
    return f"""{out}_s AS (SELECT node, f, bin, sum(g)::DOUBLE AS g, sum(h)::DOUBLE AS h, count(*) AS n FROM ({each}) GROUP BY ALL),
        {out}_c AS (SELECT node, f, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER p AS ga, sum(h) OVER p AS ha, sum(n) OVER p AS na FROM {out}_s
                    WINDOW w AS (PARTITION BY node, f ORDER BY bin), p AS (PARTITION BY node, f)),
        {out}_r AS (SELECT node, f, bin AS cut, {gain} AS gain, row_number() OVER (PARTITION BY node ORDER BY {gain} DESC, f, bin) AS k FROM {out}_c WHERE nl < na AND hl >= 1 AND ha - hl >= 1 AND {gain} > 0),
        {out} AS (SELECT a.node, r.f, r.cut, a.rows, coalesce(r.gain, 0) AS gain, a.value FROM (SELECT node, count(*) AS rows, -sum(g) / (sum(h) + 1) AS value FROM {source} GROUP BY 1) a
                  LEFT JOIN (SELECT * FROM {out}_r WHERE k = 1) r ON r.node = a.node)"""


def _down(source: str, splits: str) -> str:
    """Rows of the nodes that were split, in their children."""
    return f"SELECT r.event_id, 2 * r.node + 1 + (CASE s.f WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END > s.cut)::INT AS node, x0, x1, x2, g, h FROM {source} r JOIN {splits} s ON s.node = r.node AND s.f IS NOT NULL"


_FIRST = f"""WITH {TXN}, t AS (SELECT event_id, amount, device_age_hours, hour(ts)::DOUBLE AS hour_of_day, is_fraud::INT AS y FROM txn),
    rate AS (SELECT avg(y) AS p FROM t), b AS (SELECT {", ".join(f"{_edges(c)} AS e{k}" for k, c in enumerate(_FEATURES))}),
    r0 AS (SELECT event_id, 0 AS node, {", ".join(f"len(list_filter(e{k}, lambda e: e <= {c}))::INT AS x{k}" for k, c in enumerate(_FEATURES))},
                  round((p - y) * 16777216) / 16777216 AS g, round(p * (1 - p) * 16777216) / 16777216 AS h FROM t, rate, b),
    {_level("r0", "l0")}, r1 AS ({_down("r0", "l0")}), {_level("r1", "l1")}, r2 AS ({_down("r1", "l1")}),
    l2 AS (SELECT node, NULL::INT AS f, NULL::INT AS cut, count(*) AS rows, 0.0::DOUBLE AS gain, -sum(g) / (sum(h) + 1) AS value FROM r2 GROUP BY 1),
    every AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)"""


def _training(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    return t.select("event_id", "amount", "device_age_hours", F.hour("ts").cast("double").alias("hour_of_day"), F.col("is_fraud").cast("int").alias("y"))


@query("gbt_first_tree", f"{_FIRST} SELECT node, ({_FEATURES})[f + 1] AS feature, cut, rows, round(gain, 4) AS gain, round(value, 6) AS value FROM every")
def gbt_first_tree(spark: SparkSession, d: str) -> DataFrame:
    """Two boosted trees trained on all events; the nodes of the first."""
    model = GBT(n_trees=2, depth=2, subsample=1.0, colsample=1.0)
    _, trees, _ = boosting.fit(_training(spark, d), _FEATURES, "y", "event_id", model, _BINS)
    rows = spark.createDataFrame(boosting.tree_rows(trees[:1], _FEATURES), boosting.TREE_ROWS)
    return rows.select("node", "feature", "cut", "rows", F.round("gain", 4).alias("gain"), F.round("value", 6).alias("value"))


@query("gbt_whole_table")
def gbt_whole_table(spark: SparkSession, d: str) -> DataFrame:
    """Trees of depth four over 256 bins, trained on all events with rows and features drawn for each tree; every event's score."""
    rows = _training(spark, d)
    model, _, _ = boosting.fit(rows, _FEATURES, "y", "event_id", GBT(n_trees=5))
    return rows.select("event_id", F.round(model.column(_FEATURES), 8).alias("score"))


_SLOPE = "CASE WHEN y = 1 THEN -0.25 ELSE 0.75 END * 0.25 * (0.5 - ln(0.5))"


@query(
    "network_gradient",
    f"""WITH {TXN}, t AS (SELECT amount / 10000 AS a, device_age_hours / 10000 AS b, is_fraud::INT AS y FROM txn)
        SELECT round(avg(CASE WHEN y = 1 THEN 0.25 ELSE 0.75 END * 0.25 * -ln(0.5)), 8) AS loss, round(avg({_SLOPE} * a), 8) AS amount, round(avg({_SLOPE} * b), 8) AS age, round(avg({_SLOPE}), 8) AS bias FROM t""",
)
def network_gradient(spark: SparkSession, d: str) -> DataFrame:
    """Loss and gradient over all events of a network without hidden layers whose weights are nought."""
    rows = transactions(spark, d).select("event_id", F.array(F.col("amount") / 10000, F.col("device_age_hours") / 10000).alias("vector"), F.col("is_fraud").cast("int").alias("y"))
    model = MLP(2, ())
    model.layers[0].params["w"][:] = 0.0
    loss = network.gradient(network.prepared(rows, "vector", "y", "event_id"), model)
    (amount,), (age,) = model.layers[0].grads["w"].tolist()
    return spark.createDataFrame([tuple(round(x, 8) for x in (loss, amount, age, float(model.layers[0].grads["b"][0])))], "loss double, amount double, age double, bias double")


@query("network_whole_table")
def network_whole_table(spark: SparkSession, d: str) -> DataFrame:
    """A network with two hidden layers trained on all events for three steps; every event's score."""
    rows = transactions(spark, d).select("event_id", F.array(F.log1p("amount"), F.col("device_age_hours") / 8760, F.hour("ts") / 24).alias("vector"), F.col("is_fraud").cast("int").alias("y"))
    model = MLP(3, (16, 8))
    network.fit(rows, "vector", "y", "event_id", model, 3)
    return score(rows, model).select("event_id", F.round("ml_score", 8).alias("score"))
