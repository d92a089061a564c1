import math
import random

import pytest

from tidemark.operators import features as FT
from tidemark.operators import windows as W
from tidemark.operators.rules import Limits, RuleEngine, result
from tidemark.operators.sketch import CountMin
from tidemark.schema import FEATURES, canonical_names, valid_requests
from pyspark.sql import functions as F

TXN = "event_id bigint, us bigint, payer_vpa string, payee_vpa string, amount double, payer_city string, device_id string"
S = 1_000_000


def txns(spark, rows):
    return spark.createDataFrame([(k, int(us), u, "m", float(a), c, d) for k, (us, u, a, c, d) in enumerate(rows)], TXN)


def test_window_counts_and_bounds(spark):
    now = 10_000 * S
    df = txns(spark, [(now - 3600 * S, "u", 100, "A", "d1"), (now - 60 * S, "u", 200, "B", ""), (now, "u", 300, "", "d2"), (now, "v", 5, "A", "d1"), (now, "", 7, "A", "d1"), (now, None, 7, "A", "d1")])
    got = {r["event_id"]: r for r in W.user_windows(df).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    last = got[2]
    assert (last["user_txn_count_1m"], last["user_txn_count_5m"], last["user_txn_count_1h"]) == (2, 2, 3)
    assert last["user_amount_mean_1h"] == 200 and last["user_amount_max_24h"] == 300
    assert last["user_amount_std_1h"] == pytest.approx(math.sqrt(20000 / 3))
    assert (last["user_unique_cities_1h"], last["user_unique_devices_24h"]) == (2, 2)


@pytest.fixture
def wide(spark):
    """Many small tasks, so that small keys count as hot."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def bursty(spark, seed=1, n=260):
    """Hot and rare keys, bursts within one second, equal times, equal amounts, missing values, times before zero."""
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        key = r.choice(["hot"] * 6 + ["u1", "u2", "u3", "", None])
        at = r.choice([r.randint(-50 * S, 200_000 * S), 7_000 * S + r.randint(0, S), 86_400 * S, 90_000 * S + r.choice([0, 60 * S, 60 * S + 1, 3600 * S])])
        rows.append((at, key, r.choice([5.0, 49_000.25, round(r.random() * 1000, 2)]), r.choice(["A", "B", "C", "", None]), f"d{r.randint(0, 9)}"))
    return txns(spark, rows), rows


def brute_windows(rows):
    out = {}
    for k, (at, key, _, _, _) in enumerate(rows):
        if not key:
            continue
        own = [x for x in rows if x[1] == key]
        got = {}
        for w, seconds in W.LENGTHS.items():
            inside = [x for x in own if at - seconds * S <= x[0] <= at]
            amounts = [x[2] for x in inside]
            mean = math.fsum(amounts) / len(amounts)
            got[w] = (len(inside), mean, math.sqrt(math.fsum((x - mean) ** 2 for x in amounts) / len(amounts)), max(amounts), min(amounts), len({x[3] for x in inside if x[3]}), len({x[4] for x in inside if x[4]}))
        out[k] = got
    return out


@pytest.mark.parametrize("least", [1 << 16, 16])
def test_windows_of_streams_and_pieces_against_brute_force(wide, least):
    df, rows = bursty(wide)
    want = brute_windows(rows)
    got = {r["event_id"]: r for r in W.user_windows(df.repartition(3), least).collect()}
    assert sorted(got) == sorted(want)
    for k, w in want.items():
        r = got[k]
        assert [r[f"user_txn_count_{x}"] for x in W.LENGTHS] == [w[x][0] for x in W.LENGTHS]
        assert r["user_amount_mean_1h"] == pytest.approx(w["1h"][1], rel=1e-12) and r["user_amount_std_1h"] == pytest.approx(w["1h"][2], rel=1e-9, abs=1e-6)
        assert r["user_amount_max_24h"] == w["24h"][3] and r["user_unique_cities_1h"] == w["1h"][5] and r["user_unique_devices_24h"] == w["24h"][6]
        assert r["user_global_freq"] == sum((x[0], j) <= (rows[k][0], k) for j, x in enumerate(rows) if x[1] == rows[k][1])
    stats = {r["event_id"]: r for r in W.all_stats(df, "payer_vpa", least).collect()} if least > 16 else {}
    for k, w in want.items() if stats else ():
        for x in W.LENGTHS:
            s = stats[k][f"stats_{x}"]
            assert (s["count"], s["max"], s["min"], s["unique_cities"], s["unique_devices"]) == (w[x][0], w[x][3], w[x][4], w[x][5], w[x][6])
            assert s["std"] == pytest.approx(w[x][2], abs=0.006)


def test_small_batches_give_the_same(wide):
    df, rows = bursty(wide, 3, 200)
    whole = sorted(map(tuple, W.user_windows(df).select("event_id", "user_txn_count_24h", "user_amount_std_1h", "user_unique_devices_24h", "user_global_freq").collect()))
    wide.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    small = sorted(map(tuple, W.user_windows(df).select("event_id", "user_txn_count_24h", "user_amount_std_1h", "user_unique_devices_24h", "user_global_freq").collect()))
    wide.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [x[:2] + x[3:] for x in small] == [x[:2] + x[3:] for x in whole]
    assert [x[2] for x in small] == pytest.approx([x[2] for x in whole], abs=1e-6)


def test_rows_that_a_window_holds_are_looked_at_twice(monkeypatch):
    """One key, all rows within its windows, in small batches: what is looked at grows with the rows, not with rows times windows."""
    import pyarrow as pa

    looked, inner = [], W._batch_stats
    monkeypatch.setattr(W, "_batch_stats", lambda table, *rest: looked.append(table.num_rows) or inner(table, *rest))
    n = 4_000
    table = pa.table({"k": ["d"] * n, "us": list(range(n)), "amount": [float(k % 7) for k in range(n)]})
    stats = [("n", "count", "24h", None), ("total", "sum", "24h", None), ("freq", "freq", None, None)]
    got = pa.Table.from_batches(list(W._stream_stats(iter(table.to_batches(max_chunksize=50)), ["k", "us", "amount", *(s[0] for s in stats)], "k", stats, "us", "amount")))
    assert got["n"].to_pylist() == got["freq"].to_pylist() == list(range(1, n + 1))
    assert got["total"].to_pylist()[-1] == sum(k % 7 for k in range(n))
    assert sum(looked) <= 4 * n


def test_pieces_cut_within_equal_times_give_what_streams_give(wide):
    """Hot keys whose rows come in runs of equal times that are longer than a piece, beside single ones at the windows' bounds."""
    r = random.Random(11)
    times = [*[0] * 150, *[60 * S] * 90, *[3600 * S] * 60, *[3600 * S + 1] * 40, *(r.randint(-4000 * S, 180_000 * S) for _ in range(160))]
    df = txns(wide, [(at, r.choice(["hot", "hot", "warm"]), r.choice([3.0, 49_000.25, round(r.random() * 100, 2)]), "A", "d") for at in times])
    kinds = ("count", "sum", "mean", "std", "max", "min")
    stats = [*((f"{k}_{w}", k, w, None) for w in W.LENGTHS for k in kinds), ("freq", "freq", None, None)]
    want, got = ({x["event_id"]: x for x in W.sliding(df, "payer_vpa", stats, least=least).collect()} for least in (1 << 16, 16))
    assert sorted(got) == sorted(want) == list(range(len(times)))
    for k, x in want.items():
        for name, kind, _, _ in stats:
            assert got[k][name] == (x[name] if kind in ("count", "max", "min", "freq") else pytest.approx(x[name], rel=1e-9, abs=1e-5)), (k, name)


def test_a_decision_by_models_takes_features_once(spark, sf, monkeypatch):
    from tidemark.plans import catalogue, scoring

    calls, inner = [], FT.features
    monkeypatch.setattr(FT, "features", lambda *a, **o: calls.append(1) or inner(*a, **o))
    monkeypatch.setattr(scoring, "features", FT.features)
    out = catalogue.model_decisions(spark, sf, 200)
    assert out.count() == 1_000 and len(calls) == 1


def test_no_range_frame_is_in_the_plan(spark, sf):
    from tidemark.sources.transactions import transactions

    for df in (W.user_windows(transactions(spark, sf)), W.all_stats(transactions(spark, sf), "payer_vpa")):
        assert "RangeFrame" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_burst_of_one_key_is_dealt_out(wide):
    """All rows of one key within one second: pieces are even, and running sums, previous times and lookups are as before."""
    from tidemark.operators import kv, scan

    n = 4_000
    rows = wide.range(n).select(F.col("id").alias("event_id"), (F.pmod(F.col("id") * 7919, F.lit(997)) * 1000).cast("bigint").alias("us"), F.lit("hot").alias("k"), F.lit(1.0).alias("amount"))
    pieced, several = scan.cut(rows, ["k"], ["us", "event_id"], 16)
    sizes = [r["count"] for r in pieced.groupBy("_piece").count().collect()]
    assert several and len(sizes) >= 16 and max(sizes) <= 4 * n / len(sizes)
    place = {r["event_id"]: r["n"] for r in scan.running(rows, ["k"], ["us", "event_id"], {"n": F.lit(1)}, least=16).collect()}
    order = sorted((k * 7919 % 997 * 1000, k) for k in range(n))
    assert place == {k: i + 1 for i, (_, k) in enumerate(order)}
    before = {r["event_id"]: r["previous"] for r in W.with_previous(rows, "k", "us", "event_id", 16).collect()}
    assert before == {k: order[i - 1][0] if i else None for i, (_, k) in enumerate(order)}
    store = rows.filter("event_id % 5 = 0").select("k", "us", F.col("event_id").alias("value"))
    probes = rows.filter("event_id % 5 = 1").select("k", F.col("us").alias("now"), F.col("event_id").alias("probe"))
    got = {r["probe"]: r["value"] for r in kv.ttl_lookup(store, probes, "k", 2_000, 16).collect()}
    kept = sorted((u, k) for u, k in order if k % 5 == 0)
    for u, k in order:
        if k % 5 == 1:
            at = [x for x in kept if x[0] <= u][-1:]
            assert got[k] == (at[0][1] if at and u - at[0][0] <= 2_000 else None)


def test_hot_keys_of_several_columns(wide):
    from tidemark.operators import scan

    rows = wide.range(1_000).select(F.when(F.col("id") % 2 == 0, "h").otherwise(F.concat(F.lit("u"), F.col("id").cast("string"))).alias("a"), F.when(F.col("id") < 990, "").alias("b"), F.concat(F.lit("k"), (F.col("id") % 2).cast("string")).alias("c"))
    got = scan.hot_of(rows, ["a", "b", "c"], 16)
    assert [r["a"] for r in got["a"].collect()] == ["h"] and got["b"] is None and sorted(r["c"] for r in got["c"].collect()) == ["k0", "k1"]
    for k in ("a", "c"):
        alone = {tuple(r) for r in scan.hot_keys(rows, [k], 16).collect()}
        assert {tuple(r) for r in got[k].collect()} == alone


def test_no_task_takes_all_keys_of_a_column(wide, monkeypatch):
    from tidemark.operators import scan

    plans, inner = [], type(wide.range(1)).collect
    monkeypatch.setattr(type(wide.range(1)), "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan()) or inner(df))
    got = scan.hot_of(wide.range(1_000).select(F.when(F.col("id") < 500, "h").otherwise(F.col("id").cast("string")).alias("a"), F.lit("").alias("b")), ["a", "b"], 16)
    plan = plans[0].toString().split("Initial Plan")[0]
    assert [r["a"] for r in got["a"].collect()] == ["h"] and got["b"] is None
    assert "Window" not in plan and "ReusedExchange" in plan


def test_devices_that_a_task_holds_are_not_cut(wide, monkeypatch):
    """At many partitions a device of a few hundred thousand rows has two tasks' share, and is a stream all the same."""
    from tidemark.operators import scan

    rows = wide.range(140_000).select(F.lit("d").alias("a"), F.lit("u").alias("b"))
    got = scan.hot_of(rows, ["a", "b"], leasts={"a": scan.MOST})
    assert got["a"] is None and [tuple(r) for r in got["b"].collect()] == [tuple(r) for r in scan.hot_keys(rows, ["b"]).collect()] != []
    asked, inner = [], FT.hot_of
    monkeypatch.setattr(FT, "hot_of", lambda *a, **o: asked.append(o["leasts"]) or inner(*a, **o))
    FT.features(txns(wide, [(0, "u", 1, "A", "d")]).selectExpr("*", "false AS is_new_device", "1.0D AS device_age_hours", "timestamp'2024-01-06 03:00:00' AS ts"))
    assert asked == [{"device_id": scan.MOST, "payee_vpa": scan.MOST}]


def test_degraded_decisions_take_only_what_rules_read(spark, sf, monkeypatch):
    """Merchants and windows of a day decide nothing there; decisions are those that all features give."""
    from tidemark.plans import extended, scoring
    from tidemark.sources.transactions import transactions

    taken, inner = [], W.sliding
    for module in (W, FT):
        monkeypatch.setattr(module, "sliding", lambda txns, key, stats, **o: taken.extend((key, s[0]) for s in stats) or inner(txns, key, stats, **o))
    got = extended.decide_degraded(spark, sf)
    assert sorted(taken) == [("device_id", "device_global_freq"), *(("payer_vpa", f"user_{c}") for c in ("amount_mean_1h", "amount_std_1h", "txn_count_1h", "txn_count_1m", "txn_count_5m", "unique_cities_1h"))]
    taken.clear()
    whole = scoring.decide(transactions(spark, sf), engine=RuleEngine(extended.LIMITS), mode="degraded").select("event_id", F.col("score").alias("risk_score"), "decision")
    assert len(taken) == 17 - 1  # the z-score comes from mean and deviation
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_some_features_are_as_among_all(wide):
    """Whatever is asked for: hot keys, unnamed users, two rows of one id."""
    df, rows = bursty(wide, 7)
    df = df.unionByName(df.filter("event_id = 3")).withColumns({"is_new_device": F.lit(False), "device_age_hours": F.lit(1.0), "ts": F.lit("2024-01-06 03:00:00").cast("timestamp")})
    whole = FT.features(df)
    engine = RuleEngine()
    for only in ([], ["merchant_amount_mean_1h"], ["amount_zscore_1h", "hour_of_day"], ["user_unique_devices_24h", "payee_vpa"], engine.reads() - {"merchant_category_code"}):
        some = FT.features(df, only)
        assert set(some.columns) == {"event_id", *only}
        ask = [c for c in whole.columns if c in some.columns]
        assert sorted(map(str, some.select(ask).collect())) == sorted(map(str, whole.select(ask).collect())), only


def test_places_of_hot_devices(wide):
    df, rows = bursty(wide, 5)
    stats = [("n", "freq", None, None)]
    want = {k: sum((x[0], j) <= (r[0], k) for j, x in enumerate(rows) if x[4] == r[4]) for k, r in enumerate(rows)}
    for least in (1 << 16, 8):
        assert {r["event_id"]: r["n"] for r in W.sliding(df, "device_id", stats, least=least).collect()} == want


def test_rules_of_another_making_may_read_anything(spark, sf):
    from tidemark.plans import scoring
    from tidemark.sources.transactions import transactions

    engine = RuleEngine()
    engine.add_rule("crowd", lambda limits: F.when(F.col("merchant_txn_count_1h") > 0, result("crowd", "review", F.lit("x"), 0.1)))
    assert engine.reads() is None and RuleEngine(rules=[]).reads() == set()
    out = scoring.decide(transactions(spark, sf), engine=engine, vectors=False)
    assert "vector" not in out.columns and out.filter("NOT blocked AND NOT needs_review").count() == 0
    with pytest.raises(ValueError, match="vectors"):
        scoring.decide(transactions(spark, sf), lambda df: df, vectors=False)


def test_moments_of_cut_keys_merge(wide):
    from tidemark.operators import scan

    r = random.Random(2)
    rows = [("a" if r.random() < 0.8 else "b", k, None if r.random() < 0.1 else 1e6 + r.random()) for k in range(600)]
    got = scan.running_moments(wide.createDataFrame(rows, "k string, at long, x double"), ["k"], ["at"], "x", 16).collect()
    for row in got:
        own = [x for k, at, x in rows if k == row["k"] and at <= row["at"] and x is not None]
        assert row["n"] == len(own) and row["s"] == pytest.approx(sum(own)) and (row["hi"], row["lo"]) == (max(own, default=None), min(own, default=None))
        mean = math.fsum(own) / max(1, len(own))
        assert row["m2"] == pytest.approx(math.fsum((x - mean) ** 2 for x in own), rel=1e-6, abs=1e-6)


def test_asof_totals_agree_with_frames(spark):
    rows = [(int((k * 7919 % 4000) * S), f"u{k % 3}", k, "A", f"d{k % 2}") for k in range(200)]
    df = txns(spark, rows)
    frames = {r["event_id"]: r["n"] for r in df.select("event_id", F.count("*").over(W.frame("payer_vpa", "5m")).alias("n")).collect()}
    for least in (4, 1 << 16):
        totals = {r["event_id"]: r["n_5m"] for r in W.entity_windows(df, "payer_vpa", ["5m"], least).collect()}
        assert totals == frames
    probes = spark.createDataFrame([("u0", 0), ("u0", 10**12), ("none", 5)], "payer_vpa string, now bigint")
    got = {(r["payer_vpa"], r["now"]): (r["count"], r["mean"]) for r in W.stats_asof(df, probes, "payer_vpa", "1m").collect()}
    assert got[("u0", 10**12)] == (0, 0.0) and got[("none", 5)] == (0, 0.0)


def test_empty_window_after_400_seconds(spark):
    df = txns(spark, [(0, "u", 100, "A", "d")])
    probes = spark.createDataFrame([("u", 400 * S)], "payer_vpa string, now bigint")
    assert W.stats_asof(df, probes, "payer_vpa", "5m").first()["count"] == 0
    assert W.stats_asof(df, probes, "payer_vpa", "1h").first()["count"] == 1


def test_zscore_of_a_jump(spark):
    df = txns(spark, [(k * S, "u", 100, "A", "d") for k in range(10)] + [(20 * S, "u", 10_000, "A", "d")])
    u = W.user_windows(df).withColumn("z", FT.amount_zscore(F.col("amount"), F.col("user_amount_mean_1h"), F.col("user_amount_std_1h")))
    last = u.orderBy(F.col("us").desc()).first()
    assert last["user_amount_mean_1h"] == 1000 and last["z"] == pytest.approx(3.1623, abs=1e-3)


def test_running_frequency_and_regularity(spark):
    df = txns(spark, [(k * 60 * S, "u", 1, "A", "d") for k in range(5)] + [(0, "w", 1, "A", "d")])
    assert sorted(r["freq"] for r in W.running_frequency(df, "payer_vpa", 2).collect()) == [1, 1, 2, 3, 4, 5]
    got = {r["payer_vpa"]: r["regularity"] for r in W.timing_regularity(df, "payer_vpa").collect()}
    assert got == {"u": 0.0, "w": None}
    assert W.recent(df, "payer_vpa", 2, ["us"]).count() == 3 and W.recent(df, "payer_vpa", 0, ["us"]).count() == 6


def row(**over):
    base = dict.fromkeys(["user_txn_count_1m", "user_txn_count_5m", "user_txn_count_1h", "user_unique_cities_1h", "device_global_freq"], 1)
    return base | {"amount_zscore_1h": 0.0, "user_amount_mean_1h": 100.0, "is_new_device": False, "device_age_hours": 900.0, "amount": 100.0, "merchant_category_code": "5411", "ts": "2024-01-01 12:00:00"} | over


SCHEMA = "user_txn_count_1m int, user_txn_count_5m int, user_txn_count_1h int, user_unique_cities_1h int, device_global_freq int, amount_zscore_1h double, user_amount_mean_1h double, is_new_device boolean, device_age_hours double, amount double, merchant_category_code string, ts string"


def evaluate(spark, engine=None, **over):
    df = spark.createDataFrame([tuple(row(**over).values())], SCHEMA).withColumn("ts", F.try_to_timestamp("ts"))
    r = (engine or RuleEngine()).evaluate(df).first()
    return r["rule_decision"], [x["rule_name"] for x in r["rule_results"]], round(r["rule_score"], 4), r


@pytest.mark.parametrize(
    ("over", "decision", "names"),
    [
        ({}, "PASS", []), ({"user_txn_count_1m": 10}, "BLOCK", ["txn_velocity_1m"]), ({"user_txn_count_5m": 12}, "BLOCK", ["txn_velocity_5m"]), ({"user_txn_count_1h": 40}, "REVIEW", ["txn_velocity_1h"]),
        ({"amount_zscore_1h": 8.1}, "BLOCK", ["amount_velocity"]), ({"amount_zscore_1h": 5.1}, "REVIEW", ["amount_velocity"]), ({"amount_zscore_1h": 9.0, "user_amount_mean_1h": 9.0}, "PASS", []),
        ({"is_new_device": True, "amount": 501.0}, "BLOCK", ["new_device_high_amount"]), ({"device_age_hours": 1.0}, "REVIEW", ["new_device"]), ({"user_unique_cities_1h": 4}, "BLOCK", ["geo_velocity"]),
        ({"user_unique_cities_1h": 2}, "REVIEW", ["geo_velocity"]), ({"device_global_freq": 501}, "BLOCK", ["device_farm"]), ({"merchant_category_code": "6051"}, "REVIEW", ["high_risk_mcc"]),
        ({"amount": 10_001.0, "ts": "2024-01-01 05:59:59"}, "REVIEW", ["off_hours_high_amount"]), ({"amount": 10_001.0, "ts": "no time"}, "PASS", []),
        ({"user_txn_count_1h": 40, "user_unique_cities_1h": 3, "merchant_category_code": "6051"}, "BLOCK", ["txn_velocity_1h", "geo_velocity"]),
    ],
)
def test_rules(spark, over, decision, names):
    got = evaluate(spark, **over)
    assert got[:2] == (decision, names)
    assert got[3]["passed_to_ml"] == (decision == "REVIEW") and got[3]["blocked"] == (decision == "BLOCK")


def test_rule_list_and_cap(spark):
    engine = RuleEngine(Limits())
    engine.add_rule("all", lambda limits: F.when(F.lit(True), result("all", "review", F.lit("x"), 0.95)))
    assert evaluate(spark, engine, merchant_category_code="7995")[2] == 1.0
    engine.remove_rule("all")
    engine.remove_rule("high_risk_mcc")
    assert evaluate(spark, engine, merchant_category_code="7995")[0] == "PASS"
    assert len(RuleEngine().rules) == 7
    assert evaluate(spark, RuleEngine(rules=[]))[0] == "PASS"


def test_sketch(spark):
    sketch = CountMin()
    assert (sketch.width, sketch.depth) == (544, 7) and (CountMin(0.01).width, CountMin(0.01).depth) == (272, 7)
    rows = spark.createDataFrame([(f"k{k % 97}",) for k in range(3000)] + [(None,)], "k string")
    cells = sketch.build(rows, "k")
    exact = {r["k"]: r["count"] for r in rows.filter("k IS NOT NULL").groupBy("k").count().collect()}
    got = {r["k"]: r["estimate"] for r in sketch.query(cells, rows.filter("k IS NOT NULL"), "k").collect()}
    assert all(exact[k] <= v <= exact[k] + sketch.error_bound(3000) for k, v in got.items())
    assert sketch.total(cells).first()["total"] == 3000
    assert sketch.query(cells, spark.createDataFrame([("none",)], "k string"), "k").first()["estimate"] < 40
    assert sketch.merge(cells, cells).agg(F.sum("cnt")).first()[0] == 2 * 7 * 3000
    assert sketch.heavy_hitters(rows, "k", 0.0101).count() >= 1


def test_names_defaults_and_vector(spark):
    df = spark.createDataFrame([("t", "u", "m", 5.0, "5411", "A")], "transaction_id string, user_id string, merchant_id string, amount double, mcc string, city string")
    renamed = canonical_names(df)
    assert set(renamed.columns) == {"transaction_id", "payer_vpa", "payee_vpa", "amount", "merchant_category_code", "payer_city"}
    ok, bad = valid_requests(renamed.unionByName(renamed.withColumn("amount", F.lit(0.0))))
    assert (ok.count(), bad.count()) == (1, 1)
    v = spark.range(1).select(*(F.lit(None).cast("double").alias(c) for c in FEATURES)).select(FT.vector().alias("v"), FT.padded(F.array(F.lit(1.0).cast("float")), 3).alias("p")).first()
    assert v["v"] == [0.0] * 23 and v["p"] == [1.0, 0.0, 0.0]
    t = FT.transaction_features(spark.sql("SELECT timestamp'2024-01-06 03:00:00' AS ts UNION ALL SELECT NULL")).collect()
    assert sorted((r["hour_of_day"], r["day_of_week"], r["is_weekend"]) for r in t) == [(3, 5, 1), (12, 0, 0)]


def test_estimates_at_each_event(wide):
    df, rows = bursty(wide, 5, 200)
    sketch = CountMin(0.2, 0.1)
    for least in (1 << 16, 16):
        got = {r["event_id"]: r["estimate"] for r in sketch.asof(df, "device_id", least=least).collect()}
        cells = {}
        columns = {r["device_id"]: None for r in df.select("device_id").distinct().collect()}
        for r in sketch._cells(df.select("device_id").distinct(), "device_id").collect():
            columns[r["device_id"]] = [*(columns[r["device_id"]] or []), (r["row"], r["col"])]
        exact = {}
        for _, k in sorted((x[0], k) for k, x in enumerate(rows)):
            device = rows[k][4]
            for c in columns[device]:
                cells[c] = cells.get(c, 0) + 1
            exact[device] = exact.get(device, 0) + 1
            assert got[k] == min(cells[c] for c in columns[device]) >= exact[device]


def test_places_and_sums_in_a_total_order(wide):
    from tidemark.operators import metrics as M
    from tidemark.operators import scan

    rows = wide.range(3_000).select("id", (F.col("id") * 7 % 10).alias("x"), (F.col("id") * 7919 % 3001).alias("o"), (F.col("id") % 100 == 0).alias("y"))
    order = sorted((k * 7919 % 3001, k) for k in range(3_000))
    for least in (16, 1 << 16):
        got = scan.running(rows.withColumn("_all", F.lit(0)), ["_all"], ["o", "id"], {"n": F.lit(1), "s": F.col("x")}, least=least).collect()
        total, want = 0, {}
        for i, (_, k) in enumerate(order):
            total += k * 7 % 10
            want[k] = (i + 1, total)
        assert {r["id"]: (r["n"], r["s"]) for r in got} == want
    chosen = M.stratified(rows, "y", ["o", "id"], 3).collect()
    negatives = [k for _, k in order if k % 100][:90]
    assert sorted(r["id"] for r in chosen) == sorted([*range(0, 3_000, 100), *negatives])


def test_slow_and_recent_losses_in_blocks(wide):
    from tidemark.operators import metrics as M

    rows = [("a" if k % 5 else "b", k, float(k * 31 % 17)) for k in range(900)]
    got = {r["at"]: r for r in M.rolling_loss(wide.createDataFrame(rows, "k string, at long, x double"), "k", "at", "x", 5, 0.3, 16).collect()}
    slow, seen = {}, {}
    for k, at, x in rows:
        slow[k] = x if k not in slow else slow[k] * 0.3 + x * 0.7
        seen.setdefault(k, []).append(x)
        assert got[at]["baseline_loss"] == pytest.approx(slow[k], rel=1e-12)
        assert got[at]["recent_loss"] == pytest.approx(sum(seen[k][-5:]) / len(seen[k][-5:]))
