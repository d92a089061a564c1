import numpy as np
import pytest

from tidemark.functions import scalar as SC
from tidemark.operators import alerts as A
from tidemark.operators import attacks as AT
from tidemark.operators import drift as D
from tidemark.operators import explain as X
from tidemark.operators import metrics as M
from tidemark.operators import models as MO
from tidemark.operators import registry as R
from tidemark.plans import scoring
from pyspark.sql import functions as F


def test_losses_by_finite_differences():
    rng = np.random.default_rng(1)
    z, y = rng.normal(size=20), rng.integers(0, 2, 20)
    for loss in (MO.FocalLoss(), MO.bce):
        _, d = loss(z, y)
        for k in range(20):
            up, down = z.copy(), z.copy()
            up[k] += 1e-5
            down[k] -= 1e-5
            assert d[k] == pytest.approx((loss(up, y)[0] - loss(down, y)[0]) / 2e-5, abs=1e-6)


def test_mlp_gradients_and_training(tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    model = MO.MLP(8, (6,), dropout=0.0)
    _, d = model.loss(model.forward(x, True), y)
    d = d[:, None]
    for layer in reversed(model.layers):
        d = layer.backward(d)
    w = model.layers[0].params["w"]
    for i, j in ((0, 0), (3, 2), (7, 5)):
        w[i, j] += 1e-5
        up = model.loss(model.forward(x, True), y)[0]
        w[i, j] -= 2e-5
        down = model.loss(model.forward(x, True), y)[0]
        w[i, j] += 1e-5
        assert model.layers[0].grads["w"][i, j] == pytest.approx((up - down) / 2e-5, abs=1e-5)
    model = MO.MLP(8, (16, 8))
    losses = model.fit(x, y, epochs=60, batch_size=32)
    assert losses[-1] < losses[0] and (model.predict(x) == y).mean() > 0.8
    model.save(str(tmp_path / "m.npz"))
    assert np.allclose(MO.MLP.load(str(tmp_path / "m.npz")).predict_proba(x), model.predict_proba(x))


def test_gbt_and_column(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(int)
    model = MO.GBT(20, depth=3)
    losses = model.fit(x, y)
    assert losses[-1] < losses[0] and (model.predict(x) == y).mean() > 0.9
    assert model.feature_importance().sum() == pytest.approx(1)
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x[:50])], "k int, " + ", ".join(f"f{j} double" for j in range(5)))
    got = [r["p"] for r in df.orderBy("k").select(model.column([f"f{j}" for j in range(5)]).alias("p")).collect()]
    assert np.allclose(got, model.predict_proba(x[:50]))
    both = MO.Ensemble(None, model)
    assert both.score(x[0]) == round(float(model.predict_proba(x[:1])[0]), 4)
    assert MO.Ensemble().score(x[0]) == 0.5 and MO.Ensemble().score_batch(x[:3]).tolist() == [0, 0, 0]
    vectors = df.select("k", F.when(F.col("k") % 2 == 0, F.array(*(f"f{j}" for j in range(5)))).alias("vector"))
    scored = MO.score(vectors, both).orderBy("k").collect()
    assert [r["ml_score"] is None for r in scored] == [k % 2 == 1 for k in range(50)]


def test_online_learning():
    rng = np.random.default_rng(4)
    waiting = MO.OnlineLearner(MO.MLP(4, (8,)), every=2, batch=8)
    assert [waiting.update(rng.normal(size=4), 0) is not None for _ in range(10)] == [k in (7, 9) for k in range(10)]
    learner = MO.OnlineLearner(MO.MLP(4, (8,)), every=20, batch=16, capacity=50)
    out = [learner.update(rng.normal(size=4), int(k % 9 == 0)) for k in range(200)]
    assert sum(v is not None for v in out) == 10 and learner.updates == 10 and learner.buffer.size == 50
    assert 0 <= learner.buffer.fraud_rate <= 1 and len(learner.buffer.sample(8)[0]) == 8


def test_online_learning_sees_a_sudden_shift():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2_000, 4))
    model = MO.MLP(4, (8,), lr=0.01)
    model.fit(x, (x[:, 0] > 0).astype(int), 20)
    learner = MO.OnlineLearner(model, every=50, batch=50)
    for row in x[:200]:
        own = model.loss(model.forward(row[None, :]), np.array([int(row[0] > 0)]))[0]
        learner.update(row, int(row[0] > 0))
        assert learner.losses[-1] == own
    assert len(learner.losses) == 200 and learner.updates == 4 and learner.bursts == 0
    for row in x[200:250]:
        learner.update(row, int(row[0] <= 0))
    assert learner.bursts == 1


def test_explanations(spark):
    rng = np.random.default_rng(5)
    w = np.array([1.0, -2.0, 0.5, 0.0, 0.0, 3.0])
    background = rng.normal(size=(50, 6))
    e = X.KernelExplainer(lambda z: z @ w, background, 128)
    x = rng.normal(size=6)
    got = e.explain(x, 7)
    assert got["values"].sum() == pytest.approx(got["prediction"] - got["baseline"])
    assert np.allclose(got["values"], e.explain(x, 7)["values"])
    weights = SC.kernel_weights(6)
    assert weights[0] == weights[6] == 0 and weights[1] == pytest.approx(weights[5])
    z = rng.integers(0, 2, (200, 6)).astype(float)
    assert np.allclose(X.wls(z, z @ w, np.ones(200)), w, atol=1e-4)
    df = spark.createDataFrame([(1, x.tolist())], "event_id bigint, vector array<double>")
    values = X.explain(df, e, list("abcdef"))
    assert values.count() == 6 and X.top_features(values, k=2).count() == 2
    assert "base" in X.text(values).first()["explanation"]


def test_attributions_in_batches_and_of_nulls(spark):
    """A batch gives what its rows give alone, drawn or enumerated; exact Shapley values where all coalitions are taken."""
    r = np.random.default_rng(4)
    for d, m in ((4, 64), (9, 40)):
        e = X.KernelExplainer(lambda z: z[:, 0] * z[:, 1] + np.sin(z[:, 2]), r.normal(size=(1 if d == 4 else 5, d)), m)
        x, keys = r.normal(size=(30, d)), np.arange(30)
        prediction, values = e.batch(x, keys)
        assert np.allclose(values.sum(axis=1), prediction - e.baseline)
        assert all(np.allclose(values[k], e.explain(x[k], k)["values"]) for k in range(30))
        if d == 4:
            b = e.background[0]
            assert np.allclose(values[:, 0], (x[:, 0] - b[0]) * (x[:, 1] + b[1]) / 2, atol=1e-6)
            assert np.allclose(values[:, 2], np.sin(x[:, 2]) - np.sin(b[2]), atol=1e-6) and np.allclose(values[:, 3], 0, atol=1e-6)
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, None), (None, [0.0, 0.0, 0.0, 0.0])], "event_id long, vector array<double>").coalesce(1)
    got = X.explain(df, X.KernelExplainer(lambda z: z.sum(axis=1), np.zeros((1, 4)), 14), list("abcd")).collect()
    assert len(got) == 12 and [r["value"] for r in got if r["event_id"] == 2] == [None] * 4
    assert [round(r["value"], 6) for r in got if r["event_id"] == 1] == [1.0, 2.0, 3.0, 4.0]


def test_attributions_that_cancel_out(spark, tmp_path):
    from tidemark.plans.extended import shap_exact_values

    w, background = np.array([1.0, -2.0, 0.5]), np.array([[1.5, 0.5, 1.0]])
    e = X.KernelExplainer(lambda z: z @ w, background, 64)
    for x in ([2.5, 1.0, 1.0], [2.5 + 1e-8, 1.0, 1.0], [1.5, 0.5 + 1e-9, 1.0]):
        got = e.explain(np.array(x), 3)
        assert np.allclose(got["values"], w * (np.array(x) - background[0]), atol=1e-4)
        assert got["values"].sum() == pytest.approx(got["prediction"] - got["baseline"], abs=1e-12)
    assert X.KernelExplainer(lambda z: z[:, 0], np.zeros((1, 1)), 8).explain(np.array([2.0]))["values"] == pytest.approx([2.0])
    # event 1's attributions add up to nothing; ids repeat
    rows = [(1, "view", 100.02), (1, "view", 3.0), (2, "error", 7.0)]
    df = spark.createDataFrame(rows, "event_id bigint, event_type string, value double")
    df = df.selectExpr("event_id", "timestamp_ntz'2024-01-02 03:04:05' AS ts", "event_id AS user_id", "event_type", "value", """'{"k": 1}' AS props""")
    df.write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, shap_exact_values(spark, str(tmp_path)).collect()))
    want = {(k, v): {"amount": round(v / 100 - 1.5, 6), "age": round(-2 * (k / 10_000 - 0.5), 6), "new": -0.5} for k, _, v in rows}
    assert got == sorted((k, f, x) for (k, _), values in want.items() for f, x in values.items())
    null = spark.createDataFrame([(None, [2.5, 1.0, 1.0]), (1 << 60 | 1, [2.5, 1.0, 1.0])], "event_id bigint, vector array<double>")
    assert {r["event_id"] for r in X.explain(null.coalesce(1), e, list("abc")).collect()} == {None, 1 << 60 | 1}


def test_psi(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(0, 1, 1000), rng.normal(5, 1, 1000)
    frame = lambda v: spark.createDataFrame([(float(x), 1.0) for x in v], "x double, c double")
    same = D.report(frame(a), frame(a), ["x", "c"])
    assert all(abs(r["psi"]) < 1e-9 and r["status"] == "stable" for r in same.collect())
    moved = {r["feature"]: r for r in D.report(frame(a), frame(b), ["x", "c"]).collect()}
    edges = np.percentile(a, np.arange(0, 101, 10))
    edges[0], edges[-1] = -np.inf, np.inf
    e, n = (np.maximum(np.histogram(v, edges)[0] / 1000, 1e-4) for v in (a, b))
    e, n = e / e.sum(), n / n.sum()
    assert moved["x"]["psi"] == pytest.approx(((n - e) * np.log(n / e)).sum()) and moved["x"]["status"] == "alert"
    assert moved["x"]["mean_shift"] == pytest.approx((b.mean() - a.mean()) / a.std(), rel=1e-6)
    assert [r["l"] for r in spark.createDataFrame([(0.05,), (0.15,), (0.25,)], "v double").select(D.label(F.col("v")).alias("l")).collect()] == ["stable", "monitor", "alert"]
    over = D.overall(D.report(frame(a), frame(b), ["x", "c"]), "c").first()
    assert over["alert"] and over["features"] == ["x"]


def test_metrics(spark):
    rng = np.random.default_rng(7)
    score, y = rng.integers(0, 20, 300) / 20, rng.integers(0, 2, 300)
    df = spark.createDataFrame([(k, float(s), int(t)) for k, (s, t) in enumerate(zip(score, y, strict=True))], "k int, s double, y int")
    pos, neg = score[y == 1], score[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert M.auc(df, "s", "y").first()["auc"] == pytest.approx(want)
    assert M.auc(df.filter("y = 1"), "s", "y").first()["auc"] == 0.5
    assert sum(r["cnt"] for r in M.histogram_fixed(df, "s").collect()) == 300 and M.histogram_fixed(df.filter("false"), "s").count() == 20
    assert [r["p"] for r in M.global_place(df, ["k"], "p").orderBy("k").collect()] == list(range(1, 301))
    assert M.split_positional(df, ["k"]).filter("train").count() == 240
    assert M.reservoir(df, 10, 1, "k").count() == 10
    binned = df.select(F.when(F.col("s") > 0.5, 1).otherwise(0).alias("f"), (0.5 - F.col("y")).alias("g"), F.lit(0.25).alias("h"))
    assert M.best_split(binned, ["f"], "g", "h").count() == 1
    assert df.select(M.ewma(F.array(F.lit(1.0), F.lit(2.0))).alias("e")).first()["e"] == pytest.approx(1.05)


def test_dedup_is_anchored_at_the_last_that_fired(spark):
    times = [0, 100, 299, 300, 500, 650]
    df = spark.createDataFrame([(k, t * 10**6, "u") for k, t in enumerate(times)] + [(9, 5 * 10**6, "v"), (10, 0, "u")], "event_id bigint, us bigint, u string")
    fired = A.dedup(df, ["u"])
    assert sorted((r["u"], r["us"] // 10**6) for r in fired.collect()) == [("u", 0), ("u", 300), ("u", 650), ("v", 5)]
    assert tuple(A.counters(df, fired).first()) == (8, 4, 4)


def test_delivery_retries_and_dead_letters(spark, tmp_path):
    """Failed posts are kept by batch: a batch that runs again replaces its own, and a drain empties the folder."""
    posted = tmp_path / "posted"
    posted.mkdir()

    def post(record):
        with open(posted / record["id"], "a") as f:
            f.write("x")
        return record["id"].startswith("ok")

    dead = str(tmp_path / "dead")
    send = A.deliver(post, dead, tries=3, sleep=lambda s: None)
    df = spark.createDataFrame([("ok1",), ("never1",), ("never2",)], "id string").coalesce(1)
    send(df, 0)
    send(df, 0)
    send(df.filter("id = 'never2'"), 1)
    assert (posted / "ok1").read_text() == "xx" and (posted / "never1").read_text() == "x" * 6
    got = A.drain_dead_letters(spark, dead, str(tmp_path / "first"))
    assert sorted((r["batch"], r["id"]) for r in got.collect()) == [(0, "never1"), (0, "never2"), (1, "never2")]
    assert A.drain_dead_letters(spark, dead, str(tmp_path / "second")).count() == 0
    assert got.count() == 3


def test_registry_and_audit(spark, tmp_path):
    model = tmp_path / "m.bin"
    model.write_bytes(b"weights")
    reg = R.ModelRegistry(str(tmp_path / "registry.json"))
    a, b = reg.register("gbt", str(model), "d"), reg.register("gbt", str(model), "d")
    assert b == f"{a}-1" and reg.activate(b) and reg.get_active("gbt")["version"] == b and not reg.activate("none")
    again = R.ModelRegistry(str(tmp_path / "registry.json"))
    assert again.update_metrics(a, {"auc": 0.9}) and len(again.list_by_type("gbt")) == 2 and again.frame(spark).count() == 2
    assert R.file_hash(str(tmp_path / "none")) == "0" * 64
    scored = spark.createDataFrame([("t1", [1e-5, 2.0], 0.1, 0.2, 0.3, "PASS"), ("t2", [1.0, 2.0], 0.1, 0.2, 0.95, "BLOCK")], "transaction_id string, vector array<double>, rule_score double, ml_score double, score double, decision string")
    R.append_audit(R.audit_entries(scored, "v1", True), str(tmp_path / "audit"))
    (tmp_path / "audit" / "bad.json").write_text("{not json\n")
    log = R.load_audit(spark, str(tmp_path / "audit")).cache()
    assert log.count() == 2 and R.audit_get(log, "t1").count() == 1 and R.audit_latest(log).count() == 2
    import hashlib

    assert R.audit_get(log, "t1").first()["feature_hash"] == hashlib.sha256(b"[1e-05,2.0]").hexdigest()
    assert {r["decision"]: (r["n"], r["shadow"]) for r in R.audit_stats(log).collect()} == {"PASS": (1, 1), "BLOCK": (1, 1), "ALL": (2, 2)}


def test_attacks(spark):
    assert AT.suite(spark).count() == 268
    total = AT.amount_splitting(spark, 100_000.0, 10).agg(F.sum("amount")).first()[0]
    assert total == pytest.approx(100_000, rel=0.01)
    assert AT.device_farm(spark).select("device_id").distinct().count() == 5
    assert AT.low_and_slow(spark, days=1).count() == 4
    rep = AT.run(spark, lambda df: df.withColumns({"decision": F.lit("BLOCK"), "latency_ms": F.lit(1.0)}))
    assert rep.filter("attack = 'ALL'").first()["detection_rate"] == 1.0 and "ALL" in AT.summary(rep)


def test_decisions_and_modes(spark, sf):
    from tidemark.sources.transactions import transactions

    txns = transactions(spark, sf)
    out = scoring.decide(txns, lambda df: df.withColumn("ml_score", F.when(F.col("vector").isNotNull(), 0.99)), mode="shadow").cache()
    assert out.filter("decision <> 'PASS'").count() == 0 and out.filter("would_decide = 'BLOCK'").count() > 0
    assert out.filter("blocked AND ml_score IS NOT NULL").count() == 0
    assert scoring.response(out).count() == txns.count()
    assert scoring.health("live", False) == "degraded" and scoring.health("live", True) == "ok"


def test_scalar_functions(spark):
    assert SC.fnv1a_64(b"") == 0xCBF29CE484222325 and SC.fnv1a_64(b"a") == 0xAF63DC4C8601EC8C
    df = spark.createDataFrame([("T", float("nan")), ("F", float("inf")), ("x", 1.5), ("2", None)], "t string, x double")
    rows = df.select(SC.flag_number(F.col("t")).alias("f"), SC.clean_number(F.col("x")).alias("c"), SC.fnv1a("t").alias("h")).collect()
    assert [r["f"] for r in rows] == [1.0, 0.0, 0.0, 2.0] and [r["c"] for r in rows] == [0.0, 0.0, 1.5, 0.0]
    assert int(rows[0]["h"]) == SC.fnv1a_64(b"T")
    s = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double").select(SC.sigmoid(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in s] == [0.0, 0.5, 1.0]


def test_scalar_functions_on_any_ids_and_zone(spark, tmp_path):
    import duckdb

    from tidemark.plans.catalogue import ORACLE
    from tidemark.plans.extended import scalar_functions

    df = spark.createDataFrame([(k,) for k in [*range(-60, 60), 7, None]], "event_id bigint")
    df = df.selectExpr("event_id", "timestamp_ntz'2024-01-02 03:04:05' AS ts", "1L AS user_id", "'view' AS event_type", "2.0D AS value", """'{"k": 1}' AS props""")
    df.write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.execute(ORACLE["scalar_functions"]).fetchall()
    texts = spark.createDataFrame([("2024-01-02T03:04:05",), ("2024-01-02 03:04:05Z",), ("2024-01-02T05:04:05+02:00",), ("2024-01-02",), ("never",), (None,)], "t string")
    order = lambda r: (r[0] is None, r)
    try:
        for zone in ("UTC", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = scalar_functions(spark, str(tmp_path)).collect()
            for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
                assert a[:1] + a[5:] == (b[0], float(b[5]), *b[6:]) and a[1:5] == b[1:5]
            assert [r[0] for r in texts.select(SC.epoch_micros(F.col("t"))).collect()] == [1704164645000000] * 3 + [1704153600000000, 0, 0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_top_features_of_a_row_without_a_shuffle(spark):
    """The same as top_features over all values, ties, null vectors and NaN included; the plan has no exchange."""
    import numpy as np

    from tidemark.operators import explain as X

    names = ["b", "a", "d", "c"]
    rows = spark.createDataFrame([(1, [4.0, -1.0, 2.0, 3.0]), (2, [1.0, 1.0, -1.0, 1.0]), (3, None), (4, [0.0, 0.0, 0.0, 5.0]), (5, [float("nan"), 1.0, 2.0, 3.0])], "event_id bigint, vector array<double>")
    explainer = X.KernelExplainer(lambda x: x.sum(axis=1), np.zeros((1, 4)), 64)
    explainer.batch = lambda x, keys: (x.sum(axis=1), x)
    got = X.explain(rows, explainer, names, top=2)
    want = X.top_features(X.explain(rows, explainer, names), k=2)
    pick = lambda df: sorted((r["event_id"], r["place"], r["feature"], repr(r["value"])) for r in df.collect())
    assert pick(got) == pick(want) and len(pick(got)) == 10
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
