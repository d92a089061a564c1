import json
import random

import pytest

from tidemark.operators import index as I
from tidemark.operators import kv
from tidemark.sources import card, logs
from tidemark.sources import transactions as TX
from pyspark.sql import functions as F


def test_append_log_and_source(spark, tmp_path):
    log = logs.AppendLog(str(tmp_path / "a.log"))
    offsets = [log.append(f"payload {k}".encode()) for k in range(20)]
    assert log.read_at(offsets[7]) == b"payload 7" and log.record_count() == 20
    assert [p for _, p in log.scan(offsets[18])] == [b"payload 18", b"payload 19"]
    df = logs.read_log(spark, str(tmp_path / "a.log"))
    assert df.count() == 20 and logs.verify(df).count() == 0
    data = bytearray((tmp_path / "a.log").read_bytes())
    data[offsets[3] + 6] ^= 1
    (tmp_path / "a.log").write_bytes(bytes(data))
    with pytest.raises(logs.CorruptRecord):
        log.read_at(offsets[3])
    (tmp_path / "b.log").write_bytes(b"nope\x01")
    with pytest.raises(logs.CorruptRecord):
        list(logs.AppendLog(str(tmp_path / "b.log")).scan())


def test_write_ahead_log(spark, tmp_path):
    path = str(tmp_path / "w.wal")
    wal = logs.WriteAheadLog(path)
    assert [wal.write({"n": k}) for k in range(5)] == [1, 2, 3, 4, 5]
    assert [n for _, n in wal.replay(2)] == [3, 4, 5]
    assert logs.WriteAheadLog(path).lsn == 5
    assert wal.checkpoint(5) == 6
    assert {r["lsn"] for r in logs.replay(spark, path, 2).collect()} == {3, 4, 5, 6}
    data = (tmp_path / "w.wal").read_bytes()
    (tmp_path / "w.wal").write_bytes(data[:-3])
    assert logs.WriteAheadLog(path).lsn == 5


def test_queue_groups(tmp_path):
    q = logs.MessageQueue(str(tmp_path))
    for k in range(5):
        q.publish({"id": k})
    first = q.consume("a", 2)
    assert [m["id"] for _, m in first] == [0, 1]
    q.ack("a", first[-1][0])
    assert [m["id"] for _, m in q.consume("a")] == [2, 3, 4] and len(q.consume("b")) == 5
    q.reset("a")
    assert len(q.consume("a")) == 5 and q.stats()["records"] == 5


def test_log_as_a_stream(spark, tmp_path):
    log = logs.AppendLog(str(tmp_path / "s.log"))
    for k in range(7):
        log.append(json.dumps({"k": k}).encode())
    q = logs.stream_log(spark, str(tmp_path / "s.log"), most=3).writeStream.format("memory").queryName("log_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(60):
            if spark.sql("SELECT count(*) FROM log_rows").first()[0] == 7:
                break
            q.awaitTermination(1)
        assert spark.sql("SELECT count(DISTINCT offset) FROM log_rows").first()[0] == 7
    finally:
        q.stop()


def test_kv(spark, tmp_path):
    rows = [("a", 1, "x", False), ("a", 3, "z", False), ("b", 2, "y", False), ("b", 4, None, True), ("c", 5, None, True), ("c", 6, "back", False)]
    e = spark.createDataFrame(rows, "key string, seq bigint, value string, deleted boolean")
    assert [tuple(r) for r in kv.scan(e).collect()] == [("a", 3, "z"), ("c", 6, "back")]
    assert kv.get(e, "b").count() == 0 and kv.get(e, "none").count() == 0
    kv.write_run(e.filter("seq < 4"), str(tmp_path / "runs"))
    kv.write_run(e.filter("seq >= 4"), str(tmp_path / "runs"), 1)
    runs = kv.read_runs(spark, str(tmp_path / "runs"))
    assert kv.compact(runs).count() == 2
    assert kv.run_stats(runs).agg(F.sum("entries")).first()[0] == 6
    store = spark.createDataFrame([("e", 100, "old"), ("e", 200, "new")], "entity string, us bigint, value string")
    probes = spark.createDataFrame([("e", 150), ("e", 260), ("e", 261), ("e", 50), ("f", 300)], "entity string, now bigint")
    got = {(r["entity"], r["now"]): r["value"] for r in kv.ttl_lookup(store, probes, "entity", 60).collect()}
    assert got == {("e", 150): "old", ("e", 260): "new", ("e", 261): None, ("e", 50): None, ("f", 300): None}


def capped(n, cap):
    items = []
    for k in range(n):
        items.append(k)
        if len(items) > cap:
            items = items[cap // 2 :] if cap // 2 else items
    return items


@pytest.mark.parametrize("cap", [10, 7])
def test_postings(spark, cap):
    r = random.Random(cap)
    counts = {f"u{k}": r.randint(1, 40) for k in range(12)} | {"eleven": 11, "twenty": 20}
    rows = [(u, f"t{k:03d}", k) for u, n in counts.items() for k in range(n)] + [("", "x", 0), (None, "y", 0)]
    lists = I.postings(spark.createDataFrame(rows, "u string, t string, k int"), "u", "t", ["k"], cap)
    got = {x["u"]: x["items"] for x in lists.collect()}
    assert got == {u: [f"t{k:03d}" for k in capped(n, cap)] for u, n in counts.items()}
    assert I.postings_of(lists, "u", "none").first()["items"] == []
    assert lists.filter("u = 'twenty'").select(I.recent_of(F.col("items"), 3).alias("l")).first()["l"] == ["t017", "t018", "t019"]
    assert I.remove_entity(lists, "u", "eleven").count() == len(counts) - 1
    assert I.deserialize(I.serialize(lists, "u"), "u", cap).count() == len(counts)


def test_time_index(spark):
    df = spark.createDataFrame([(1000, "a", 0), (2000, "b", 1), (2000, "b", 2), (3000, "c", 3)], "us bigint, id string, seq int")
    assert [r["id"] for r in I.range_query(df, 1000, 2000, order=["seq"]).collect()] == ["a", "b", "b"]
    assert I.point_query(df, 3000).count() == 1
    gone = I.delete_entries(df, spark.createDataFrame([(2000, "b")], "us bigint, id string"), ["us", "id"])
    assert sorted(r["seq"] for r in gone.collect()) == [0, 2, 3]


def test_card_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("TransactionID,isFraud,TransactionDT,TransactionAmt,ProductCD,card4,card6,P_emaildomain,C1,D1,M1,V1,unused\n1,1,86400,12.5,W,VISA,Credit,Gmail.com,2,,T,0.5,9\n2,0,86401,3,C,,,,,5,F,,9\n")
    (tmp_path / "i.csv").write_text("TransactionID,DeviceType,other\n1,mobile,x\n")
    df = card.load(spark, str(tmp_path / "t.csv"), str(tmp_path / "i.csv"))
    assert "unused" not in df.columns and "other" not in df.columns
    rows = {r["transaction_id"]: r for r in card.normalize(df).collect()}
    assert rows["ieee_1"]["card_type"] == "visa" and rows["ieee_1"]["device_type"] == "mobile" and rows["ieee_1"]["is_fraud"]
    assert rows["ieee_2"]["card_type"] == "unknown" and rows["ieee_2"]["timedelta_features"]["D1"] == 5.0 and rows["ieee_2"]["count_features"]["C1"] == 0.0
    assert rows["ieee_1"]["timedelta_features"]["D1"] == -1.0 and rows["ieee_2"]["device_type"] is None
    assert card.normalize(df).select(F.size(card.vector(df)).alias("n")).first()["n"] == 33
    assert card.load(spark, str(tmp_path / "t.csv"), str(tmp_path / "none.csv")).count() == 2
    with pytest.raises(FileNotFoundError):
        card.load(spark, str(tmp_path / "none.csv"))
    assert json.loads(card.to_json(card.normalize(df)).first()["json"])["source"] == "ieee_cis"


def test_generator(spark):
    df = TX.generate(spark, 4000)
    again = TX.generate(spark, 4000).repartition(7)
    assert df.exceptAll(again).count() == 0
    s = df.agg(F.avg(F.col("is_fraud").cast("int")).alias("fraud"), F.min("amount").alias("least"), F.count_distinct("merchant_category_code").alias("codes"), F.count_distinct("transaction_id").alias("ids"), F.avg(F.col("is_new_device").cast("int")).alias("new")).first()
    assert 0.005 < s["fraud"] < 0.03 and s["least"] >= 1 and s["codes"] == 15 and s["ids"] == 4000 and 0.01 < s["new"] < 0.06
    from tidemark.schema import TRANSACTION

    assert set(df.columns) == set(TRANSACTION.fieldNames())


def test_segments_read_as_one_log_and_pass_no_rows_to_the_driver(spark, sf, tmp_path, monkeypatch):
    import duckdb

    from tidemark.plans import catalogue

    texts = ["", *(f"record {k} " * (k % 7) for k in range(500)), "é"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k bigint, x string").repartition(5)
    plain = logs.AppendLog(str(tmp_path / "one" / "a.log"))
    plain.append_all(x.encode() for x in texts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        segments = logs.write_segments(rows, str(tmp_path / "many"), "x", ["k"])
        logs.write_segments(rows.withColumn("x", F.to_json(F.struct("x"))), str(tmp_path / "wal"), "x", ["k"], "wal")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(segments) > 1
    whole = lambda start: sorted((r["offset"], bytes(r["payload"])) for r in logs.read_log(spark, str(tmp_path / "many"), start=start).collect())
    want = list(plain.scan())
    assert whole(0) == want
    assert whole(want[300][0]) == want[300:]
    assert sorted(r["lsn"] for r in logs.replay(spark, str(tmp_path / "wal"), 100).collect()) == list(range(101, len(texts) + 1))
    empty = rows.filter("k < 0")
    logs.write_segments(empty, str(tmp_path / "none"), "x", ["k"])
    assert logs.read_log(spark, str(tmp_path / "none")).count() == 0

    monkeypatch.setattr(type(rows), "toLocalIterator", lambda *_: pytest.fail("rows pass through the driver"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    for name in ("log_roundtrip", "wal_replay"):
        got = catalogue.QUERIES[name](spark, sf)
        assert sorted(map(tuple, got.collect())) == sorted(db.execute(catalogue.ORACLE[name]).fetchall())
