import math
import random

import pytest

from tidemark.streaming import event_time as E
from pyspark.sql import functions as F

S = 1_000_000
SCHEMA = "event_id bigint, us bigint, payer_vpa string, amount double, payer_city string, device_id string"
WINDOWS = {"1m": 60, "10m": 600}


def rows_of(seed=1, n=240):
    r = random.Random(seed)
    at, out = 1_000_000 * S, []
    for k in range(n):
        at += r.choice([0, 1, 5 * S, 40 * S])
        out.append((k, at, r.choice(["a", "b", "b", "", None]), r.choice([None, 5.0, 7.25, 4000.5]), r.choice(["X", "Y", "", None]), f"d{r.randint(0, 3)}"))
    return out


def files(spark, path, parts):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{path}/in/part{k}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def brute(rows):
    out = []
    for k, at, who, *_ in rows:
        if who:
            got = [k, at]
            for seconds in WINDOWS.values():
                inside = [r for r in rows if r[2] == who and at - seconds * S <= r[1] <= at]
                x = [r[3] or 0.0 for r in inside]
                mean = math.fsum(x) / len(x)
                got += [len(x), mean, math.sqrt(math.fsum((v - mean) ** 2 for v in x) / len(x)), max(x), len({r[4] for r in inside if r[4]}), len({r[5] for r in inside if r[5]})]
            out.append(got)
    return sorted(out)


def same(got, want):
    got = sorted(map(list, got))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, rel=1e-9, abs=1e-6)


def test_stream_equals_batch_and_state_is_bounded(spark, tmp_path):
    rows = rows_of()
    path = str(tmp_path)
    parts = [rows[k : k + 40] for k in range(0, len(rows), 40)]
    query = E.event_windows(files(spark, path, parts), "30 seconds", WINDOWS, 60 * S)
    out, late = E.run_apart(query, path)
    same(out.collect(), brute(rows))
    assert late.count() == 0
    live = {(r["key"], r["bucket"]): r["rows"] for r in E.live_state(spark, f"{path}/checkpoint").collect()}
    mark = (max(r[1] for r in rows if r[2]) // 1000 - 30_000) * 1000
    want = {}
    for _, at, who, *_ in rows:
        bucket = at // (60 * S)
        if who and (bucket + 1) * 60 * S + 600 * S > mark:
            want[who, bucket] = want.get((who, bucket), 0) + 1
    assert live == want and sum(want.values()) < sum(1 for r in rows if r[2])
    assert E.live_counters(spark, f"{path}/checkpoint").first().asDict() == {"keys": len({k for k, _ in want}), "buckets": len(want), "rows": sum(want.values())}


def test_late_rows_are_kept_apart_and_a_restart_goes_on(spark, tmp_path):
    rows = rows_of(2)
    path = str(tmp_path)
    stale = [(1000 + k, rows[0][1] - 5_000 * S, "a", 1.0, "X", "d") for k in range(3)]
    first = files(spark, path, [rows[:80], rows[80:160]])
    E.run_apart(E.event_windows(first, "30 seconds", WINDOWS, 60 * S), path)
    spark.createDataFrame([*rows[160:], *stale], SCHEMA).coalesce(1).write.parquet(f"{path}/in/part9")
    again = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    out, late = E.run_apart(E.event_windows(again, "30 seconds", WINDOWS, 60 * S), path)
    assert sorted(r["event_id"] for r in late.collect()) == [1000, 1001, 1002]
    same(out.collect(), brute(rows))


def test_empty_stream(spark, tmp_path):
    query = E.event_windows(files(spark, str(tmp_path), [[]]), windows=WINDOWS)
    out, late = E.run_apart(query.filter(F.lit(True)), str(tmp_path))
    assert out.count() == 0 and late.count() == 0


class Handle:
    """State and timers of one entity, with the calls that were made."""

    def __init__(self):
        self.held, self.timers, self.calls = {}, set(), {"write": 0, "timer": 0, "remove": 0, "keys": 0}

    def getMapState(self, *_):
        return self

    def exists(self):
        return bool(self.held)

    def iterator(self):
        return iter([((k,), v) for k, v in self.held.items()])

    def keys(self):
        self.calls["keys"] += 1
        return iter([(k,) for k in self.held])

    def updateValue(self, key, value):
        self.calls["write"] += 1
        self.held[key[0]] = value

    def removeKey(self, key):
        self.calls["remove"] += 1
        self.held.pop(key[0], None)

    def registerTimer(self, at):
        self.calls["timer"] += 1
        self.timers.add(at)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


def test_calls_of_state_follow_what_stays_in_reach():
    """500 minutes of rows in one batch: what the next watermark passes is neither written nor timed."""
    import pandas as pd

    handle, processor = Handle(), E.EventWindows({"5m": 300}, 60 * S, 600_000)
    processor.init(handle)
    frame = pd.DataFrame([(k, k * 60 * S, 1.0, "X", "d") for k in range(500)], columns=["event_id", "us", "amount", "payer_city", "device_id"])
    (out,) = processor.handleInputRows(("a",), iter([frame]), Now(0))
    assert out["n_5m"].tolist() == [min(k + 1, 6) for k in range(500)] and not out["late"].any()
    assert sorted(handle.held) == list(range(484, 500)) and handle.calls == {"write": 16, "timer": 1, "remove": 0, "keys": 0}
    mark = 499 * 60_000 - 300_000
    while due := [t for t in handle.timers if t <= mark]:
        handle.timers -= set(due)
        for _ in due:
            list(processor.handleExpiredTimer(("a",), Now(mark), Now(min(due))))
    assert sorted(handle.held) == list(range(489, 500)) and handle.calls["keys"] == 1 and min(handle.timers) == processor._expires(489)
    late = pd.DataFrame([(900, 491 * 60 * S, 1.0, "X", "d"), (901, 495 * 60 * S, 1.0, "Y", "d"), (902, 1200 * 60 * S, 1.0, "Y", "d")], columns=frame.columns)
    gone, out = processor.handleInputRows(("a",), iter([late]), Now(494 * 60_000))
    assert gone["event_id"].tolist() == [900] and out["n_5m"].tolist() == [7, 1] and sorted(handle.held) == [1200]
    assert min(handle.timers) <= processor._expires(1200)


def test_length_of_a_delay(spark):
    assert [E._milliseconds(spark, x) for x in ("10 minutes", "1 day 2 hours", "1500 microseconds", "1 month")] == [600_000, 93_600_000, 2, None]
