import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import documents, frame, ordered, words
from tidemark.llm import exact_dedup as E
from tidemark.llm import substring_dedup as S


def test_fingerprints_compose():
    r = random.Random(3)
    for _ in range(200):
        data = r.randbytes(r.randint(0, 300))
        cut = r.randint(0, len(data))
        a, b = data[:cut], data[cut:]
        assert E.combine(E.fingerprint(a), E.fingerprint(b), len(b)) == E.fingerprint(data)
        assert E.chunked_fingerprint(data, chunk=7) == E.fingerprint(data)


def brute_exact(rows):
    groups = {}
    for k, (d, t) in enumerate(rows):
        groups.setdefault("".join(words(t)), []).append((-len(t or ""), d is None, d, k))
    out = []
    for body, members in groups.items():
        best = min(members)
        digest = hashlib.sha256(body.encode()).hexdigest()
        out += [(rows[m[3]][0], best[2], len(members), digest) for m in members]
    return out


# modulus 5 makes texts of equal length collide: the comparison must part them; hot_rows 2 deals groups out by salt
@pytest.mark.parametrize(("modulus", "hot"), [(E.MODULUS, 2_000), (5, 2), (E.MODULUS, 2)])
def test_exact_classes(spark, modulus, hot):
    rows = documents()
    got = E.exact_classes(frame(spark, rows), modulus, 64, hot).collect()
    assert ordered((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == ordered(brute_exact(rows))
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in got})


def test_exact_dedup_keeps_columns_and_one_row(spark):
    rows = documents()
    df = frame(spark, rows)
    left = E.exact_dedup(df)
    assert left.columns == df.columns
    bodies = ["".join(words(r["text"])) for r in left.collect()]
    assert len(bodies) == len(set(bodies)) == len({"".join(words(t)) for _, t in rows})


@pytest.mark.parametrize("copies", [[(1, "x"), (1, "x"), (1, "y"), (1, "y")], [(1, "a b"), (1, "a  b")], [(1, "ab "), (1, " ab"), (1, "ab ")], [(None, "x"), (None, "x"), (None, " x")]])
def test_exact_dedup_tells_rows_by_text(spark, copies):
    """No text is lost and none stays twice when ids repeat; columns of any name pass."""
    rows = [(d, t, d, 0, True, b"k", 1, True) for d, t in copies]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, gone_id bigint, gone_tag bigint, again boolean, key binary, tag bigint, keep_uid boolean")
    left = E.exact_dedup(df)
    assert left.columns == df.columns
    bodies = ["".join(words(r["text"])) for r in left.collect()]
    assert sorted(bodies) == sorted({"".join(words(t)) for _, t in copies})
    best = {b: max(len(t) for _, t in copies if "".join(words(t)) == b) for b in bodies}
    assert all(len(r["text"]) == best["".join(words(r["text"]))] for r in left.collect())


def brute_substring(rows, k):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1 if d is not None else 0):
            first[tuple(w[i : i + k])] = min(d, first.get(tuple(w[i : i + k]), d))
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - k + 1 if d is not None else 0):
            if first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "gram", "hot"), [(50, 8, 2_000), (8, 3, 2)])
def test_substring_dedup(spark, window, gram, hot):
    rows = documents(2)
    got = S.dedup(frame(spark, rows), window=window, gram=gram, hot=hot).collect()
    assert ordered(got) == ordered(brute_substring(rows, window))


def test_substring_frequent_keys_dealt_out(spark, monkeypatch):
    """Every minimiser, string and window that comes three times or more is salted."""
    monkeypatch.setattr(S, "SALTS", 2)
    monkeypatch.setattr(S, "SPREAD", 1 << 40)
    rows = documents(4)
    got = S.dedup(frame(spark, rows), window=8, gram=3, hot=2).collect()
    assert ordered(got) == ordered(brute_substring(rows, 8))


def test_substring_repeats_within_two_documents(spark):
    """Few documents, many repeats of one passage: the bucket is crowded by strings, not by documents."""
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(1, " ".join(f"{passage} a{k}" for k in range(300))), (2, " ".join(f"{passage} b{k}" for k in range(300)) + " " + " ".join(f"{passage} a{k}" for k in range(200, 260)))]
    got = S.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), window=20, gram=4, hot=50).collect()
    assert ordered(got) == ordered(brute_substring(rows, 20))


def test_substring_null_and_repeated_ids_stay_apart(spark):
    """Rows without an id and copies of one row don't meet in one task."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text)] * 400 + [(5, text + " x")] * 400 + [(5, f"{text} {k}") for k in range(40)] + [(2, "a " + text)]
    df = frame(spark, rows).repartition(8)
    got = S.dedup(df)
    assert ordered(got.collect()) == ordered(brute_substring(rows, 50))
    alone = got.filter("doc_id IS NULL").groupBy(F.spark_partition_id()).count().collect()
    assert len(alone) > 1 and sum(r["count"] for r in alone) == 400


def test_empty_tables(spark):
    none = frame(spark, [])
    assert E.report(none).count() == 0
    assert E.exact_dedup(none).count() == 0
    assert S.report(none).count() == 0
