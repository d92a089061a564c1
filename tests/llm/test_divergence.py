import random
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import divergence as D

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, term string, value int, rank int, g int, total int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        groups.add((lang, source))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = {t for t, n in docs[lang].items() if n >= least}
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(counts[g])

        def share(c, t, kept=kept):
            return 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept))

        own = counts[lang, source]
        pairs = [(-sum(abs(share(own, t) - share(counts[g], t)) for t in kept), g[1].encode()) for g in groups if g[0] == lang and g[1] != source]
        terms = [(share(whole, t) - share(own, t), t.encode()) for t in kept if own[t] > 0 and share(own, t) > share(whole, t)]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


def documents(seed, n=400):
    r = random.Random(seed)
    vocabulary = [f"w{c}" for c in "abcdefghij"] + ["Über", "naïve", "日本", "Z", "z", "\U0001f600", "don't", "x-y", "ＦＵＬＬ"] + [f"t{chr(97 + k)}{chr(97 + j)}" for k in range(9) for j in range(9)]
    rows = []
    for _ in range(n):
        s = r.choice([None, "", "a", "a", "a", "b", "ü", "c"])
        rows.append((" ".join(r.choice(vocabulary[: 20 if s == "a" else None]) for _ in range(r.randint(0, 30))), r.choice(["en", "en", None, "de"]), s))
    rows += [(None, "en", "void"), ("", None, None), ("only once", "fr", "x"), (None, "fr", "y"), ("the " * 40_000, "en", "long"), *rows[:5], *rows[:5]]
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(k, *r, 1, "t", 1, 1, 1, 1) for k, r in enumerate(rows)], SCHEMA).repartition(parts)


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 5, 7), (2, 30, 50), (3, 1, 3)])
def test_audit_against_brute_force(spark, seed, least, top):
    rows = documents(seed)
    got = D.audit(frame(spark, rows), least, top).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, least, top)


def test_small_tables_and_blocks(spark, monkeypatch):
    """Results don't depend on how much is counted, split or added up at once."""
    for name in ("ENTRIES", "PAIRS"):
        monkeypatch.setattr(D, name, 3)
    rows = documents(4)
    batches = [D.batch({"text": [x[0] or "" for x in part], "lang": [x[1] or "" for x in part], "source": [x[2] or "" for x in part]}, D.pa.schema([(n, D.pa.string()) for n in ("text", "lang", "source")])) for part in (rows[:100], rows[100:])]
    found = Counter()
    for b in D._count(iter(batches)):
        for r in b.to_pylist():
            found[r["lang"], r["source"], r["term"]] += r["n"]
    want = Counter((lang or "", s or "", t) for x, lang, s in rows for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(x or "")))
    assert found == want
    posting = D.pa.array([[{"g": g, "p": g * g + 3, "p0": g + 1} for g in gs] for gs in ([0, 1, 2, 3, 4], [2, 1], [4, 3, 0])], type=D.pa.list_(D.pa.struct([("g", D.pa.int32()), ("p", D.pa.int64()), ("p0", D.pa.int64())])))
    sums = Counter()
    for b in D._both(iter([D.pa.RecordBatch.from_arrays([D.pa.array(["x", "x", "y"]), posting], ["lang", "posting"])] * 3)):
        for r in b.to_pylist():
            sums[r["lang"], r["g"], r["h"]] += r["value"]
    want = Counter()
    for lang, gs in (("x", [0, 1, 2, 3, 4]), ("x", [2, 1]), ("y", [4, 3, 0])):
        for i in gs:
            for j in gs:
                if i < j:
                    p, q, p0, q0 = i * i + 3, j * j + 3, i + 1, j + 1
                    want[lang, i, j] += 3 * (abs(p - q) - abs(p - q0) - abs(p0 - q) + abs(p0 - q0))
    assert {k: v for k, v in sums.items() if v} == {k: v for k, v in want.items() if v}


def test_blocks_end_between_terms():
    data = "ab é  cd日本 x".encode() * 50
    assert [t for part in D.blocks(data, 7) for t in part] == D._TERM.findall(data)


def test_empty_and_one_source(spark):
    assert D.audit(frame(spark, documents(1)).limit(0)).collect() == []
    assert sorted(tuple(r) for r in D.audit(frame(spark, [("a b", "en", "s")] * 40)).collect()) == []


def test_large_counts_are_exact(spark):
    n = 4 * 10**12
    row = spark.sql(f"SELECT {n} AS n, {3 * n + 7} AS total, 11 AS v").select(D._share("n", "total").alias("p")).first()
    assert row["p"] == 1 + 1_000_000_000 * (n + 5) // (3 * n + 7 + 55)
