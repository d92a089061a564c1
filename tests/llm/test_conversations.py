import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import pytest

from tidemark.llm import conversation_repair as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, mark int, head string, digest string"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else "".join(ch for ch in x if ch not in ".!?") if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def legal(initials):
    body = initials[1:] if initials[:1] == "s" else initials
    return not initials or (body != "" and body == "ua" * (len(body) // 2))


def search(rows, dead, cut):
    """The cheapest edits among all, tried one by one up to two inserts at each place."""
    found = []
    gaps = [("",), ("u",), ("a",), ("u", "a"), ("a", "u")]
    for keeps in itertools.product(*(["D"] if d else ["D", "K", "u", "a"] for d in dead)):
        for filled in itertools.product(gaps, repeat=len(rows) + 1):
            cost, edits, out = 0, "", []
            for k in range(len(rows) + 1):
                for g in filled[k]:
                    if g:
                        cost, edits = cost + 2, edits + "I"
                        out.append(({"u": "user", "a": "assistant"}[g], ""))
                if k < len(rows):
                    e, (role, text) = keeps[k], rows[k]
                    edits += {"D": "D", "K": "K"}.get(e, "R")
                    cost += 3 if e == "D" else (0 if e == "K" else 2) + cut[k]
                    if e != "D":
                        out.append((role if e == "K" else {"u": "user", "a": "assistant"}[e], text))
            if all(r for r, _ in out) and legal("".join(r[0] for r, _ in out)):
                found.append((cost, edits, "\n".join(f"{r}:{t}" for r, t in out)))
    return min(found)


def shortest(rows, dead, cut):
    """The same from the last row on, over what was given before: nothing, s, u or a. Letters fix what follows, so suffixes compare."""
    n = len(rows)

    @lru_cache(None)
    def best(k, state, left):
        ways = [(0, "", ())] if k == n and state in ("", "a") else []
        due = "a" if state == "u" else "u"
        if left:
            c, e, o = best(k, due, left - 1)
            ways.append((c + 2, "I" + e, ((("user", "assistant")[due == "a"], ""), *o)))
        if k < n:
            c, e, o = best(k + 1, state, 3)
            ways.append((c + 3, "D" + e, o))
            if not dead[k]:
                role, text = rows[k]
                if role[:1] == due or (role[:1] == "s" and state == ""):
                    c, e, o = best(k + 1, role[:1], 3)
                    ways.append((c + cut[k], "K" + e, ((role, text), *o)))
                c, e, o = best(k + 1, due, 3)
                ways.append((c + 2 + cut[k], "R" + e, ((("user", "assistant")[due == "a"], text), *o)))
        return min(ways, default=(10**9, "", ()))

    cost, edits, out = best(0, "", 3)
    return cost, edits, "\n".join(f"{r}:{t}" for r, t in out)


def faults(rows):
    seen, dead, cut, kinds = set(), [], [], []
    for _, _, role, text in rows:
        bare = text.rstrip(WHITE)
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        dead.append(kind in ("blank", "duplicate"))
        cut.append(kind == "truncated")
        kinds.append(kind)
    return dead, cut, kinds


def brute(table):
    rows = damaged(table)
    out = []
    for conv in {r[0] for r in table}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3][:64].encode(), hashlib.sha256(r[3].encode()).digest()))
        dead, cut, kinds = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, edits, text = shortest([r[2:] for r in own], dead, cut)
        out.append((conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def parse(rows, dead, cut):
    chart = C.Chart()
    for (role, text), d, c in zip(rows, dead, cut, strict=True):
        chart.read(role, text, d, c)
    return chart.result()


def test_chart_against_all_edits():
    r = random.Random(5)
    for _ in range(60):
        n = r.randint(0, 3)
        rows = [(r.choice(["system", "user", "assistant", "tool", ""]), r.choice(["x.", "y.", "z"])) for _ in range(n)]
        dead, cut = [r.random() < 0.2 for _ in rows], [r.random() < 0.3 for _ in rows]
        cost, edits, text = search(rows, dead, cut)
        assert parse(rows, dead, cut) == (cost, edits, hashlib.sha256(text.encode()).hexdigest())
        assert shortest(rows, dead, cut) == (cost, edits, text)


def test_chart_against_shortest_path_on_long_rows():
    r = random.Random(6)
    for n in [5, 9, 40, 150] * 10:
        roles = r.choice([["system"], ["user"], ["assistant"], ["user", "assistant"], ["system", "user", "assistant", "tool"]])
        rows = [(r.choice(roles), str(k)) for k in range(n)]
        dead, cut = [r.random() < 0.2 for _ in rows], [r.random() < 0.3 for _ in rows]
        cost, edits, text = shortest(rows, dead, cut)
        assert parse(rows, dead, cut) == (cost, edits, hashlib.sha256(text.encode()).hexdigest())


def table(seed=1, n=60):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "half", " \n", "", None, "Ja. ", "…", "É." * 40, "word " * 5_000 + "."]
    rows = [(c, t, r.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "", "s\U0001f600"]), r.choice(texts)) for c in range(n) for t in range(r.randint(1, 9))]
    rows += [(None, 1, "user", "a."), (None, None, "assistant", "b."), (7, None, "user", "c."), (8, -5, "user", "d.")] + rows[:9] + rows[:3]
    dropped = next(c for c in range(10**6, 2 * 10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(dropped, 0, "user", "gone.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "h", "d") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_report_against_brute_force(spark, seed):
    rows = table(seed)
    got = C.report(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in got if (r["conv_id"] or 0) >= 10**6)


def test_empty_table(spark):
    assert C.report(frame(spark, table()).limit(0)).collect() == []
    assert C.repair(frame(spark, table()).limit(0)).collect() == []


def test_given_table_and_repaired_turns(spark, sf):
    talks = spark.read.parquet(f"{sf}/conversations.parquet")
    hurt = C.damage(talks)
    rows = [tuple(r) for r in talks.select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in C.report(talks).collect()), key=str)
    assert got == brute(rows)
    digests, bodies = {r[0]: r[8] for r in got}, {}
    for r in sorted(C.repair(hurt).collect(), key=lambda r: (r["conv_id"], r["place"])):
        bodies.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert all(legal("".join(r[0] for r, _ in turns)) for turns in bodies.values())
    for conv, digest in digests.items():
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in bodies.get(conv, [])).encode()).hexdigest() == digest


def test_one_long_conversation(spark):
    """One conversation holds almost all rows; its parse is a stream and its audit is whole."""
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(30_000)] + [(2, 0, "user", "x.")]
    got = {r["conv_id"]: r for r in C.audit(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got[1]["audit"] == "K" * 30_000 and got[1]["cost"] == 0
    assert got[2]["audit"] == "KI" and got[2]["cost"] == 2
