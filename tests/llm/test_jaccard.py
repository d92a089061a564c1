import numpy as np
import pytest

from tests.llm.cases import documents, frame, ordered, words
from tidemark.llm import jaccard_join as J
from tidemark.llm.components import components


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, n, part, whole):
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and whole * both >= part * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for a, (d, _) in enumerate(rows):
        if d is not None:
            least[find(a)] = min(d, least.get(find(a), d))
    return [(d, len(sets[a]), least.get(find(a)) if sets[a] else d) for a, (d, _) in enumerate(rows)]


def near_copies(seed=5):
    rng = np.random.default_rng(seed)
    bases = [[f"w{rng.integers(2000)}" for _ in range(k)] for k in (1, 2, 3, 9, 14, 40, 150)]
    rows = documents(seed, 30)
    for i in range(1000, 1140):
        w = list(bases[rng.integers(len(bases))])
        for _ in range(rng.integers(4)):
            w[rng.integers(len(w))] = f"W{rng.integers(2000)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("n", "part", "piece"), [(3, 90, 2_048), (5, 80, 5)])
def test_components_match_all_pairs(spark, monkeypatch, n, part, piece):
    monkeypatch.setattr(J, "PIECE", piece)
    monkeypatch.setattr(J, "PIECE_MEMBERS", 1_000_000 if piece > 5 else 900)
    monkeypatch.setattr(J, "PIVOTS", 32 if piece > 5 else 1)
    monkeypatch.setattr(J, "CROWD", 16_384 if piece > 5 else 20)
    rows = near_copies()
    got = J.jaccard_components(frame(spark, rows), n, part, 100).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(brute(rows, n, part, 100))


@pytest.mark.parametrize(("n", "part", "piece"), [(3, 90, 2_048), (5, 80, 5)])
def test_join_has_every_link_once(spark, monkeypatch, n, part, piece):
    monkeypatch.setattr(J, "PIECE", piece)
    monkeypatch.setattr(J, "PIECE_MEMBERS", 1_000_000 if piece > 5 else 900)
    rows = near_copies()
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    linked = [[bool(a and b) and 100 * len(a & b) >= part * len(a | b) for b in sets] for a in sets]
    tags = [r[0] for r in spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "k int, text string").orderBy("k").selectExpr("xxhash64(text)").collect()]
    want = [(d, tags[k], len(sets[k]), sum(linked[k]) - bool(sets[k])) for k, (d, _) in enumerate(rows)]
    df = frame(spark, rows)
    assert ordered(J.link_counts(df, n, part, 100).collect()) == ordered(want)
    pairs, members = (x.collect() for x in J.jaccard_join(df, n, part, 100))
    place = {(r["doc_id"], r["tag"]): r["cls"] for r in members}
    assert len(members) == sum(map(bool, sets))
    between = {frozenset((place[rows[a][0], tags[a]], place[rows[b][0], tags[b]])) for a in range(len(rows)) for b in range(a) if linked[a][b] and sets[a] != sets[b]}
    assert len(pairs) == len(between) and {frozenset((r["a"], r["b"])) for r in pairs} == between


def test_buckets_meet_for_all_linked_sets():
    rng = np.random.default_rng(2)
    for part in (90, 80):
        levels = J.Levels(part, 100)
        for _ in range(300):
            size = int(rng.integers(1, 200))
            base = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            other = np.unique(np.concatenate([rng.permutation(base)[: int(len(base) * rng.uniform(0.8, 1.0))], rng.integers(0, 1 << 63, int(size * 0.1)).astype(np.uint64)]))
            both = len(np.intersect1d(base, other))
            if both and 100 * both >= part * (len(base) + len(other) - both):
                assert np.intersect1d(levels.keys(base)[0], levels.keys(other)[0]).size
                tree = J.RTree(np.stack([J.points_of([J.point(base)])[0]] * 40), np.full(40, len(base)))
                who, _ = tree.search(J.points_of([J.point(other)]), np.array([len(other)]), part, 100)
                assert len(who) == 40


def test_rtree_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    points = rng.poisson(3, (500, J.GROUPS)).astype(np.uint32)
    points[250:] = points[:250]
    points[250:, 0] += rng.integers(0, 30, 250).astype(np.uint32)
    sizes = points.sum(axis=1).astype(np.int64)
    who, other = J.RTree(points, sizes).search(points, sizes, 90, 100)
    overlap = np.minimum(points[:, None, :], points[None, :, :]).sum(axis=2).astype(np.int64)
    near = (90 * sizes[:, None] <= 100 * sizes[None, :]) & (90 * sizes[None, :] <= 100 * sizes[:, None])
    want = near & (190 * overlap >= 90 * (sizes[:, None] + sizes[None, :]))
    assert set(zip(who.tolist(), other.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(want)), strict=True))


def test_words_that_differ_are_no_link(spark):
    """A trailing NUL, and two long words that collide under a polynomial modulo a power of two."""
    one = "a"
    while len(one) < 2_048:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, "x y a"), (2, "x y a\0"), (3, "x y \0"), (4, f"x y {one}"), (5, f"x y {two}"), (6, f"x y {one[:512]}"), (7, f"x y {two[:512]}"), (8, "x y a")]
    got = J.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert ordered(got) == ordered((d, 1, 1 if d == 8 else d) for d, _ in rows)


def test_exact_sets_hold_when_hashes_collide(monkeypatch):
    monkeypatch.setattr(J, "grams", lambda codes, n: np.zeros(max(0, len(codes) - n + 1), dtype=np.uint64))
    texts = [b"a b c d", b"b c d e", b"a b", b"", b"A b c"]
    sets = [set(x.tolist()) for x in J.exact_sets(texts, 3)]
    assert [len(x) for x in sets] == [2, 2, 1, 1, 1] and len(sets[0] & sets[1]) == 1 and sets[4] < sets[0] and not sets[2] & (sets[0] | sets[1])


def test_connected_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 7), (200, 201), (201, 200), (5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 1, 200: 200, 201: 200}


def test_keep_one_and_empty(spark):
    rows = near_copies()
    df = frame(spark, rows)
    left = J.keep_one(df)
    assert left.columns == df.columns
    want = [d for d, _, c in brute(rows, 5, 80, 100) if d == c]
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == sorted(d for d in want if d is not None)
    assert J.report(frame(spark, [])).count() == 0


def test_keep_one_with_repeated_and_null_ids(spark):
    near = lambda k, end: " ".join(f"{k}{i}" for i in range(40)) + f" {end}"
    rows = [(1, near("a", "x")), (1, near("a", "y")), (2, near("a", "z")), (None, near("b", "x")), (None, near("b", "y")), (None, near("b", "y")), (None, near("b", "x")), (None, near("c", "x")), (7, near("c", "y"))]
    left = sorted((r["text"][0], r["doc_id"]) for r in J.keep_one(frame(spark, rows)).collect())
    assert left == [("a", 1), ("b", None), ("c", 7)]


def test_keep_one_takes_columns_of_any_name(spark):
    """Columns that are named as those inside are carried along."""
    rows = [(1, "a b c d e f"), (2, "a b c d e f g"), (2, "a b c d e f"), (None, "x y"), (None, "x y"), (3, "x  y z")]
    df = frame(spark, rows)
    left = J.keep_one(df, 2, 70, 100)
    assert left.columns == df.columns and {"gone_id", "gone_tag", "again", "count"} <= set(left.columns)
    assert sorted((r["doc_id"] or 0, r["text"], r["gone_id"]) for r in left.collect()) == [(0, "x y", None), (1, "a b c d e f", 1), (3, "x  y z", 3)]
