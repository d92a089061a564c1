import random
import re

import duckdb
import numpy as np
import pytest

from tests.llm.cases import documents, frame
from tidemark.llm import html_text as H
from tidemark.llm import language_id as L
from tidemark.llm import quality as Q
from tidemark.llm import secrets as S

DATA = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    got = L.report(df).toPandas().merge(df.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_edge_cases(spark):
    rows = documents()
    got = {r["doc_id"]: r for r in L.report(frame(spark, rows)).collect()}
    assert got[120]["lang_pred"] == got[121]["lang_pred"] == got[122]["lang_pred"] == "und"
    assert got[123]["lang_pred"] == "en"
    assert L.report(frame(spark, [])).count() == 0
    assert L.predict(None, ["text"]) == (["und"], [0.0])


def test_kernel_against_sets():
    """Presence flags, kernel values and predictions against sets of n-grams and plain loops."""
    texts = ["the cat sat on the mat", "a dog and the cat", "der Hund und die Katze", "die Katze saß auf", "Über die Straße", "on the road again", "日本語 the"]
    labels = ["en", "en", "de", "de", "de", "en", "en"]
    sets = [{t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    bits = [L.presence(t, np.zeros(1 << L.BITS, bool)).copy() for t in texts]
    assert [int(b.sum()) for b in bits] == [len(s) for s in sets]
    model = L.fit(labels, [np.packbits(b) for b in bits], landmarks=4, ridge=0.1)
    marks = [2, 0, 3, 1]  # languages in turn
    kernel = np.array([[len(a & sets[m]) / np.sqrt(len(a) * len(sets[m])) for m in marks] for a in sets])
    values, vectors = np.linalg.eigh(kernel[marks])
    z = kernel @ (vectors / np.sqrt(values))
    y = np.array([[1.0 if c == k else -1.0 for k in ("de", "en")] for c in labels])
    centred = z - z.mean(axis=0)
    w = np.linalg.solve(centred.T @ centred + 0.1 * np.eye(4), centred.T @ (y - y.mean(axis=0)))
    margins = centred @ w + y.mean(axis=0)
    names, scores = L.predict(model, texts)
    odds = np.exp(3 * (margins - margins.max(axis=1, keepdims=True)))
    assert names == [("de", "en")[k] for k in margins.argmax(axis=1)]
    assert scores == pytest.approx((odds.max(axis=1) / odds.sum(axis=1)).tolist(), abs=1e-5)


def test_language_sample_is_bounded_by_rows(spark):
    """A doc_id and a row that repeat thousands of times, and more languages than the sample has places for."""
    rows = [(1, f"repeated id number {k} in a row", "en") for k in range(3_000)] + [(1, "the same row", "en")] * 2_000 + [(k, f"text {k} of its own", f"l{k}") for k in range(10, 200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    seen = {}
    fit, L.fit = L.fit, lambda labels, flags: seen.update(labels=labels)
    try:
        L.train(df, 80)
    finally:
        L.fit = fit
    assert len(seen["labels"]) <= 80 and len(set(seen["labels"])) == 20 and seen["labels"].count("en") == 4
    none = spark.createDataFrame([(None, "the text", "en"), (2, None, "en"), (3, "x", None)], "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in L.report(none).collect()} == {"und"}


def test_presence_is_the_same_over_blocks(monkeypatch):
    text = "Größe naïve 日本 " * 200
    a = L.presence(text, np.zeros(1 << L.BITS, bool)).copy()
    monkeypatch.setattr(L, "BLOCK", 17)
    assert (L.presence(text, np.zeros(1 << L.BITS, bool)) == a).all()


def brute_spans(text):
    out = []
    text = text or ""
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_secrets_base_spans(spark):
    r = random.Random(1)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows = [(k, f"é ü {r.choice(['token', 'PassWD', 'api_key', 'ſecret'])} = \"{h}\" and AKIA{'ABCDEF0123456789'[: r.randint(8, 16)]} tail") for k, h in enumerate(hexes)]
    rows += documents()
    got = S.report(frame(spark, rows)).collect()
    import hashlib

    want = sorted((d is None, d or 0, hashlib.sha256(brute_spans(t).encode()).hexdigest()) for d, t in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["base_sha256"]) for r in got) == want
    for r in got:
        base = [x for x in r["spans"].split(",") if x and not x.startswith("format")]
        assert len(base) == r["n_assign"] + r["n_access"] + r["n_hex"]


def test_grammar_learns_format_and_leaves_prose():
    r = random.Random(2)
    from collections import Counter

    examples = [(1, ("AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))).encode()) for _ in range(200)]
    grammars = S.learn(examples, Counter(b"the quick brown fox jumps over the lazy dog " * 50))
    assert len(grammars.automata) == 1
    assert len(grammars.automata[0][0].logs) < 60
    fresh = ("AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))).encode()
    assert grammars.likely(fresh)
    assert not grammars.likely(b"internationalisation2024report")
    assert S.base_spans(b"AKIASHORT") == []


def _keys(r, n):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rnd = lambda k, a=letters: "".join(r.choice(a) for _ in range(k))
    return {
        "prefix": ["ghp_" + rnd(36) for _ in range(n)],
        "signs": ["sk-live-" + rnd(24) + "=" for _ in range(n)],
        "hex": [rnd(40, "0123456789abcdef") for _ in range(n)],
        "upper": ["AKIA" + rnd(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n)],
    }


@pytest.mark.parametrize("known", ["prefix", "signs", "hex", "upper"])
def test_grammar_recall_held_out(known):
    """Keys of the learnt format are found, those of the others and the runs of ordinary documents are not."""
    from collections import Counter

    texts = [(t or "").encode() for (t,) in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet'").fetchall()]
    plain = Counter()
    for t in texts:
        plain.update(t)
    grammars = S.learn([(0, x.encode()) for x in _keys(random.Random(7), 60)[known]], plain)
    fresh = _keys(random.Random(8), 200)
    for name, values in fresh.items():
        share = sum(grammars.likely(x.encode()) for x in values) / len(values)
        assert share >= 0.9 if name == known else share <= 0.02, (known, name, share)
    others = [t for t in texts if not S.base_spans(t)]
    added = [s[3] for spans in S.scan_all(grammars, others) for s in spans]
    assert len(others) > 20 and not added


def test_grammar_takes_any_length():
    r = random.Random(4)
    from collections import Counter

    long = [("eyJ" + "".join(r.choice("abcdefXYZ012+/") for _ in range(300 + r.randint(0, 40)))).encode() for _ in range(30)]
    grammars = S.learn([(0, x) for x in long], Counter(b"the quick brown fox " * 50))
    assert grammars.likely(b"eyJ" + bytes(r.choice(b"abcdefXYZ012+/") for _ in range(320)))
    assert not grammars.likely(long[0][:40]) and not grammars.likely(b"a" * 100_000)


def test_short_and_long_candidates_are_scored():
    """Lengths are the automaton's: runs below 12 characters count, and runs much longer than any example are as unlikely as it says."""
    from collections import Counter

    r = random.Random(9)
    plain = Counter(b"the quick brown fox jumps over the lazy dog " * 50)
    short = [("k_" + "".join(r.choice("0123456789") for _ in range(6))).encode() for _ in range(120)]
    grammars = S.learn([(0, x) for x in short[:80]], plain)
    assert sum(map(grammars.likely, short[80:])) >= 38
    assert not any(map(grammars.likely, [b"quick", b"12345678", b"k_", b"k_123", short[0] * 2, b"x" * 8]))
    text = b"now " + short[100] + b", then " + b"fox " * 20 + b"and " + short[101] + b"."
    assert [s[3] for s in S.scan(grammars, text) if s[1] == 3] == [x for x in short[100:102] if grammars.likely(x)]
    open_ended = [b"A" * 4 + bytes(r.choice(b"0123456789") for _ in range(r.randint(140, 160))) for _ in range(60)]
    grammars = S.learn([(0, x) for x in open_ended], plain)
    assert grammars.likely(b"AAAA" + bytes(r.choice(b"0123456789") for _ in range(158)))
    assert not grammars.likely(b"AAAA" + bytes(r.choice(b"0123456789") for _ in range(4_000)))


def test_format_spans_are_added(spark):
    r = random.Random(5)
    keys = _keys(r, 80)["prefix"]
    rows = [(k, f"é token = {x} end") for k, x in enumerate(keys[:40])] + [(100 + k, f"ü bare {x}, end") for k, x in enumerate(keys[40:])] + [(None, None), (500, "plain words 1234567890123456")]
    rows += [(600 + k, "ordinary words of prose, one after the other " * 20) for k in range(20)]
    got = {r["doc_id"]: r for r in S.report(frame(spark, rows)).collect()}
    added = [k for k in range(100, 140) if got[k]["spans"] == "format:7:47"]
    assert len(added) >= 36 and got[500]["spans"] == "" and all(got[k]["n_format"] == 0 and got[k]["n_assign"] == 1 for k in range(40))
    assert S.report(frame(spark, [])).count() == 0


def test_training_reads_all_documents(spark, monkeypatch):
    r = random.Random(3)
    keys = ["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(S.FEWEST + 5)]
    df = spark.range(0, 45_000, 1, 4).selectExpr("id AS doc_id", "CASE WHEN id % 1800 = 7 THEN '@' || id ELSE 'ordinary text' END AS text")
    df = df.filter("text = 'ordinary text'").unionByName(spark.createDataFrame([(k, f"key {x} end") for k, x in enumerate(keys)], "doc_id bigint, text string"))
    seen = {}
    monkeypatch.setattr(S, "learn", lambda examples, plain: seen.update(examples=examples, plain=plain))
    S.train(df)
    assert sorted(v.decode() for _, v in seen["examples"]) == sorted(keys)
    assert seen["plain"][ord("x")] == 45_000 - 25 and seen["plain"][ord("k")] == len(keys)


def test_html_main_text():
    page = """<html><head><title>t</title><style>p{}</style></head><body class="page"><nav><ul><li><a href="/">Home</a></ul></nav>
    <div class="cookie-notice">We use cookies, many, many.</div><div id="main"><h1>A  heading</h1><p>First &amp; long paragraph, with commas, and more words than most.<p>Second<br>line, here is
    more text that is long enough to count.<ul><li>one item of the list</li><li>two</li></ul><table><tr><td>cell</td></tr></table></div>
    <section id="comments"><p>I disagree, strongly, with all of this, and so on and on.</p></section><footer>&copy; x</footer><script>var a = "<p>no</p>"</script>"""
    assert H.main_text(page) == "A heading\nFirst & long paragraph, with commas, and more words than most.\nSecond line, here is more text that is long enough to count.\none item of the list\ntwo\ncell"
    assert H.main_text(None) == H.main_text("") == H.main_text("<div></div>") == ""
    assert H.main_text("<p>only this") == "only this"
    assert H.main_text("<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"


def test_html_names_cut_only_by_role():
    prose = "A long paragraph of the article, with commas, and more words than most of them have."
    body = f"<p>{prose}</p><p>{prose}</p>"
    for names in ("post hentry tag-news", "main-content with-sidebar", "content has-sidebar", "container nav-open", "side"):
        page = f'<body><div class="{names}">{body}</div><div class="sidebar"><p>Read this too, it is short, really.</p></div><div class="ad"><p>{prose * 9}</p></div></body>'
        assert H.main_text(page) == f"{prose}\n{prose}", names
    page = f"<body><header><h1>The site</h1></header><article><header><h1>Own headline</h1></header>{body}<figure><img><figcaption>A caption</figcaption></figure><figure><table><tr><td>cell</td></tr></table></figure><div class='post-meta'>by x</div></article></body>"
    assert H.main_text(page) == f"Own headline\n{prose}\n{prose}\nA caption\ncell"


def test_html_every_name_around_and_inside_an_article():
    """A name alone takes no article away: around one its text stays, inside one prose under words of layout does."""
    prose = "A long paragraph of the article, with commas, and more words than most of them have."
    body = f"<p>{prose}</p><h2>Next</h2><p>{prose}</p>"
    more = "The work that came before, as far as we know, is listed here. It was done by others."
    text = f"{prose}\nNext\n{prose}"
    for word, weight in H.WEIGHT_OF.items():
        for names in (word, f"{word}-free", f"{word}-wall", f"page-{word}-x", f"{word}-box", word.upper()):
            page = f'<body><div class="menu"><a href=x>Home</a></div><div class="{names}">{body}</div><div class="footer">f</div></body>'
            assert H.main_text(page) == text, names
            page = f'<body><div class="{names}">{body}</div><div class="comment-list"><p>{prose * 4}</p></div></body>'
            if weight < 16:
                assert H.main_text(page) == text, names
        for names in (word, f"{word}-work"):
            got = H.main_text(f'<body><article>{body}<div class="{names}"><p>{more}</p></div></article></body>')
            assert got == (f"{text}\n{more}" if weight <= 1 else text) or (weight > 1 and names != word), names
            links = H.main_text(f'<body><article>{body}<div class="{names}"><a href=x>{more}</a></div></article></body>')
            assert links == text or names.startswith("tag"), names  # tag-x is a subject
    for names in ("promo", "ads-free", "subscribe-wall"):
        assert H.main_text(f'<div class="{names}">{body}</div>') == text
    for names in ("related-work", "tools"):
        assert H.main_text(f'<article>{body}<div class="{names}"><p>{more}</p></div></article>') == f"{text}\n{more}"


def test_html_layouts_without_article():
    prose = "A long paragraph of the article, with commas, and more words than most of them have."
    body = f"<p>{prose}</p><h2>Next</h2><p>{prose}</p>"
    for names in ("no-sidebar", "content with-sidebar", "has-header", "page-header-fixed", "container comments-closed", "site side-left", "post tags-news", "sidebar-right-layout", "wrap ads-on"):
        page = f'<body class="{names}"><div class="menu"><a href=x>Home</a></div><div class="{names}"><div id="c">{body}</div><div class="footer">f</div></div><div class="comments"><p>{prose * 5}</p></div></body>'
        assert H.main_text(page) == f"{prose}\nNext\n{prose}", names
    page = f'<table><tr><td class="sidebar"><a href="x">One, two</a></td><td><p>{prose}<p>{prose}<figure><img><figcaption>Caption</figcaption></figure></td></tr></table>'
    assert H.main_text(page) == f"{prose}\n{prose}\nCaption"
    page = f'<div class="promo-page"><article><p class="meta">By me, on a day.</p><p>{prose}</p></article></div>'
    assert H.main_text(page) == f"By me, on a day.\n{prose}"


def test_html_malformed_and_deep_pages_are_linear():
    import time

    words = "some text that is long enough, with commas, yes. "
    shapes = [lambda k: '<a "x ' * k, lambda k: '<a b="' * k, lambda k: "<a b='>\" " * k, lambda k: ("<div>" + words) * k, lambda k: "<b>" * k + f"<div>{words}</div>" * k, lambda k: "<svg><noscript>" * k, lambda k: f"<p>{words}</p>" * k, lambda k: ('<div class="sidebar">' + words) * k, lambda k: "<!" * k, lambda k: "<b><div>x</b>" * k]
    for shape in shapes:
        took = []
        for k in (2_000, 16_000):
            t = time.process_time()
            H.main_text(shape(k))
            took.append(time.process_time() - t)
        assert took[1] < 0.3 or took[1] < 24 * took[0], (shape(1), took)
    got = H.main_text(("<div>" + words) * 2_000)
    assert got and set(got.split("\n")) == {words.strip()} and got.count("\n") >= 2_000 - H.DEEPEST - 3
    assert H.main_text(f'<div><p>{words}<a href="x>broken, link</a></p><p>{words}</p></div>') == f"{words}broken, link\n{words.strip()}"


def test_html_edge_tables(spark):
    ddl = "page_id bigint, url string, html string, text string, n_chars string, b binary"
    page = "<p>" + "word, " * 100_000 + "</p>"
    rows = [(1, "u", page, "x", "y", None), (1, "u", page, "x", "y", None), (None, None, None, None, None, None)]
    got = H.report(spark.createDataFrame(rows, ddl)).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 599_999, 599_999]
    assert H.report(spark.createDataFrame([], ddl)).count() == 0


def test_html_pages_of_the_tables(spark):
    rows = duckdb.sql(f"SELECT page_id, html FROM '{DATA}/pages.parquet'").fetchall()
    got = {r["page_id"]: r for r in H.report(spark.read.parquet(f"{DATA}/pages.parquet")).collect()}
    import html as unescape

    for k, page in rows:
        body = page[page.index("<article>") + 9 :]
        body = body[: body.find("</article>")] if "</article>" in body else body[: body.find("<footer")]
        parts = (re.sub(r"\s+", " ", unescape.unescape(re.sub(r"<[^>]+>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", body))
        assert got[k]["text"] == "\n".join(x for x in parts if x)
        assert got[k]["n_chars"] == len(got[k]["text"])
    none = spark.createDataFrame([(1, None, None), (None, "u", "")], "page_id bigint, url string, html string")
    assert [r["text"] for r in H.report(none).collect()] == ["", ""]


def test_quality_against_labels(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    got = Q.report(df).toPandas().merge(labels, on="doc_id")
    assert got[got.quality == 1].good.mean() > 0.97
    assert (~got[got.quality == 0].good).mean() > 0.9


def test_quality_edge_cases(spark):
    rows = documents()
    df = frame(spark, rows)
    got = {r["doc_id"]: r for r in Q.report(df).collect()}
    assert not got[120]["good"] and not got[121]["good"] and not got[122]["good"] and got[120]["score"] == 0.0
    left = Q.keep_good(df)
    assert left.columns == df.columns
    assert Q.report(frame(spark, [])).count() == Q.keep_good(frame(spark, [])).count() == 0


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.7])
    votes = np.where(rng.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = Q.estimate(patterns, counts.astype(float))
    assert model.prior == pytest.approx(0.8, abs=0.05)
    assert model.good[:, 1] == pytest.approx(right, abs=0.05)


def test_quality_with_null_and_repeated_ids(spark):
    """A sample by rows: null ids are learnt from, an id or a row that repeats doesn't swell what is gathered."""
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    usual = {r["doc_id"]: r["good"] for r in Q.report(df).collect()}
    bare = df.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text").unionByName(df.selectExpr("7L AS doc_id", "text"))
    scorer = Q.train(bare, 300)
    kept = [scorer.score(Q.measure((r["text"] or "x").encode())[0]) >= 0.5 for r in df.filter("trim(text) <> ''").orderBy("doc_id").collect()]
    want = [usual[r["doc_id"]] for r in df.filter("trim(text) <> ''").orderBy("doc_id").collect()]
    assert np.mean(np.array(kept) == np.array(want)) > 0.95
    seen = {}
    fit, Q.fit = Q.fit, lambda features, targets: seen.update(n=len(features)) or fit(features, targets)
    try:
        Q.train(df.limit(50).crossJoin(spark.range(40)).drop("id"), 300)
    finally:
        Q.fit = fit
    assert 0 < seen["n"] <= 50


def test_quality_against_plain_loops():
    """Posterior and gradient fit against the same steps written out for single documents."""
    rng = np.random.default_rng(3)
    patterns, counts = np.array([[1, 1, 2], [0, 1, 0], [2, 0, 1]]), np.array([50.0, 7.0, 3.0])
    model = Q.estimate(patterns, counts, rounds=1)
    q = [0.9, 0.1, 0.4]
    for k in range(3):
        for v in range(3):
            assert model.good[k, v] == pytest.approx((1 + sum(c * x for p, c, x in zip(patterns, counts, q) if p[k] == v)) / (3 + sum(c * x for c, x in zip(counts, q))))
    prior = sum(c * x for c, x in zip(counts, q)) / counts.sum()
    a = [prior * np.prod([model.good[k, p[k]] for k in range(3)]) for p in patterns]
    b = [(1 - prior) * np.prod([model.bad[k, p[k]] for k in range(3)]) for p in patterns]
    assert model.posterior(patterns) == pytest.approx([x / (x + y) for x, y in zip(a, b)])
    features, targets = rng.poisson(2, (6, 10)).astype(float), np.array([1, 1, 0, 0.2, 0.9, 0.1])
    got = Q.fit(features, targets, rounds=5)
    x = np.sqrt(features / features.sum(axis=1, keepdims=True))
    mass = np.where(targets >= 0.5, 0.5 / 3, 0.5 / 3)
    w, bias, vw, vb = np.zeros(10), 0.0, np.zeros(10), 0.0
    for _ in range(5):
        error = np.array([(1 / (1 + np.exp(-(sum(r * (w + 0.9 * vw)) + bias + 0.9 * vb))) - t) * m for r, t, m in zip(x, targets, mass)])
        vw = 0.9 * vw - 6.0 * (sum(e * r for e, r in zip(error, x)) + 1e-5 * w)
        vb = 0.9 * vb - 6.0 * sum(error)
        w, bias = w + vw, bias + vb
    assert got.weights == pytest.approx(w, abs=1e-5) and got.bias == pytest.approx(bias, abs=1e-5)
