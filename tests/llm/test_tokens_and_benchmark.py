import hashlib
import random
from array import array

import pytest

from tests.llm.cases import documents, frame, ordered, words
from tidemark.llm import bpe as B
from tidemark.llm import decontaminate as D
from tidemark.llm import token_counts as T

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return B.Codec(B.load_ranks(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(B.load_ranks(PATH))}, special_tokens={})


def test_prefix_table_against_library(codec, library):
    r = random.Random(4)
    for _ in range(1500):
        piece = bytes(r.choice(b"aabtheinonr  \xc3\xa9's1\n\xff") for _ in range(r.randint(1, 40)))
        table = B.Prefixes(codec.merges, piece)
        assert table.ids() == library._encode_single_piece(piece)
        a = r.randrange(len(piece) + 1)
        b = r.randrange(a, len(piece) + 1)
        table.edit(a, b, b"then")
        table.append(b"ing")
        assert table.ids() == library._encode_single_piece(piece[:a] + b"then" + piece[b:] + b"ing")


def test_edits_of_a_text(codec, library):
    r = random.Random(5)
    for _ in range(400):
        text = B.Text(codec, "".join(r.choice(["a", "the", " ", "  ", "\n", "'s", "é", "1", "!", " x"]) for _ in range(r.randint(0, 30))))
        for _ in range(3):
            a = r.randrange(len(text.text) + 1)
            text.edit(a, r.randrange(a, len(text.text) + 1), r.choice(["", " ", "s", "\n", "the ", "'"]))
            assert list(text.ids()) == library.encode_ordinary(text.text)
        text.append(" end")
        assert list(text.ids()) == library.encode_ordinary(text.text)


def test_spaces_beside_other_white_space(codec, library):
    """Parts are cut only at spaces between signs that aren't white."""
    r = random.Random(6)
    signs = ["a", "the", "'s", "'", " ", "  ", "\n", "\t", " x", "\x1f", "\x85", "\u3000", "\u200b", "\u00a0", "é", "12", "!", "中"]
    for _ in range(3000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 14)))
        assert codec.encode(text).tolist() == library.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_bpe_report(spark, codec, library):
    rows = documents() + [(500, "a  b \n c　d "), (501, "don't  stop it's  \t\n"), (502, "x" * 5000)]
    want = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert ordered(B.report(frame(spark, rows), PATH, P.PATTERN).collect()) == ordered(want)
    assert B.report(frame(spark, []), PATH, P.PATTERN).count() == 0
    full = B.encode(frame(spark, rows[:20]), PATH, P.PATTERN).collect()
    assert ordered((r["doc_id"], r["decoded"]) for r in full) == ordered((d, t or "") for d, t in rows[:20])


def greedy(word, vocabulary, longest):
    data, at, n = b" " + word, 0, 0
    while at < len(data):
        for k in range(min(longest, len(data) - at), 0, -1):
            if data[at : at + k] in vocabulary:
                at, n = at + k, n + 1
                break
        else:
            return 1
    return n


def test_token_counts_of_long_words_and_two_vocabularies(spark, tmp_path):
    """Long texts and words, and a second vocabulary in the same workers."""
    import base64

    small = tmp_path / "small.tiktoken"
    small.write_bytes(b"".join(base64.b64encode(x) + b" %d\n" % k for k, x in enumerate([bytes([c]) for c in range(256)] + [b" a", b"ab", b"abc"])))
    texts = ["abc ab " * 30_000, "abc" * 40_000, "ab" * 50, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    for path in (PATH, str(small), PATH):
        vocabulary = set(B.load_ranks(path))
        longest = max(map(len, vocabulary))
        want = [(d, len(words(t)), sum(greedy(w.encode(), vocabulary, longest) for w in words(t))) for d, t in enumerate(texts)]
        assert ordered(T.report(df, path).collect()) == ordered(want)
    automaton = T.Automaton(B.load_ranks(PATH))
    automaton.count(texts[0].encode() + texts[1].encode())
    assert all(len(w) <= T.LONG for w in automaton.seen)


def test_codec_forgets_long_parts(codec, library):
    text = "word " + "日本語" * 500 + " tail " + "QUJD" * 400 + " end"
    assert list(codec.encode(text)) == library.encode_ordinary(text)
    assert all(len(u) <= B.LONG for u in codec.units)


def test_long_items_in_blocks(spark):
    """A benchmark item longer than a block is read in parts that lose no window."""
    from tidemark.llm import decontaminate as D

    item = " ".join(f"w{k}, x" for k in range(400))
    docs = [(k, " ".join(f"w{i} x" for i in range(k * 7, k * 7 + 6))) for k in range(50)] + [(90, "w1 x w3"), (91, None)]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, item), (2, None), (3, "short one")], "item_id bigint, text string")
    whole = ordered(D.report(*frames).collect())
    parts = D.find(*frames, block_chars=200)
    got = [(r["doc_id"], r["n_words"], r["n_hit"]) for r in parts.collect()]
    assert sorted(got) == sorted((r[0], r[1], r[2]) for r in whole) and sum(g[2] > 0 for g in got) == 50
    assert sorted(r["doc_id"] for r in D.drop_contaminated(*frames, block_chars=500).collect()) == [90, 91]


def test_token_counts(spark):
    vocabulary = set(B.load_ranks(PATH))
    longest = max(map(len, vocabulary))
    rows = documents()
    want = [(d, len(words(t)), sum(greedy(w.encode(), vocabulary, longest) for w in words(t))) for d, t in rows if len(t or "") < 10_000]
    got = [r for r in T.report(frame(spark, [x for x in rows if len(x[1] or "") < 10_000]), PATH).collect()]
    assert ordered(got) == ordered(want)
    small = T.Automaton([b" ", b"a", b"ab", b"abc", b"bcd", b" a"])
    brute = {b" ", b"a", b"ab", b"abc", b"bcd", b" a"}
    assert [small.pieces(w) for w in (b"ab", b"aab", b"bcd", b"zz")] == [greedy(w, brute, 3) for w in (b"ab", b"aab", b"bcd", b"zz")]
    assert T.report(frame(spark, []), PATH).count() == 0


def bench_words(text):
    out, word = [], b""
    for c in (text or "").encode():
        c = c + 32 if 65 <= c <= 90 else c
        if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128:
            word += bytes([c])
        else:
            out += [word] * bool(word)
            word = b""
    return out + [word] * bool(word)


def brute_hits(docs, items, k):
    phrases = {}
    for i, t in items:
        w = bench_words(t)
        for s in range(max(1, len(w) - k + 1) if w else 0):
            phrases.setdefault(tuple(w[s : s + k]), set()).add("" if i is None else str(i))
    lengths = {len(p) for p in phrases}
    out = []
    for d, t in docs:
        w, hit, named = bench_words(t), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in phrases:
                    hit.update(range(s, s + n))
                    named |= phrases[tuple(w[s : s + n])]
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return out


def test_copies_of_items_are_read_once(spark, monkeypatch):
    """A table of one item many times over comes to the driver as one row."""
    from tidemark.llm import decontaminate as D

    seen = []
    monkeypatch.setattr(D, "phrases_of", lambda items, window, of=D.phrases_of: seen.append(len(items)) or of(items, window))
    item = "one two three four five six seven eight nine ten eleven"
    benchmark = spark.createDataFrame([(1, item)] * 500 + [(2, "other words")] * 3, "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"so {item} it is"), (2, "none")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_hit"] for r in D.report(docs, benchmark).collect()}
    assert got == {1: 11, 2: 0} and seen == [2]
    assert [r["doc_id"] for r in D.drop_contaminated(docs, benchmark, block_chars=100).collect()] == [2]


@pytest.mark.parametrize("block", [8_000_000, 60])
def test_decontamination(spark, block):
    r = random.Random(6)
    docs = documents(7, 60) + [(900, "a " * 400), (901, "b a a a a a a a a a a b")]
    sample = [bench_words(t) for _, t in docs if t]
    items = [(k, b" ".join(w[(s := r.randrange(max(1, len(w)))) : s + r.randint(3, 25)]).decode("utf-8", "replace").upper()) for k, w in enumerate(sample) if k % 3 == 0]
    items += [(None, "a a a a a a a a a a"), (77, None), (78, ""), (5, "no such words here at all"), items[0]]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.find(frame(spark, docs), benchmark, block_chars=block).collect()
    rows = [(r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["n_hit"] > 0) for r in got]
    assert ordered(rows) == ordered(brute_hits(docs, items, 10))
    clean = D.drop_contaminated(frame(spark, docs), benchmark)
    assert clean.count() == sum(not x[5] for x in rows)
    assert D.report(frame(spark, []), benchmark).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.report(frame(spark, docs), none).filter("contaminated").count() == 0


def test_removal_spans(spark):
    docs = [(1, "Keep this. ONE two Three four five six seven eight nine ten, and this é.")]
    benchmark = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id bigint, text string")
    spans = D.find(frame(spark, docs), benchmark).first()["byte_spans"]
    assert D.remove_spans(docs[0][1], spans) == "Keep this. , and this é."
