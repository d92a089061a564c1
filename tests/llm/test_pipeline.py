import pytest

from tests.llm.test_jaccard import brute as brute_groups
from tests.llm.test_tokens_and_benchmark import brute_hits

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_a_slice(spark, sf):
    """Every stage against what it should keep of its predecessor's rows."""
    from tests.llm.cases import words
    from tidemark.llm import quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    scorer = quality.train(docs)
    good = [r for r in docs.collect() if r["text"] and r["text"].strip() and scorer.score(quality.measure(r["text"].encode())[0]) >= 0.5]
    best = {}
    for r in good:
        body = "".join(words(r["text"]))
        rank = (-len(r["text"]), r["doc_id"])
        if body not in kept or rank < best[body]:
            kept[body], best[body] = r, rank
    rows = [(r["doc_id"], r["text"]) for r in kept.values()]
    rows = [(d, t) for (d, t), (_, _, c) in zip(rows, brute_groups(rows, 5, 80, 100), strict=True) if d == c]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(d, t) for (d, t), h in zip(rows, brute_hits(rows, items, 10), strict=True) if not h[5]]
    got = pipeline.run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in rows)
    assert len(pipeline.STAGES) == 5


def test_edge_cases(spark, sf, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids, clashing names, and an empty table."""
    from tests.llm.cases import frame

    tables = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels", "benchmark")}
    good = tables["documents"].join(tables["labels"].filter("quality = 1 AND coalesce(toxic, 0) = 0"), "doc_id").orderBy("doc_id").collect()
    # good words in another order: no copies and no benchmark passages among the documents beside them
    texts = [" ".join(reversed(r["text"].split())) for r in good if len(r["text"].split()) >= 120][:5]
    a, b, c, d, _ = texts
    long = " ".join(" ".join(reversed(r["text"].split())) for r in good) * 3
    rows = [(1, None), (2, ""), (3, " \n "), (None, None), (4, a), (4, a), (5, a.replace(" ", "  ")), (6, b), (6, c), (None, d), (None, d), (7, long), (8, a + " más.")]
    rows += [(1_000 + r["doc_id"], r["text"]) for r in tables["documents"].collect()]
    for name, part in (("full", rows), ("none", [])):
        frame(spark, part).write.parquet(str(tmp_path / name / "documents.parquet"))
        tables["benchmark"].write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = [r["doc_id"] for r in pipeline.run(spark, str(tmp_path / "full")).collect()]
    # 5 is the longest of its equals; 8 is a near copy of it with a larger id; two texts share the id 6
    assert sorted(x for x in got if x is not None and x < 1_000) == [5, 6, 6, 7] and got.count(None) == 1
    docs = spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path / "full")).columns == docs.columns
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
