"""The corpus pipeline: five stages from documents to token ids.

Each stage reads all rows that the one before it kept and decides on whole texts. A stage's function takes
(spark, docs, sf_dir); all but the last return rows with the columns of documents.

Cases. Null, empty and white-space texts have nothing to learn from and score 0, so the first stage drops them; a table
without usable text, or without rows, gives no rows. Rows that share a doc_id are told apart by their texts. Of rows equal in
doc_id and text, and of copies without an id, exact dedup keeps one. A null doc_id sorts after all others where one row of a
group stays. Ties go to the longest text, then the least doc_id (exact dedup), or to the least doc_id, then a hash of the
text (Jaccard join). Very long texts pass whole. Columns beside doc_id and text are carried along under any name and not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from tidemark.llm.common import discard, materialize, table, tune


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer accepts."""
    tune(spark)
    return quality.keep_good(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the longest as written, then that of least doc_id."""
    tune(spark)
    return exact_dedup.exact_dedup(docs)


def distinct_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles, that of least doc_id."""
    tune(spark)
    return jaccard_join.keep_one(docs, 5, 80, 100)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    tune(spark)
    return bpe.report(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", distinct_content),
    ("benchmark decontamination", clean_of_benchmark),
    ("byte-level BPE", token_ids),
]

#: SQL can't express the classifier; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
            if before is not None:
                discard(before)
            before = docs
    return docs
