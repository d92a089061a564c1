"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (1 to ``LONGEST`` code points, lower case) that both hold,
over the root of the product of their own numbers: a blended-spectrum presence kernel. ``LANDMARKS`` training texts span
a Nyström feature space in which one ridge regression per language is fitted against the rest. Scoring a batch of texts
is a product of its presence matrix with the landmarks' and one with the coefficients. n-grams are told apart by an
18-bit hash, so a text's n-gram set has at most 2^18 members however long it is.

Training rows are a bounded sample, at most ``SAMPLE``: for each of the ``SAMPLE / 4`` commonest languages the same number of
rows, those of least hash of doc_id and text; equal rows count once. Landmarks go round the languages in order of name: of more
than ``LANDMARKS`` languages the later ones have none of their own, and are fitted by what their rows share with others' landmarks.

Cases: a text that is null or has no letter is ``und`` with score 0, as is every text when there is nothing to learn
from; rows with a null lang, doc_id or text are never learnt from, nor are languages beyond those; rows that share a
doc_id are rows like others; a null doc_id counts as the empty text for the hold-out; equal rows get equal results; whole
texts are read, in blocks; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, letters

LONGEST, BITS, BLOCK = 3, 18, 1 << 18
SAMPLE, LANDMARKS, RIDGE = 1_600, 160, 0.05
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))


@dataclass
class Model:
    languages: list[str]
    buckets: np.ndarray  # n-grams that landmarks hold
    landmarks: np.ndarray  # bool, n-grams x landmarks
    norms: np.ndarray
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray
    dense: np.ndarray | None = None  # landmarks as numbers, made where they are first used


def presence(text: str, bits: np.ndarray) -> np.ndarray:
    """Sets the flag of each n-gram of the text in bits, all others to 0."""
    bits[:] = False
    low = text.lower()
    for at in range(0, max(1, len(low)), BLOCK):
        codes = np.frombuffer(low[at : at + BLOCK + LONGEST - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        value = np.zeros(len(codes), dtype=np.uint32)
        for n in range(1, LONGEST + 1):
            if len(codes) < n:
                break
            value = (value[: len(codes) - n + 1] * _MIX[3]) ^ ((codes[n - 1 :] + np.uint32(n)) * _MIX[0])
            mixed = value ^ (value >> np.uint32(15))
            mixed *= _MIX[1]
            bits[mixed >> np.uint32(32 - BITS)] = True
    return bits


def fit(labels: list[str], rows: list[np.ndarray], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """rows: packed presence flags. Landmarks are dealt over the languages in turn."""
    languages = sorted(set(labels))
    if not languages:
        return None
    by = {c: [i for i, x in enumerate(labels) if x == c] for c in languages}
    chosen = [by[c][k] for k in range(max(map(len, by.values()))) for c in languages if k < len(by[c])][:landmarks]
    flags = [np.unpackbits(r).astype(bool) for r in rows]
    own = np.sqrt(np.maximum(1, [np.count_nonzero(f) for f in flags])).astype(np.float64)
    buckets = np.flatnonzero(np.logical_or.reduce([flags[i] for i in chosen]))
    marks = np.stack([flags[i][buckets] for i in chosen], axis=1)
    all_rows = np.stack([f[buckets] for f in flags]).astype(np.float32)
    kernel = (all_rows @ marks.astype(np.float32)).astype(np.float64) / own[:, None] / own[chosen][None, :]
    values, vectors = np.linalg.eigh(kernel[chosen])
    keep = values > max(values[-1], 1e-12) * 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = kernel @ root
    mean = z.mean(axis=0)
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    coefficients = np.linalg.solve((z - mean).T @ (z - mean) + ridge * np.eye(z.shape[1]), (z - mean).T @ (y - y.mean(axis=0)))
    return Model(languages, buckets, marks, own[chosen], root @ coefficients, y.mean(axis=0) - mean @ coefficients)


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    todo = [i for i, t in enumerate(texts) if t and letters(t)] if model else []
    if not todo:
        return names, scores
    if model.dense is None:
        model.dense = model.landmarks.astype(np.float32)
    bits = np.zeros(1 << BITS, dtype=bool)
    step = max(1, (1 << 21) // len(model.buckets))
    for at in range(0, len(todo), step):
        part = todo[at : at + step]
        matrix, own = np.empty((len(part), len(model.buckets)), dtype=np.float32), np.empty(len(part))
        for k, i in enumerate(part):
            presence(texts[i], bits)
            own[k] = np.sqrt(max(1, np.count_nonzero(bits)))
            matrix[k] = bits[model.buckets]
        kernel = (matrix @ model.dense) / own[:, None] / model.norms[None, :]
        margin = kernel @ model.weights + model.bias
        odds = np.exp(3.0 * (margin - margin.max(axis=1, keepdims=True)))
        best = margin.argmax(axis=1)
        for k, i in enumerate(part):
            names[i], scores[i] = model.languages[best[k]], float(odds[k, best[k]] / odds[k].sum())
    return names, scores


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits on rows that are not held out and have a lang: at most `sample` of them, of least hash of doc_id and text."""
    usable = ~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    rows = docs.filter(usable).select(F.col("lang").cast("string").alias("lang"), F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("h"), F.col("text").cast("string").alias("text"))
    # the commonest languages, at least four rows for each
    counts = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(max(1, sample // 4)).collect()
    if not counts:
        return None
    each = max(1, sample // len(counts))
    limits = docs.sparkSession.createDataFrame([(r["lang"], min((1 << 63) - 1, int(2**63 * (2 * each + 50) / r["count"]))) for r in counts], "lang string, below bigint")
    # a threshold leaves about twice as many as are taken, so no language's rows meet in one task; equal rows count once
    near = rows.select("lang", "h").join(F.broadcast(limits), "lang").filter("h <= below").select("lang", "h").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = near.withColumn("place", place).filter(F.col("place") <= each).select("lang", "h")
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("flags", pa.binary())])

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS, dtype=bool)
        for b in batches:
            langs, hashes, texts = (c.to_pylist() for c in b.columns)
            yield batch({"lang": langs, "h": hashes, "flags": [zlib.compress(np.packbits(presence(t, bits)).tobytes(), 1) for t in texts]}, schema)

    # at most `sample` pairs, so a fixed bound holds for what is sent, and of equal rows one comes back
    told = rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi").select("lang", "h", "text").mapInArrow(flags, "lang string, h bigint, flags binary")
    got = sorted((r["lang"], r["h"], bytes(r["flags"])) for r in told.groupBy("lang", "h").agg(F.min("flags").alias("flags")).collect())
    return fit([r[0] for r in got], [np.frombuffer(zlib.decompress(r[2]), dtype=np.uint8) for r in got])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = predict(shared.value, b.column(2).to_pylist())
            yield batch({"doc_id": b.column(0).to_pylist(), "held_out": b.column(1).to_pylist(), "lang_pred": names, "score": scores}, schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs))
