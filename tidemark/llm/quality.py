"""Quality classification from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the counts of all vote
patterns (at most 3^labellers of them, counted over every document) estimates how often each labeller votes which way on
good and on bad documents, and with that the posterior of each pattern. Posteriors of a bounded sample of documents (the
``SAMPLE`` of least hash of doc_id and text) are the soft labels of a linear scorer over hashed features, and the scorer decides.

Features: hashed 5-grams of byte classes (lower, upper, digit, space, line feed, stop, other sign, above ASCII) and marks
of repeated words, as roots of shares.

Cases: null and empty texts, and texts of white space, score 0 and are rejected; with no usable text nothing is learnt
and every score is 0; null and repeated doc_ids are ids like others, and of equal rows one is learnt from; equal rows get equal scores; texts are read whole, in blocks; other columns are not read.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, binary_list

BINS, BLOCK, SAMPLE, ROUNDS = 4096, 1 << 16, 4_000, 300
_CLASS = np.full(256, 7, dtype=np.uint16)
for _value, _chars in ((0, b"abcdefghijklmnopqrstuvwxyz"), (1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"0123456789"), (3, b" \t\x0b\x0c\r"), (4, b"\n"), (5, b".,;:?'\"()-")):
    _CLASS[list(_chars)] = _value
_CLASS[[c for c in range(128) if _CLASS[c] == 7]] = 6
#: Above ASCII: capital and small letters of Latin-1 differ in the second byte, which is left as it is.
_HASH = ((np.arange(8**5, dtype=np.uint32) * np.uint32(2654435761)) >> np.uint32(20)).astype(np.uint16)
LABELLERS = ("signs", "capitals", "echo", "variety", "stops", "runs", "length")


def measure(data: bytes) -> tuple[np.ndarray, list[int]]:
    """Hashed feature counts, and each labeller's vote: 1 good, 0 bad, 2 none."""
    counts = np.zeros(8**5)
    classes = np.zeros(8)
    words = echoes = distinct = blocks = letters = runs = bars = 0
    at = 0
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        piece = data[at:end]
        at = end
        codes = _CLASS[np.frombuffer(piece, dtype=np.uint8)]
        classes += np.bincount(codes, minlength=8)
        if len(codes) >= 5:
            code = codes[:-4]
            for k in range(1, 5):
                code = code * np.uint16(8) + codes[k : len(codes) - 4 + k]
            counts += np.bincount(code, minlength=8**5)
        own = piece.split()
        words += len(own)
        letters += sum(map(len, own))
        echoes += sum(map(operator.eq, own, own[1:]))
        distinct += len(set(own)) / max(1, len(own)) if len(own) >= 20 else 1
        blocks += 1
        raw = np.frombuffer(piece, dtype=np.uint8)
        runs += int(np.count_nonzero((raw[1:] == raw[:-1]) & (codes[1:] == 6)))
        bars += piece.count(b"|")
    features = np.bincount(_HASH, weights=counts, minlength=BINS)
    features[BINS - 1] += echoes * 5
    if words < 1:
        return features, [2] * len(LABELLERS)
    total, cased = max(1, len(data)), max(1, classes[0] + classes[1])
    share = lambda x, bad, good: 0 if x >= bad else 1 if x <= good else 2
    mean, variety = letters / words, distinct / max(1, blocks)
    features[BINS - 2] += (1 - variety) * total * 0.5
    votes = [
        share(classes[6] / total, 0.06, 0.02),
        share(classes[1] / cased, 0.4, 0.15) if cased >= 40 else 2,
        share(echoes / words, 0.15, 0.02),
        0 if variety < 0.25 else 1 if variety > 0.45 else 2,
        2 if words < 30 else 1 if words / 80 <= data.count(b".") else 0,
        share((runs + bars) / words, 0.1, 0.02),
        1 if 2 <= mean <= 12 else 2 if classes[7] > 0.5 * total else 0,  # scripts without spaces have no word length
    ]
    return features, votes


@dataclass
class Votes:
    prior: float
    good: np.ndarray  # labeller x vote, on good documents
    bad: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        a, b = np.full(len(pattern), np.log(self.prior)), np.full(len(pattern), np.log(1 - self.prior))
        for k in range(pattern.shape[1]):
            a, b = a + np.log(self.good[k, pattern[:, k]]), b + np.log(self.bad[k, pattern[:, k]])
        return 1 / (1 + np.exp(np.clip(b - a, -50, 50)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> Votes:
    """Expectation-maximisation, at first from the number of bad votes. Votes count as independent within a class; a
    labeller's table is smoothed by one document of each vote."""
    no = (patterns == 0).sum(axis=1)
    q = np.where(no >= 2, 0.1, np.where(no == 1, 0.4, 0.9))
    for _ in range(rounds):
        n = counts.sum()
        good, bad = (np.stack([np.bincount(patterns[:, k], weights=counts * w, minlength=3) + 1 for k in range(patterns.shape[1])]) for w in (q, 1 - q))
        model = Votes(float(np.clip((counts * q).sum() / n, 0.02, 0.98)), good / good.sum(axis=1, keepdims=True), bad / bad.sum(axis=1, keepdims=True))
        q = model.posterior(patterns)
    return model


def _scaled(features: np.ndarray) -> np.ndarray:
    return np.sqrt(features / np.maximum(1, features.sum(axis=-1, keepdims=True)))


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    prior: float = 0.0  # log-odds of a good document

    def score(self, features: np.ndarray) -> float:
        """A text of few features tells little: its log-odds are drawn to the prior's."""
        told = features.sum() / (features.sum() + 40)
        return float(1 / (1 + np.exp(-np.clip(told * (_scaled(features) @ self.weights + self.bias) + (1 - told) * self.prior, -50, 50))))


def fit(features: np.ndarray, targets: np.ndarray, rounds: int = ROUNDS) -> Scorer:
    """Logistic regression on soft labels by accelerated gradient steps; both classes weigh the same."""
    x = _scaled(features).astype(np.float32)
    mass = np.where(targets >= 0.5, 0.5 / max(1, (targets >= 0.5).sum()), 0.5 / max(1, (targets < 0.5).sum()))
    w, b, vw, vb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(x @ (w + 0.9 * vw) + b + 0.9 * vb, -50, 50))) - targets) * mass
        vw = 0.9 * vw - 6.0 * (x.T @ error.astype(np.float32) + 1e-5 * w)
        vb = 0.9 * vb - 6.0 * float(error.sum())
        w, b = w + vw, b + vb
    return Scorer(w, b)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def train(docs: DataFrame, sample: int = SAMPLE) -> Scorer | None:
    """Fits on the documents of at most `sample` least hashes of doc_id and text."""
    docs = _rows(docs)
    votes_schema = pa.schema([("pattern", pa.int32()), ("n", pa.int64())])

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for b in batches:
            for data in binary_list(b.column(0)):
                if data and data.strip():
                    code = int("".join(map(str, measure(data)[1])), 3)
                    found[code] = found.get(code, 0) + 1
        yield batch({"pattern": list(found), "n": list(found.values())}, votes_schema)

    counts = docs.select("text").mapInArrow(votes, "pattern int, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    if not counts:
        return None
    digits = lambda codes: np.array([[c // 3**k % 3 for k in reversed(range(len(LABELLERS)))] for c in codes])
    counts.sort(key=lambda r: r["pattern"])
    model = estimate(digits([r["pattern"] for r in counts]), np.array([float(r["n"]) for r in counts]))
    schema = pa.schema([("h", pa.int64()), ("pattern", pa.int32()), ("features", pa.binary())])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"h": [], "pattern": [], "features": []}
            for h, data in zip(b.column(0).to_pylist(), binary_list(b.column(1)), strict=True):
                if data and data.strip():
                    got, v = measure(data)
                    out["h"].append(h)
                    out["pattern"].append(int("".join(map(str, v)), 3))
                    out["features"].append(zlib.compress(got.astype(np.float32).tobytes(), 1))
            yield batch(out, schema)

    rows = sum(int(r["n"]) for r in counts)
    hashed = docs.select(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("h"), "text").filter("text IS NOT NULL")
    # a threshold leaves about twice as many hashes as are taken; the last one taken is the bound of what comes back
    near = hashed.filter(F.col("h") <= min((1 << 63) - 1, int(2**63 * (2 * sample + 50) / rows))).select("h").distinct()
    last = near.orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    told = hashed.filter(F.col("h") <= (-1 if last is None else last)).mapInArrow(features, "h bigint, pattern int, features binary")
    got = told.groupBy("h").agg(F.min("pattern").alias("pattern"), F.min("features").alias("features")).collect()
    got.sort(key=lambda r: r["h"])
    if not got:
        return None
    matrix = np.stack([np.frombuffer(zlib.decompress(bytes(r["features"])), dtype=np.float32) for r in got])
    scorer = fit(matrix, model.posterior(digits([r["pattern"] for r in got])))
    scorer.prior = float(np.log(model.prior / (1 - model.prior)))
    return scorer


def score(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """doc_id, score, good for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("good", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            scores = [model.score(measure(x)[0]) if model and x and x.strip() else 0.0 for x in binary_list(b.column(1))]
            yield batch({"doc_id": b.column(0).to_pylist(), "score": scores, "good": [s >= 0.5 for s in scores]}, schema)

    return _rows(docs).mapInArrow(run, "doc_id bigint, score double, good boolean")


def report(docs: DataFrame) -> DataFrame:
    return score(docs, train(docs))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the scorer accepts, with all their columns. No shuffle: each text is scored where it is."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = binary_list(b.column(b.schema.get_field_index("text")))
            yield b.filter(pa.array([bool(model and x and x.strip()) and model.score(measure(x)[0]) >= 0.5 for x in texts], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
