"""Secret scanning with inferred grammars.

Credentials found by three fixed formats are the labelled examples. Per format they make a prefix tree whose states merge,
depth by depth, when the frequencies of ending and of each next character agree within Hoeffding bounds over a look-ahead
of ``LOOK`` characters. That leaves an acyclic probabilistic automaton which keeps prefixes, separators and lengths in its
states; beyond ``DEPTH`` characters all states are one. Next characters are smoothed by their kind (digits, letters by
half of the alphabet and case, signs), so unseen keys of a known format stay likely.

Every further candidate, a maximal run of credential characters of any length, is scored by its likelihood under each automaton: for
each character, and for its end. It is added as kind ``format`` if its characters are no less likely than the ``QUANTILE`` least likely
of examples left out in turn while learning (two fifths of their spread of grace), its end no less than the least of theirs (``SLACK``
of grace), and its characters likelier by ``MARGIN`` each than in ordinary text. Lengths are the automaton's own: an end is unlikely where none of many examples ends, and a
state that all examples end in makes a longer run impossible. The candidates of a batch are scored together, place by
place, and one drops out as soon as what is left could not lift it any more.

Bytes are counted over all documents, and the ``EXAMPLES`` examples per format are those of least hash among the base spans
of all documents; both come from one pass. Scanning covers every whole text.

Cases: null counts as the empty text, which has no spans; a format with fewer than ``FEWEST`` different examples has no
automaton and adds nothing; offsets are code points, ends exclusive; a null doc_id is a row like others; equal rows get
equal results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, binary_list, discard, materialize

#: The three base formats, in the order in which they are listed.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # a greedy run of 24 or more
WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

EXAMPLES, FEWEST, FOLDS, QUANTILE = 400, 8, 3, 0.05
ALPHA, LOOK, DEPTH, MARGIN, SLACK = 0.05, 3, 128, 1.0, 0.5
_CREDENTIAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_HEX_MAP = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
_IN_RUN = np.isin(np.arange(256), list(_CREDENTIAL))


def base_spans(data: bytes) -> list[tuple[int, int, int, bytes]]:
    """start, kind's place, end in bytes, and the credential itself."""
    found = []
    low = data.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(data) if len(m[2]) >= 6]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(data) if len(m[0]) >= 20]
    if b"x" * 24 in data.translate(_HEX_MAP):
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(data)]
    return sorted(found, key=lambda s: s[:2])


def _kinds() -> np.ndarray:
    """The kind of each byte: digits, a-f, g-z, A-F, G-Z, every credential sign by itself, and all others."""
    out = np.full(256, 5)
    for kind, (low, high) in enumerate(("09", "af", "gz", "AF", "GZ")):
        out[ord(low) : ord(high) + 1] = kind
    for k, sign in enumerate(b"+/_=-."):
        out[sign] = 6 + k
    return out


_KIND = _kinds()
_KIND_SIZES = np.bincount(_KIND)
_END = 256


class Automaton:
    """An acyclic probabilistic automaton. logs: for each state the log-probability of each byte and of the end; steps: where each byte leads."""

    def __init__(self, examples: list[bytes], alpha: float = ALPHA):
        self.bound = float(np.sqrt(0.5 * np.log(2 / alpha)))
        # each state as the examples that reach it, and how deep it stands
        reach, depth = [list(range(len(examples)))], [0]
        self.steps = [np.full(256, -1)]
        layer = [0]
        while layer:
            d = depth[layer[0]]
            nodes = []  # of the prefix tree below this layer
            for q in layer:
                by: dict[int, list[int]] = {}
                for e in reach[q]:
                    if len(examples[e]) > d:
                        by.setdefault(examples[e][d], []).append(e)
                nodes += [(own, q, c) for c, own in by.items()]
            nodes.sort(key=lambda x: (-len(x[0]), x[1], x[2]))
            if d + 1 == DEPTH:
                reach.append([e for own, _, _ in nodes for e in own])
                depth.append(DEPTH)
                self.steps.append(np.full(256, len(reach) - 1))
                for _, q, c in nodes:
                    self.steps[q][c] = len(reach) - 1
                break
            fresh: list[tuple[int, list[Counter]]] = []
            for own, q, c in nodes:
                seen = self._ahead(examples, own, d + 1)
                for state, counts in fresh:
                    if self._compatible(counts, seen):
                        reach[state] += own
                        for x, y in zip(counts, seen, strict=True):
                            x.update(y)
                        break
                else:
                    state = len(reach)
                    reach.append(list(own))
                    depth.append(d + 1)
                    self.steps.append(np.full(256, -1))
                    fresh.append((state, seen))
                self.steps[q][c] = state
            layer = [state for state, _ in fresh]
        self.logs = [self._smoothed(examples, own, d) for own, d in zip(reach, depth, strict=True)]
        for q, steps in enumerate(self.steps):  # a byte not seen leads where its kind does, else where most do
            seen = np.flatnonzero(steps >= 0)
            if len(seen):
                weight = self.logs[q][seen]
                usual = steps[seen[np.argmax(weight)]]
                for kind in range(len(_KIND_SIZES)):
                    alike = _KIND[seen] == kind
                    to = steps[seen[alike][np.argmax(weight[alike])]] if alike.any() else usual
                    steps[(_KIND == kind) & (steps < 0)] = to

    @staticmethod
    def _ahead(examples: list[bytes], own: list[int], d: int) -> list[Counter]:
        """What comes at d and the places after it: bytes, or the end."""
        return [Counter(examples[e][k] if len(examples[e]) > k else _END for e in own if len(examples[e]) >= k) for k in range(d, d + LOOK)]

    def _compatible(self, one: list[Counter], two: list[Counter]) -> bool:
        for x, y in zip(one, two, strict=True):
            n, m = x.total(), y.total()
            if n and m:
                most = self.bound * (n**-0.5 + m**-0.5)
                if any(abs(x[c] / n - y[c] / m) > most for c in x.keys() | y.keys()):
                    return False
        return True

    @staticmethod
    def _smoothed(examples: list[bytes], own: list[int], d: int) -> np.ndarray:
        counts = np.zeros(256)
        ends = 0
        for e in own:
            x = examples[e]
            if d == DEPTH:
                counts += np.bincount(np.frombuffer(x[d:], dtype=np.uint8), minlength=256)
                ends += 1
            elif len(x) > d:
                counts[x[d]] += 1
            else:
                ends += 1
        total = counts.sum() + ends
        kinds = np.bincount(_KIND, counts)
        share = (np.append(kinds + 0.1, ends + 0.01)) / (total + 0.1 * len(kinds) + 0.01)
        inside = (counts + 1) / (kinds + _KIND_SIZES)[_KIND]
        return np.log(np.append(share[:-1][_KIND] * inside, share[-1]))

    def score(self, text: bytes) -> tuple[float, float]:
        """Log-likelihood for each character, and of the end."""
        logs, steps = self.tables()
        at, total = 0, 0.0
        for c in text[:DEPTH]:
            total += logs[at, c]
            at = int(steps[at, c])
            if at < 0:  # a state that always ends here
                return -np.inf, -np.inf
        if len(text) > DEPTH:
            total += float(logs[at, np.frombuffer(text[DEPTH:], dtype=np.uint8)].sum())
        return float(total / max(1, len(text))), _end(float(logs[at, _END]), len(text))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """logs and steps of all states as two arrays."""
        if not hasattr(self, "_tables"):
            self._tables = np.stack(self.logs), np.stack(self.steps)
        return self._tables


def _end(log: float, size: int) -> float:
    """Log-likelihood of an end; beyond DEPTH also of not having ended before."""
    return log + max(0, size - DEPTH) * float(np.log1p(-min(np.exp(log), 1 - 1e-12)))


@dataclass
class Grammars:
    automata: list[tuple[Automaton, float, float]]  # with the least score of an accepted text's characters, and of its end
    plain: np.ndarray  # log-probability of each byte in ordinary text

    def likely(self, run: bytes) -> bool:
        raw = np.frombuffer(run, dtype=np.uint8)
        return bool(self.accepted(raw, np.array([0]), np.array([len(raw)]))[0])

    def accepted(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of the runs of bytes some automaton takes for one of its format."""
        size, out = ends - starts, np.zeros(len(starts), dtype=bool)
        if not self.automata or not len(starts):
            return out
        upto = np.concatenate([[0.0], np.cumsum(self.plain[raw])])
        usual = (upto[ends] - upto[starts]) / size
        for automaton, least, last in self.automata:
            logs, steps = automaton.tables()
            need = np.maximum(least, usual + MARGIN) * size
            rows, at, total = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts))
            for d in range(DEPTH + 1):
                over = size[rows] == d
                ended = rows[over]
                out[ended] |= (total[over] >= need[ended]) & (logs[at[over], _END] >= last)
                rows, at, total = rows[~over], at[~over], total[~over]
                if d == DEPTH or not len(rows):
                    break
                byte = raw[starts[rows] + d]
                total, at = total + logs[at, byte], steps[at, byte]
                alive = (at >= 0) & (total >= need[rows])  # what is left adds nothing above 0
                rows, at, total = rows[alive], at[alive], total[alive]
            for k, q, t in zip(rows.tolist(), at.tolist(), total.tolist(), strict=True):  # longer ones: all in one state
                rest = np.bincount(raw[starts[k] + DEPTH : ends[k]], minlength=256) @ logs[q][:256]
                out[k] |= t + rest >= need[k] and _end(float(logs[q][_END]), int(size[k])) >= last
        return out


def runs(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the candidates in texts that stand one after the other; cuts: where each starts, and the end."""
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = _IN_RUN[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[cuts] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    return starts, np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1


def _floor(scores: list[float]) -> float:
    low, middle = np.quantile(scores, [QUANTILE, 0.5]) if scores else (-np.inf, 0.0)
    return float(low - 0.4 * (middle - low))


def learn(examples: list[tuple[int, bytes]], plain: Counter) -> Grammars:
    automata = []
    for kind in range(3):
        own = sorted({e for k, e in examples if k == kind})
        if len(own) >= FEWEST:
            fold = [zlib.crc32(e) % FOLDS for e in own]
            scores = []
            for f in range(FOLDS):
                kept = [e for e, x in zip(own, fold, strict=True) if x != f]
                if kept:
                    rest = Automaton(kept)
                    scores += [x for x in (rest.score(e) for e, g in zip(own, fold, strict=True) if g == f) if np.isfinite(x[0])]
            automata.append((Automaton(own), _floor([x for x, _ in scores]), min((x for _, x in scores), default=-np.inf) - SLACK))
    total = sum(plain.values()) + 256
    return Grammars(automata, np.log([(plain[c] + 1) / total for c in range(256)]))


def scan_all(grammars: Grammars, texts: list[bytes]) -> list[list[tuple[int, int, int, bytes]]]:
    """For each text the base spans and the added ones, which overlap none of them."""
    cuts = np.cumsum([0] + [len(x) for x in texts])
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts, ends = runs(raw, cuts)
    taken = np.flatnonzero(grammars.accepted(raw, starts, ends))
    text_of = np.searchsorted(cuts, starts[taken], side="right") - 1
    out = [base_spans(x) for x in texts]
    for k, d in zip(taken.tolist(), text_of.tolist(), strict=True):
        start, end = int(starts[k] - cuts[d]), int(ends[k] - cuts[d])
        if not any(s[0] < end and start < s[2] for s in out[d] if s[1] != 3):
            out[d].append((start, 3, end, texts[d][start:end]))
    return [sorted(spans, key=lambda s: s[:2]) for spans in out]


def scan(grammars: Grammars, data: bytes) -> list[tuple[int, int, int, bytes]]:
    return scan_all(grammars, [data])[0]


def in_characters(data: bytes, spans: list) -> list[tuple[str, int, int]]:
    out, at, chars = [], 0, 0
    for start, kind, end, _ in spans:
        chars += len(data[at:start].decode("utf-8", "replace"))
        at = start
        out.append((KINDS[kind], chars, chars + len(data[start:end].decode("utf-8", "replace"))))
    return out


def train(docs: DataFrame) -> Grammars:
    part = docs.select(F.col("text").cast("string").alias("text"))
    schema = pa.schema([("kind", pa.int32()), ("value", pa.binary())])

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Credentials by kind; as kind -1 the counts of bytes of all texts."""
        counts = np.zeros(256, dtype=np.int64)
        for b in batches:
            out = {"kind": [], "value": []}
            for data in binary_list(b.column(0)):
                for _, kind, _, value in base_spans(data or b""):
                    out["kind"].append(kind)
                    out["value"].append(value)
                counts += np.bincount(np.frombuffer(data or b"", dtype=np.uint8), minlength=256)
            yield batch(out, schema)
        yield batch({"kind": [-1] * 256, "value": [bytes([c]) + n.to_bytes(8, "big") for c, n in enumerate(counts.tolist())]}, schema)

    found = materialize(part.mapInArrow(examples, "kind int, value binary"), "op3-examples")
    # of each format the examples of least hash; of the counts one row for each byte value
    counts = found.filter("kind < 0").select(F.conv(F.hex(F.substring("value", 1, 1)), 16, 10).cast("int").alias("byte"), F.conv(F.hex(F.substring("value", 2, 8)), 16, 10).cast("bigint").alias("n")).groupBy("byte").agg(F.sum("n").alias("n"))
    plain = Counter({r["byte"]: r["n"] for r in counts.collect()})
    chosen = []
    for kind in range(3):
        values = found.filter(F.col("kind") == kind).select("value").distinct().orderBy(F.xxhash64("value"), "value").limit(EXAMPLES)
        chosen += [(kind, bytes(r["value"])) for r in values.collect()]
    discard(found)
    return learn(chosen, plain)


def find(docs: DataFrame, grammars: Grammars) -> DataFrame:
    """doc_id, spans: array of (kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(grammars)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [data or b"" for data in binary_list(b.column(1))]
            found = zip(texts, scan_all(shared.value, texts), strict=True)
            out = [[{"kind": k, "start": s, "end": e} for k, s, e in in_characters(data, spans)] for data, spans in found]
            yield batch({"doc_id": b.column(0).to_pylist(), "spans": out}, schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint>>")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans."""
    found = find(docs, train(docs))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] != "format")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
