"""Word-piece counts by a linear longest-match automaton.

The vocabulary's trie has, at each node, the node to go on from when the next byte doesn't match, and the number of
pieces that the step gives off. One walk over a word's bytes thus counts the pieces of its greedy longest-match
segmentation without building or revisiting any. A word is a run without the bytes of ``WHITE``; its first piece is
matched with a space before it, the others without, as the public vocabularies' pieces are written. A word that the
vocabulary can't spell counts as one unknown piece.

Cases: null and empty texts have no words and no pieces; equal rows get equal results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load_ranks
from .common import batch, binary_list

#: A worker forgets the words that it has seen beyond so many, and never remembers those of more bytes.
CACHE, LONG, BLOCK = 300_000, 64, 1 << 20


class Automaton:
    def __init__(self, vocabulary: list[bytes]):
        self.step: dict[int, int] = {}
        ends, parents = [False], [(0, 0)]
        for piece in vocabulary:
            node = 0
            for c in piece:
                key = node << 8 | c
                if key not in self.step:
                    self.step[key] = len(ends)
                    ends.append(False)
                    parents.append((node, c))
                node = self.step[key]
            if piece:
                ends[node] = True
        self.fall, self.pops = [-1] * len(ends), [0] * len(ends)
        level: dict[int, int] = {0: 0}
        order = sorted(range(1, len(ends)), key=lambda v: level.setdefault(v, level[parents[v][0]] + 1))
        for v in order:
            if ends[v]:
                self.fall[v], self.pops[v] = 0, 1
                continue
            up, c = parents[v]
            pops, z = self.pops[up], self.fall[up]
            while z >= 0 and (z << 8 | c) not in self.step:
                pops, z = pops + self.pops[z], self.fall[z]
            if z >= 0:
                self.fall[v], self.pops[v] = self.step[z << 8 | c], pops
        self.seen: dict[bytes, int] = {}

    def pieces(self, word: bytes) -> int:
        """The number of pieces of b" " + word."""
        step, fall, pops = self.step.get, self.fall, self.pops
        node, n = 0, 0
        for c in b" " + word:
            to = step(node << 8 | c)
            while to is None:
                n += pops[node]
                node = fall[node]
                if node < 0:
                    return 1
                to = step(node << 8 | c)
            node = to
        while node:
            n += pops[node]
            node = fall[node]
            if node < 0:
                return 1
        return n

    def count(self, data: bytes) -> tuple[int, int]:
        """Words and pieces of a text, block by block."""
        n_words = n_pieces = at = 0
        while at < len(data):
            end = at + BLOCK
            while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
                end += 1
            words = data[at:end].split()
            if len(self.seen) > CACHE:
                self.seen.clear()
            seen = self.seen
            fresh = set(words).difference(seen)
            for w in fresh:
                seen[w] = self.pieces(w)
            n_words, n_pieces, at = n_words + len(words), n_pieces + sum(map(seen.__getitem__, words)), end
            for w in fresh:
                if len(w) > LONG:
                    del seen[w]
        return n_words, n_pieces


_MADE: dict[str, Automaton] = {}


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_pieces. path: a rank file; its tokens are the vocabulary, of a fixed size."""
    vocabulary = load_ranks(path)
    key = hashlib.sha256(b"".join(len(x).to_bytes(4, "little") + x for x in vocabulary)).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_pieces", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = Automaton(shared.value)
        automaton = _MADE[key]
        for b in batches:
            counts = [automaton.count(x or b"") for x in binary_list(b.column(1))]
            yield batch({"doc_id": b.column(0).to_pylist(), "n_words": [c[0] for c in counts], "n_pieces": [c[1] for c in counts]}, schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_pieces bigint")
