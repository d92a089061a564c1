"""Benchmark decontamination with an FM-index per shard of the training text.

A shard is one Arrow batch of documents. Its words become symbols of the benchmark's vocabulary; words outside it can't
be part of an occurrence, so only runs of at least the shortest window's length stay, with separators between them. The
suffix order of that text gives its Burrows-Wheeler transform, held as a wavelet matrix whose ranks drive a backward
search of all windows at once. Suffix positions are sampled at every ``STEP``-th place and at each run's start; others
are located by walking back to one. Located occurrences are compared byte by byte and merged into removal spans.

Words are runs of ASCII letters (in lower case), digits and bytes above ASCII. A window is ``WINDOW`` consecutive words of
an item; an item of fewer words is one window. The benchmark is read in blocks of about ``BLOCK_CHARS`` characters, an item
longer than half of that in parts that overlap. Each block is one pass over the documents, written before the next block is
read, so what is broadcast, and what the driver and a worker hold, has a fixed bound.

Cases: null and empty texts have no words and no hits; items without words match nothing; items that share an id count as
one; a null item_id counts as the empty string; equal rows get equal results; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, batch, discard, materialize, texts_of, words_of

WINDOW, STEP, BLOCK_CHARS = 10, 8, 8_000_000
_WORD = np.zeros(256, dtype=bool)
_ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


class Wavelet:
    """A wavelet matrix: for each bit from the highest, the number of ones before each place."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        here = symbols
        for k in reversed(range(self.bits)):
            bit = (here >> k) & 1
            self.ones.append(np.concatenate([np.zeros(1, np.int64), np.cumsum(bit)]))
            self.zeros.append(int(len(here) - self.ones[-1][-1]))
            here = np.concatenate([here[bit == 0], here[bit == 1]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        start, end = np.zeros_like(places), places
        for level, k in enumerate(reversed(range(self.bits))):
            ones, zeros, up = self.ones[level], self.zeros[level], ((symbols >> k) & 1).astype(bool)
            start = np.where(up, zeros + ones[start], start - ones[start])
            end = np.where(up, zeros + ones[end], end - ones[end])
        return end - start

    def access(self, places: np.ndarray) -> np.ndarray:
        value, at = np.zeros_like(places), places
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            up = ones[at + 1] > ones[at]
            value = value * 2 + up
            at = np.where(up, zeros + ones[at], at - ones[at])
        return value


class FMIndex:
    """text: symbols from 1 on, with 0 after each run. first: the places where runs start."""

    def __init__(self, text: np.ndarray, first: np.ndarray, step: int = STEP):
        n = len(text)
        # separators differ from each other, so that an order is reached after the longest repeat within a run
        rank = np.where(text == 0, np.cumsum(text == 0) - 1, text + np.count_nonzero(text == 0)).astype(np.int64)
        _, rank = np.unique(rank, return_inverse=True)
        order, width = np.argsort(rank, kind="stable"), 1
        while True:
            later = np.zeros(n, dtype=np.int64)
            later[: max(0, n - width)] = rank[width:] + 1
            key = rank * (n + 2) + later
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1:
                break
            width *= 2
        self.sigma = int(text.max()) + 1
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))]).astype(np.int64)
        self.tree = Wavelet(text[order - 1].astype(np.int64), self.sigma)
        marked = np.zeros(n, dtype=bool)
        marked[::step] = True
        marked[first] = True
        self.sampled = marked[order]
        self.nth = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows of symbols, left-aligned): the range of each in suffix order."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.below[-1])
        for k in range(phrases.shape[1]):
            live = (k < lengths) & (low < high)
            if not live.any():
                break
            c = phrases[live, lengths[live] - 1 - k]
            low[live] = self.below[c] + self.tree.rank(c, low[live])
            high[live] = self.below[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order, by walking back to sampled ones."""
        out, walked, rows = np.zeros(len(rows), dtype=np.int64), 0, rows.copy()
        todo = np.arange(len(rows))
        while len(todo):
            done = self.sampled[rows[todo]]
            out[todo[done]] = self.positions[self.nth[rows[todo[done]]]] + walked
            todo = todo[~done]
            c = self.tree.access(rows[todo])
            rows[todo] = self.below[c] + self.tree.rank(c, rows[todo])
            walked += 1
        return out


@dataclass
class Phrases:
    """A block of the benchmark: its vocabulary by hash, its windows and the items that hold each."""

    hashes: np.ndarray  # sorted; symbol k + 1 is hashes[k]
    quick: np.ndarray  # a flag for each leading part of a hash
    windows: np.ndarray
    lengths: np.ndarray
    texts: list[bytes]  # a window's words with one space between them
    items: list[tuple[str, ...]]


def phrases_of(items: list[tuple[str, str | None]], window: int = WINDOW) -> Phrases | None:
    found: dict[bytes, set[str]] = {}
    hashes: dict[bytes, int] = {}
    for item, text in items:
        raw = np.frombuffer((text or "").encode("utf-8", "replace").translate(ASCII_LOWER), dtype=np.uint8)
        starts, ends, codes = words_of(raw, np.zeros(1, dtype=np.int64), _WORD)
        words = [raw[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
        hashes.update(zip(words, codes.tolist(), strict=True))
        for k in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(b" ".join(words[k : k + window]), set()).add(item)
    if not found:
        return None
    table = np.unique(np.array(list(hashes.values()), dtype=np.uint64))
    quick = np.zeros(1 << 20, dtype=bool)
    quick[table >> np.uint64(44)] = True
    texts = sorted(found)
    symbols = [[int(np.searchsorted(table, np.uint64(hashes[w]))) + 1 for w in t.split(b" ")] for t in texts]
    windows = np.zeros((len(texts), window), dtype=np.int64)
    for row, s in zip(windows, symbols, strict=True):
        row[: len(s)] = s
    return Phrases(table, quick, windows, np.array([len(s) for s in symbols]), texts, [tuple(sorted(found[t])) for t in texts])


def occurrences(phrases: Phrases, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first words of all occurrences in a shard, and the window of each."""
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(phrases.quick[codes >> np.uint64(44)])
    place = np.minimum(np.searchsorted(phrases.hashes, codes[at]), len(phrases.hashes) - 1)
    hit = phrases.hashes[place] == codes[at]
    at, symbol = at[hit], place[hit] + 1
    if not len(at):
        return none
    new = np.concatenate([[True], (np.diff(at) != 1) | (doc_of[at[1:]] != doc_of[at[:-1]])])
    run = np.cumsum(new) - 1
    long = np.bincount(run)[run] >= phrases.lengths.min()
    at, symbol, run = at[long], symbol[long], run[long]
    if not len(at):
        return none
    first = np.concatenate([[True], np.diff(run) != 0])
    # room for a separator after each run
    slot = np.arange(len(at)) + np.cumsum(first) - 1
    used, dense = np.unique(symbol, return_inverse=True)
    text, word = np.zeros(slot[-1] + 2, dtype=np.int64), np.full(slot[-1] + 2, -1, dtype=np.int64)
    text[slot], word[slot] = dense + 1, at
    index = FMIndex(text, slot[first])
    # windows all of whose words occur in this shard
    known = np.zeros(len(phrases.hashes) + 1, dtype=np.int64)
    known[used] = np.arange(1, len(used) + 1)
    mapped = known[phrases.windows]
    asked = np.flatnonzero((mapped > 0).sum(axis=1) == phrases.lengths)
    low, high = index.search(mapped[asked], phrases.lengths[asked])
    counts = np.maximum(0, high - low)
    if not counts.sum():
        return none
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    which, where = np.repeat(asked, counts), word[index.locate(rows)]
    data = raw.tobytes()
    sure = [b" ".join(data[starts[w + i] : ends[w + i]] for i in range(phrases.lengths[k])) == phrases.texts[k] for w, k in zip(where.tolist(), which.tolist(), strict=True)]
    return where[sure], which[sure]


_CARRY = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
_FINAL = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("byte_spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _shard(phrases: Phrases | None, b: pa.RecordBatch, last: bool) -> pa.RecordBatch:
    """Adds what one block of the benchmark finds in one batch."""
    ids, earlier, named = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
    data, cuts = texts_of(b.column(1), ASCII_LOWER)
    raw = np.frombuffer(data, dtype=np.uint8)
    starts, ends, codes = words_of(raw, cuts, _WORD)
    doc_of = np.searchsorted(cuts[1:], starts, side="right")
    first_word = np.searchsorted(doc_of, np.arange(len(ids) + 1))
    step = np.zeros(len(starts) + 1, dtype=np.int64)
    items: list[set[str]] = [set(x or ()) for x in named]
    for d, spans in enumerate(earlier):
        for s, e in zip((spans or [])[::2], (spans or [])[1::2], strict=True):
            step[first_word[d] + s] += 1
            step[first_word[d] + e] -= 1
    if phrases is not None and len(starts):
        where, which = occurrences(phrases, raw, starts, ends, codes, doc_of)
        np.add.at(step, where, 1)
        np.add.at(step, where + phrases.lengths[which], -1)
        for d, k in set(zip(doc_of[where].tolist(), which.tolist(), strict=True)):
            items[d].update(phrases.items[k])
    hit = np.cumsum(step[:-1]) > 0
    spans, byte_spans = [], []
    totals = np.concatenate([[0], np.cumsum(hit)])
    n_hit = (totals[first_word[1:]] - totals[first_word[:-1]]).tolist()
    for d, n in enumerate(n_hit):
        own: list[int] = []
        if n:
            part = np.concatenate([[0], hit[first_word[d] : first_word[d + 1]].astype(np.int8), [0]])
            edges = np.flatnonzero(np.diff(part))
            own = edges.tolist()
        spans.append(own)
        f = first_word[d]
        byte_spans.append([int((starts[f + x] if k % 2 == 0 else ends[f + x - 1]) - cuts[d]) for k, x in enumerate(own)])
    named = [sorted(x) for x in items]
    if last:
        return batch({"doc_id": ids, "n_words": np.diff(first_word).tolist(), "n_hit": n_hit, "byte_spans": byte_spans, "items": named}, _FINAL)
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.list_(pa.int64())), pa.array(named, pa.list_(pa.string()))], schema=_CARRY)


_ITEMS = pa.schema([("item_id", pa.string()), ("text", pa.string())])


def _parts(text: str, window: int, chars: int) -> Iterator[str]:
    """A text in parts of about so many characters, each with the last window - 1 words of the one before."""
    if len(text) <= chars:
        yield text
        return
    starts: list[int] = []
    begin = 0
    for m in _ITEM_WORD.finditer(text):
        starts.append(m.start())
        if m.end() - begin >= chars and len(starts) >= window:
            yield text[begin : m.end()]
            starts = starts[len(starts) - window + 1 :] if window > 1 else []
            begin = starts[0] if starts else m.end()
    if len(starts) >= window:
        yield text[begin:]


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> Iterator[Phrases | None]:
    """The benchmark's phrases, one block after the other. Different items, long ones in parts, are dealt by hash; a block holds about block_chars characters."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for part in _parts(text, window, max(1, block_chars // 2)):
                    yield batch({"item_id": [item], "text": [part]}, _ITEMS)

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    chars, longest = rows.agg(F.sum(F.length("text")), F.max(F.length("text"))).first()
    blocks = max(1, -(-(chars or 0) // block_chars))
    if (longest or 0) > block_chars // 2:
        rows = rows.mapInArrow(split, "item_id string, text string")
    for k in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield phrases_of([(r["item_id"], r["text"]) for r in part.collect()], window)


def _in_turn(rows: DataFrame, benchmark: DataFrame, step, window: int, block_chars: int) -> DataFrame:
    """step(rows, shared, last) for each block. Of several blocks, each is done and forgotten, by driver and workers, before the next is read."""
    sc, before, waiting = rows.sparkSession.sparkContext, None, None
    for phrases in benchmark_blocks(benchmark, window, block_chars):
        if waiting is not None:
            rows = materialize(step(rows, waiting, False), "op7-block")
            waiting.destroy()
            if before is not None:
                discard(before)
            before = rows
        waiting = sc.broadcast(phrases)
    return step(rows, waiting, True)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, byte_spans (start, end, start, end, ...; merged), items. No shuffle."""

    def step(rows: DataFrame, shared, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _shard(shared.value, b, last)

        return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_hit bigint, byte_spans array<bigint>, items array<string>" if last else "doc_id bigint, text string, spans array<bigint>, items array<string>")

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("array<bigint>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    return _in_turn(rows, benchmark, step, window, block_chars)


def remove_spans(text: str, byte_spans: list[int]) -> str:
    """The text without its removal spans."""
    data, out, at = text.encode(), [], 0
    for s, e in zip(byte_spans[::2], byte_spans[1::2], strict=True):
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that hold no occurrence of any window, with all their columns. No shuffle."""

    def step(rows: DataFrame, shared, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                none = pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.list_(pa.int64())), pa.nulls(len(b), pa.list_(pa.string()))
                text = b.column(b.schema.get_field_index("text"))
                part = pa.RecordBatch.from_arrays([none[0], text, none[1], none[2]], schema=_CARRY)
                hits = _shard(shared.value, part, True).column(2).to_pylist()
                yield b.filter(pa.array([n == 0 for n in hits], type=pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    return _in_turn(docs, benchmark, step, window, block_chars)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return find(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
