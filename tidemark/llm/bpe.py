"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has exactly one valid encoding, so exactly one valid last token. ``last[i]`` holds it for the
prefix of i bytes: the one token t ending there for which the token before it, ``last[i - len(t)]``, may stand in front
of t. Two tokens may stand side by side when undoing their merges, latest first, never shows a pair that would have
merged across the border before. The table grows by one entry for each byte appended, and a change at byte i leaves the
entries up to i as they are.

Cases: null counts as the empty text, which has no ids; empty text decodes to empty bytes; no part of a text is left out;
equal rows give equal results; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

#: A worker forgets the pieces that it has seen beyond so many, and remembers none of more characters: a cache, not a limit on texts.
CACHE, LONG = 250_000, 64
#: Fixed value: the public split pattern for which the way by spaces holds.
GPT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE_BEFORE_WHITE = regex.compile(r" (?:\s|$)")
#: A space between two signs that aren't white: no match reaches over it from its left.
LONE_SPACE = regex.compile(r"(?<=\S) (?=\S)")


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Merges:
    """A vocabulary with the pair that each token is made of. Tokens that no merges lead to stand alone: only a whole piece can be one."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.pairs: dict[tuple[int, int], int] = {}
        self.usable = [False] * len(tokens)
        for i, token in enumerate(tokens):
            self.usable[i] = len(token) == 1
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut], i), self.ids.get(token[cut:], i)
                if a < i and b < i and self.usable[a] and self.usable[b] and self.side_by_side(a, b, i):
                    self.left[i], self.right[i], self.usable[i] = a, b, True
                    self.pairs[a, b] = i
                    break
        #: A trie of the usable tokens from their last byte to their first: each node's steps, byte to node; node to token.
        self.back: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for i, token in enumerate(tokens):
            if self.usable[i]:
                node = 0
                for byte in reversed(token):
                    if byte not in self.back[node]:
                        self.back[node][byte] = len(self.token_at)
                        self.token_at.append(-1)
                        self.back.append({})
                    node = self.back[node][byte]
                self.token_at[node] = i
        self.fits: dict[tuple[int, int], bool] = {}

    def side_by_side(self, a: int, b: int, before: int) -> bool:
        """Whether a and b, each made by merges of a rank below `before`, stand with no merge across their border."""
        limit, pairs, left, right = before, self.pairs, self.left, self.right
        while True:
            met = pairs.get((a, b), limit)
            if met < limit:
                return False
            part_a, part_b = right[a], left[b]
            if part_a == a and part_b == b:
                return True
            if part_a != a and (part_b == b or a > b):
                limit, a = a, part_a
            else:
                # merges of one rank go from left to right, so a pair of b's own rank across the border comes first
                limit, b = b + 1, part_b

    def fit(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > CACHE:
                self.fits.clear()
            known = self.fits[key] = self.side_by_side(a, b, len(self.tokens))
        return known


class Prefixes:
    """The last tokens of all prefixes of one piece."""

    def __init__(self, merges: Merges, piece: bytes = b""):
        self.merges, self.piece, self.last = merges, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        start, self.piece = len(self.piece), self.piece + more
        piece, last = self.piece, self.last
        back, token_at, fits, fit = self.merges.back, self.merges.token_at, self.merges.fits, self.merges.fit
        try:
            for end in range(start + 1, len(piece) + 1):
                node, at = 0, end
                while at:
                    at -= 1
                    node = back[node][piece[at]]
                    token = token_at[node]
                    if token >= 0:
                        before = last[at]
                        if before < 0:
                            break
                        fine = fits.get(before << 32 | token)
                        if fit(before, token) if fine is None else fine:
                            break
                last.append(token)
        except KeyError:
            raise ValueError("the vocabulary lacks a byte") from None

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Replaces bytes start..stop; the prefixes up to start keep their entries."""
        tail = self.piece[stop:]
        self.piece, self.last = self.piece[:start], self.last[: start + 1]
        self.append(new + tail)

    def ids(self) -> list[int]:
        whole = self.merges.ids.get(self.piece)
        if whole is not None:
            return [whole]
        out, at = [], len(self.piece)
        while at:
            out.append(self.last[at])
            at -= len(self.merges.tokens[out[-1]])
        return out[::-1]


class Codec:
    """Encodes and decodes whole texts: each match of the pattern is a piece of its own."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.merges, self.split = Merges(tokens), regex.compile(pattern)
        self.by_space = pattern == GPT_PATTERN
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, units: list[str], lead: str) -> None:
        """Ids of units not met yet. In sorted order neighbours share prefixes, whose last tokens are kept."""
        if len(self.units) > CACHE:
            self.older, self.units = self.units, {}
        table = Prefixes(self.merges)
        pieces: dict[str, bytes] = {}
        todo = []
        for u in set(units).difference(self.units):
            old = self.older.get(u)
            if old is None:
                todo.append(u)
            else:
                self.units[u] = old
        for u in sorted(todo):
            parts = []
            for piece in self.split.findall(lead + u):
                ids = pieces.get(piece)
                if ids is None:
                    data = piece.encode("utf-8", "replace")
                    whole = self.merges.ids.get(data)
                    if whole is None:
                        common = 0
                        for x, y in zip(data, table.piece):
                            if x != y:
                                break
                            common += 1
                        table.edit(common, len(table.piece), data[common:])
                    ids = pieces[piece] = array("I", table.ids() if whole is None else [whole]).tobytes()
                parts.append(ids)
            self.units[u] = b"".join(parts)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers.

        No match reaches from its left over a space between two signs that aren't white, so the text's parts between
        such spaces, each with the space before it, are encoded on their own and remembered.
        """
        if not self.by_space:
            table, parts, known = Prefixes(self.merges), [], {}
            for piece in self.split.findall(text):
                if piece not in known:
                    table.edit(0, len(table.piece), piece.encode("utf-8", "replace"))
                    known[piece] = array("I", table.ids()).tobytes()
                parts.append(known[piece])
            return b"".join(parts)
        # the plain split cuts before and after other white space too, which holds where no space stands before it
        first, *units = LONE_SPACE.split(text) if SPACE_BEFORE_WHITE.search(text) else text.split(" ")
        # the first part has no space before it, so it is not remembered
        head = []
        for piece in self.split.findall(first):
            head += Prefixes(self.merges, piece.encode("utf-8", "replace")).ids()
        self._learn(units, " ")
        out = array("I", head).tobytes() + b"".join(map(self.units.__getitem__, units))
        for u in units:
            if len(u) > LONG:
                self.units.pop(u, None)
        return out

    def encode(self, text: str) -> array:
        out = array("I")
        out.frombytes(self.encode_bytes(text))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.merges.tokens.__getitem__, ids))


class Text:
    """A text with its pieces, for appends and edits: pieces before the edit stay, and those after it once the split falls in step again."""

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.text = codec, text
        self.spans = [m.span() for m in codec.split.finditer(text)]

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replaces code points start..stop; the count of pieces split anew."""
        text = self.text[:start] + new + self.text[stop:]
        # a piece's end depends on what follows it, by one code point past the white space that it ends in
        keep = 0
        while keep < len(self.spans) and self.spans[keep][1] < start:
            keep += 1
        keep = max(0, keep - 2)
        old = {s: k for k, (s, _) in enumerate(self.spans) if s >= stop}
        shift, spans = len(new) - (stop - start), self.spans[:keep]
        at, fresh = (spans[-1][1] if spans else 0), 0
        for m in self.codec.split.finditer(text, at):
            k = old.get(m.start() - shift) if m.start() >= start + len(new) else None
            if k is not None:
                spans += [(s + shift, e + shift) for s, e in self.spans[k:]]
                break
            spans.append(m.span())
            fresh += 1
        self.text, self.spans = text, spans
        return fresh

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def ids(self) -> array:
        return array("I", chain.from_iterable(Prefixes(self.codec.merges, self.text[s:e].encode("utf-8", "replace")).ids() for s, e in self.spans))


_CODECS: dict[str, Codec] = {}
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_FULL = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def _codec(blob, pattern: str) -> Codec:
    """One codec in each worker process. blob: the vocabulary, of a fixed size, as the driver read it."""
    tokens = blob.value
    key = hashlib.sha256(b"".join(tokens) + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(tokens, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded: the text made of the ids."""
    blob = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(blob, pattern)
        for b in batches:
            rows = {f.name: [] for f in _FULL}
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = codec.encode(text or "")
                for name, value in zip(rows, (doc_id, ids.tobytes(), codec.decode(ids).decode("utf-8")), strict=True):
                    rows[name].append(value)
            yield batch(rows, _FULL)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, ids binary, decoded string")


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    blob = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(blob, pattern)
        for b in batches:
            rows = {f.name: [] for f in _SCHEMA}
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = codec.encode(text or "")
                values = (doc_id, len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest())
                for name, value in zip(rows, values, strict=True):
                    rows[name].append(value)
            yield batch(rows, _SCHEMA)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
