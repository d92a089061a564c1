"""Substring dedup by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one text. Its minimiser is the least hash among the ``GRAM``-word grams in it.
Consecutive windows with the same minimiser travel as one packed string, their words with one space between them, to the
bucket of that minimiser, where equal windows meet: sorting a bucket's windows shows the smallest doc_id of each exactly.

1. Each text gives the minimisers of its windows. Minimisers that fewer than two documents have are dropped: their windows
   stand in one document only. No string has travelled so far.
2. Texts that have shared minimisers send those super-k-mers, packed, to the minimisers' buckets.
3. In a bucket equal strings count once, the others' windows are sorted, and what stands in a document of smaller doc_id
   goes back to its text as ranges of words. A bucket of more than ``HOT`` super-k-mers isn't gathered: its distinct strings
   are found by aggregation and their windows are grouped by content over all machines.

Minimisers, strings and windows are counted by partial aggregation, and what is known of them joins back with every key of
more than one in ``SPREAD`` rows salted (there are fewer than ``SPREAD`` such keys), so no key has to pass through one task. Texts
meet what is known of them by id and a hash of the text, joins that adaptive execution splits where rows repeat; rows without
an id stay where they are. Packed
strings and found ranges are written tables, each dropped with its shuffle files once the next one stands: texts travel
twice, to be packed and to be cut, and strings are packed once.

Cases: null and empty texts have no words; texts of fewer words than a window lose none; a repeat within one document, or
in rows that share its doc_id, doesn't count; a null doc_id neither loses words nor makes others lose them; equal rows get
equal results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UNSPACED, batch, binary_list, discard, grams, materialize, texts_of, words_of

WINDOW, GRAM, HOT = 50, 8, 2_000
SPREAD, SALTS = 5_000, 32

_PAIR = pa.schema([("minimiser", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("n", pa.int32())])
_SUPER = pa.schema([("minimiser", pa.int64()), ("hot", pa.bool_()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("packed", pa.binary())])
_RANGE = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("ranges", pa.list_(pa.int32()))])
_DISTINCT = pa.schema([("packed", pa.binary()), ("least", pa.int64()), ("place", pa.int32()), ("window", pa.binary())])


def super_kmers(codes: np.ndarray, doc_of: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer; windows are named by their first word."""
    n = len(codes) - window + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return none, none, none
    least, width, span = grams(codes, gram), 1, window - gram + 1
    while width * 2 <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    whole = np.flatnonzero(doc_of[:n] == doc_of[window - 1 :])
    if not len(whole):
        return none, none, none
    value = least[whole].astype(np.int64)
    fresh = np.concatenate([[True], (np.diff(whole) != 1) | (np.diff(value) != 0) | (np.diff(doc_of[whole]) != 0)])
    first = np.flatnonzero(fresh)
    return whole[first], np.diff(np.concatenate([first, [len(whole)]])), value[first]


def _words(b: pa.RecordBatch, column: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, cuts = texts_of(b.column(column))
    starts, ends, codes = words_of(np.frombuffer(data, dtype=np.uint8), cuts, UNSPACED)
    return data, starts, ends, codes, np.searchsorted(cuts[1:], starts, side="right")


def runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Rows sorted by their first column, as batches of whole keys; a key of more than `limit` rows comes in parts, marked."""
    carry, hot = None, None
    for b in batches:
        if not len(b):
            continue
        if carry is not None:
            b = pa.concat_batches([carry, b]) if len(carry) else b
            carry = None
        keys = b.column(0).to_numpy(zero_copy_only=False)
        if hot is not None:
            end = int(np.searchsorted(keys != hot, True)) if keys[-1] != hot else len(keys)
            if end:
                yield b.slice(0, end), True
            if end == len(keys):
                continue
            b, keys, hot = b.slice(end), keys[end:], None
        last = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if keys[0] != keys[-1] else 0
        if last:
            # keys that are hot within this batch are parted off
            edges = np.concatenate([[0], np.flatnonzero(keys[1:last] != keys[: last - 1]) + 1, [last]])
            at = 0
            for k in np.flatnonzero(np.diff(edges) > limit):
                if edges[k] > at:
                    yield b.slice(at, edges[k] - at), False
                yield b.slice(edges[k], edges[k + 1] - edges[k]), True
                at = edges[k + 1]
            if last > at:
                yield b.slice(at, last - at), False
        carry = b.slice(last)
        if len(carry) > limit:
            yield carry, True
            hot, carry = keys[-1], None
    if carry is not None and len(carry):
        yield carry, False


def _joined(rows: DataFrame, facts: DataFrame, key: str, counted: DataFrame) -> DataFrame:
    """rows joined with facts, which has one row a key at most. counted is a written table with the number n of each key's
    rows. Frequent keys are dealt out by a hash of the whole row, the same whenever a task runs again."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    frequent = F.broadcast(counted.filter((F.col("n") * SPREAD > total) & (F.col("n") > SALTS)).select(F.xxhash64(key).alias("_hash")).distinct().withColumn("_wide", F.lit(True)))
    marked = lambda df: df.withColumn("_hash", F.xxhash64(key)).join(frequent, "_hash", "left").drop("_hash")
    dealt = marked(rows).withColumn("_salt", F.when(F.col("_wide"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0))
    every = F.when(F.col("_wide"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.drop("_wide").join(marked(facts).withColumn("_salt", F.explode(every)).drop("_wide"), [key, "_salt"]).drop("_salt")


def shared_minimisers(docs: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """minimiser, doc_id, tag, hot: the minimisers that windows of two documents at least have; a written table."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, _, codes, doc_of = _words(b, 2)
            first, _, value = super_kmers(codes, doc_of, window, gram)
            ids, tags = (b.column(k).to_numpy(zero_copy_only=False)[doc_of[first]] for k in range(2))
            got, n = np.unique(np.stack([value, ids, tags]), axis=1, return_counts=True) if len(value) else (np.zeros((3, 0), dtype=np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in got), pa.array(n.astype(np.int32))], schema=_PAIR)

    rows = materialize(docs.select("doc_id", "tag", "text").mapInArrow(pairs, "minimiser bigint, doc_id bigint, tag bigint, n int"), "op4-pairs")
    seen = rows.groupBy("minimiser").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.sum("n").alias("strings"), F.count("*").alias("n"))
    shared = materialize(seen.filter("least < most").select("minimiser", (F.col("strings") > hot).alias("hot"), "n"), "op4-minimisers")
    out = materialize(_joined(rows.drop("n"), shared.drop("n"), "minimiser", shared), "op4-shared")
    discard(rows, shared)
    return out


def _bucket_ranges(rows: list[tuple], window: int) -> Iterator[tuple]:
    """One bucket: rows of doc_id, tag, start, packed. Yields doc_id, tag, ranges of repeated words."""
    least: dict[bytes, int] = {}
    for doc_id, _, _, packed in rows:
        least[packed] = min(doc_id, least.get(packed, doc_id))
    if len(least) > 1:
        cut: dict[bytes, list[int]] = {}
        entries = []
        for packed, doc_id in least.items():
            places = [-1, *(i for i, c in enumerate(packed) if c == 32), len(packed)]
            cut[packed] = places
            for k in range(len(places) - window):
                entries.append((packed[places[k] + 1 : places[k + window]], doc_id, packed, k))
        entries.sort(key=lambda e: e[:2])
        repeated: dict[bytes, list[int]] = {}
        content, first = None, 0
        for piece, doc_id, packed, k in entries:
            if piece != content:
                content, first = piece, doc_id
            elif first < doc_id:
                repeated.setdefault(packed, []).append(k)
    else:
        repeated = {}
    for doc_id, tag, start, packed in rows:
        if least[packed] < doc_id:
            yield doc_id, tag, [start, start + packed.count(b" ") + 1]
        elif packed in repeated:
            yield doc_id, tag, [x for k in merged(sorted(repeated[packed]), window) for x in (start + k[0], start + k[1])]


def merged(places: list[int], window: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in places:
        if out and p <= out[-1][1]:
            out[-1] = (out[-1][0], p + window)
        else:
            out.append((p, p + window))
    return out


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, tag, ranges: word ranges (start, end, ...) of docs(doc_id, tag, text) that windows of smaller documents cover; written tables."""
    shared = shared_minimisers(docs, window, gram, hot)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, starts, ends, codes, doc_of = _words(b, 2)
            first, count, value = super_kmers(codes, doc_of, window, gram)
            first_word = np.searchsorted(doc_of, np.arange(len(b) + 1))
            ids, tags = b.column(0).to_pylist(), b.column(1).to_pylist()
            lists = b.column(3)
            offsets, flat = lists.offsets.to_numpy(), lists.values
            keys, large = flat.field(0).to_numpy(), flat.field(1).to_numpy(zero_copy_only=False)
            out = {f.name: [] for f in _SUPER}
            edges = np.searchsorted(doc_of[first], np.arange(len(b) + 1)) if len(first) else np.zeros(len(b) + 1, dtype=np.int64)
            size = 0
            for d in range(len(b)):
                own, hots = keys[offsets[d] : offsets[d + 1]], large[offsets[d] : offsets[d + 1]]
                order = np.argsort(own)
                own, hots = own[order], hots[order]
                mine = slice(edges[d], edges[d + 1])
                place = np.minimum(np.searchsorted(own, value[mine]), len(own) - 1)
                for k in np.flatnonzero(own[place] == value[mine]):
                    f, n = first[mine][k], count[mine][k] + window - 1
                    piece = b" ".join(data[starts[f] : ends[f + n - 1]].split())
                    for name, x in zip(out, (int(value[mine][k]), bool(hots[place[k]]), ids[d], tags[d], int(f - first_word[d]), piece), strict=True):
                        out[name].append(x)
                    size += len(piece)
                if size > 2 << 20:
                    yield batch(out, _SUPER)
                    out, size = {f.name: [] for f in _SUPER}, 0
            yield batch(out, _SUPER)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _ in runs(batches, 1 << 60):
            out = {f.name: [] for f in _RANGE}
            keys = b.column(0).to_numpy()
            rows = list(zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True))
            edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                for got in _bucket_ranges(rows[s:e], window):
                    for name, x in zip(out, got, strict=True):
                        out[name].append(x)
            yield batch(out, _RANGE)

    per_doc = shared.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("minimiser", "hot")).alias("shared"))
    texts = docs.join(per_doc, ["doc_id", "tag"]).select("doc_id", "tag", "text", "shared")
    supers = materialize(texts.mapInArrow(packed, "minimiser bigint, hot boolean, doc_id bigint, tag bigint, start int, packed binary"), "op4-supers")
    crowded = not shared.filter("hot").isEmpty()
    discard(shared)
    ddl = "doc_id bigint, tag bigint, ranges array<int>"
    out = materialize(supers.filter("NOT hot").repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(count, ddl), "op4-ranges")
    if crowded:
        out = out.unionByName(_hot_ranges(supers.filter("hot").select("doc_id", "tag", "start", "packed"), window, ddl))
    discard(supers)
    return out


def _hot_ranges(rows: DataFrame, window: int, ddl: str) -> DataFrame:
    """The same for buckets too large to gather. Strings that a third of all documents hold count once after the partial
    aggregation; their windows are spread by content."""
    distinct = materialize(rows.groupBy("packed").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "op4-strings")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed, least in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                places = [-1, *(i for i, c in enumerate(packed) if c == 32), len(packed)]
                pieces = [packed[places[k] + 1 : places[k + window]] for k in range(len(places) - window)]
                for at in range(0, len(pieces), 2000):
                    part = pieces[at : at + 2000]
                    yield batch({"packed": [packed] * len(part), "least": [least] * len(part), "place": list(range(at, at + len(part))), "window": part}, _DISTINCT)

    each = distinct.select("packed", "least").mapInArrow(windows, "packed binary, least bigint, place int, window binary")
    first = materialize(each.groupBy("window").agg(F.min("least").alias("first"), F.count("*").alias("n")).filter("n > 1"), "op4-windows")
    repeated = _joined(each, first.drop("n"), "window", first).filter("first < least").groupBy("packed").agg(F.sort_array(F.collect_set("place")).alias("places"))
    found = _joined(rows, distinct.drop("n").join(repeated, "packed", "left"), "packed", distinct)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {f.name: [] for f in _RANGE}
            for doc_id, tag, start, n, all_of, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = [start, start + n] if all_of else [x for k in merged(places, window) for x in (start + k[0], start + k[1])]
                for name, x in zip(out, (doc_id, tag, own), strict=True):
                    out[name].append(x)
            yield batch(out, _RANGE)

    n = F.size(F.split(F.col("packed").cast("string"), " ")).alias("n")
    need = found.filter((F.col("least") < F.col("doc_id")) | F.col("places").isNotNull())
    need = need.select("doc_id", "tag", "start", n, (F.col("least") < F.col("doc_id")).alias("all_of"), "places")
    out = materialize(need.mapInArrow(ranges, ddl), "op4-crowded")
    discard(distinct, first)
    return out


def _kept(words: list[bytes], ranges: list | None) -> list[bytes]:
    if not ranges:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for part in ranges:
        np.add.at(gone, part[::2], 1)
        np.add.at(gone, part[1::2], -1)
    return [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]


def dedup(docs: DataFrame, texts: bool = False, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text: the words left, one space between them."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = rows.filter("doc_id IS NOT NULL").withColumn("tag", F.xxhash64("text")).select("doc_id", "tag", "text")
    per_doc = repeated_ranges(base, window, gram, hot).groupBy("doc_id", "tag").agg(F.collect_set("ranges").alias("ranges"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * texts)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {f.name: [] for f in schema}
            for doc_id, data, own in zip(b.column(0).to_pylist(), binary_list(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = (data or b"").split()
                kept = _kept(words, own)
                text = b" ".join(kept)
                values = [doc_id, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest()] + [text.decode("utf-8", "replace")] * texts
                for name, x in zip(out, values, strict=True):
                    out[name].append(x)
            yield batch(out, schema)

    ddl = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * texts
    cut = base.join(per_doc, ["doc_id", "tag"], "left").select("doc_id", "text", "ranges")
    apart = rows.filter("doc_id IS NULL").withColumn("ranges", F.lit(None).cast("array<array<int>>"))
    return cut.unionByName(apart).mapInArrow(finish, ddl)


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs)
