"""Exact Jaccard join of documents' word n-gram sets, with count vectors in R-trees.

Documents with equal sets are one class from the start. Then:

1. Classes are dealt to buckets so that any two that can link meet. Sizes fall into levels, and linked sets stand in one level
   or in neighbouring ones. With sizes in a level, linked sets differ in at most D members; hashes cut the members into
   D + 1 + 2s blocks (s is 1 + D / 8), so at least 1 + 2s blocks are the same in both. A bucket is a level, a block and what a
   set holds of it. No key is sent for an empty block unless a set has more than 2s of them, and a set with e empty blocks may
   leave out its s - e / 2 most crowded buckets: at least one bucket of any two linked sets stays.
2. In each bucket the classes' points (how many of a set's hashes fall in each of ``GROUPS`` groups) stand in an R-tree. The
   overlap of two sets is at most the sum over groups of the lesser count, and for a box that of the box's upper ends. Classes
   that pairs within the bound connect make a cluster: all links lie within clusters. Only points have travelled so far.
3. The texts of clusters' classes come together once, and pairs that the bound leaves are verified on the words themselves.
4. ``jaccard_join`` gives every link, as pairs of classes and the members of each class; ``link_counts`` gives the number of
   links of each document; ``jaccard_components`` gives components.

A cluster of more than ``PIECE`` classes or ``PIECE_MEMBERS`` set members is dealt out in pieces. For components each piece first
meets only itself and the ``PIVOTS`` classes of least hash, which connects what is truly alike in one pass; then the classes
outside a cluster's largest component meet all others that they aren't connected to. The join and the counts have a cell
for each pair of pieces, so every pair meets once.

Work beside the output: a bucket costs its classes times those that its own links don't reach; a cluster whose classes look
alike within the bound but don't link is verified pair by pair. A bucket of more than ``CROWD`` classes isn't searched: it
connects all its classes into one cluster, which costs time and not links.

Cases: null and empty texts and texts without words have the empty set and link with nothing; with fewer words than an
n-gram has, the whole sequence is the one member; equal rows get equal results; a null doc_id is a document like others,
but never the least of a group that has another; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, UNSPACED, batch, binary_list, discard, grams, materialize, mix, texts_of, words_of
from .components import components
from .substring_dedup import runs

GROUPS, PIECE, PIECE_MEMBERS, PIVOTS, CROWD, SEEN = 128, 2_048, 1_000_000, 32, 16_384, 20_000

_SIZES = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64()), ("rest", pa.int64()), ("spare", pa.int64()), ("point", pa.binary())])
_KEYS = pa.schema([("key", pa.int64()), ("cls", pa.int64())])
_SHARED = pa.schema([("key", pa.int64()), ("cls", pa.int64()), ("crowd", pa.int32())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_COUNTS = pa.schema([("cls", pa.int64()), ("n", pa.int64())])


def sets_of(b: pa.RecordBatch, column: int, n: int) -> list[np.ndarray]:
    """The distinct n-gram hashes of each text, ascending."""
    data, cuts = texts_of(b.column(column), ASCII_LOWER)
    words = words_of(np.frombuffer(data, dtype=np.uint8), cuts, UNSPACED)
    codes = words[2]
    first = np.searchsorted(np.searchsorted(cuts[1:], words[0], side="right"), np.arange(len(b) + 1))
    all_grams = grams(codes, n)
    out = []
    for s, e in zip(first[:-1], first[1:], strict=True):
        if e - s >= n:
            out.append(np.unique(all_grams[s : e - n + 1]))
        elif e > s:
            out.append(mix(grams(codes[s:e], int(e - s)) + np.uint64(e - s)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def exact_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The distinct n-grams of each text as numbers that are equal exactly when all n words are.

    A text of fewer words has one member of its own: where it equals another text's, both are one class already.
    """
    data, cuts = texts_of(pa.array(texts, pa.binary()), ASCII_LOWER)
    raw = np.frombuffer(data, dtype=np.uint8)
    starts, ends, codes = words_of(raw, cuts, UNSPACED)
    sizes = ends - starts
    held = raw[UNSPACED[raw]].tobytes()
    offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, offsets, pa.py_buffer(held)])
    word = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.searchsorted(np.searchsorted(cuts[1:], starts, side="right"), np.arange(len(texts) + 1))
    places = [np.arange(s, e - n + 1) for s, e in zip(first[:-1], first[1:], strict=True)]
    at = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
    _, heads, numbers = np.unique(grams(codes, n)[at], return_index=True, return_inverse=True)
    if not all(np.array_equal(word[at + k], word[at[heads[numbers]] + k]) for k in range(n)):  # two n-grams share a hash
        numbers = word[at]
        for k in range(1, n):
            numbers = np.unique(numbers * (len(word) + 1) + word[at + k], return_inverse=True)[1]
    edges = np.cumsum([0] + [len(p) for p in places])
    return [np.unique(numbers[s:e]) if e > s else np.array([len(numbers) + k]) for k, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True))]


_WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32}


def point(members: np.ndarray) -> bytes:
    """How many hashes fall in each group, in the narrowest integers that hold them."""
    counts = np.bincount(((members >> np.uint64(7)) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    width = 1 if counts.max() < 256 else 2 if counts.max() < 65_536 else 4
    return counts.astype(_WIDTHS[width]).tobytes()


def points_of(blobs: list[bytes]) -> np.ndarray:
    if all(len(x) == GROUPS for x in blobs):
        return np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(len(blobs), GROUPS)
    return np.stack([np.frombuffer(x, dtype=_WIDTHS[len(x) // GROUPS]).astype(np.uint32) for x in blobs])


def _class(members: np.ndarray, salt: int) -> tuple[int, int]:
    digest = hashlib.blake2b(members.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


class Levels:
    """Sizes by level for links of part / whole and more; the sizes of a level differ by less than (whole / part)²."""

    def __init__(self, part: int, whole: int):
        self.part, self.whole = part, whole
        starts = [1]
        while starts[-1] < 1 << 40:
            starts.append(max(starts[-1], starts[-1] * whole * whole // (part * part)) + 1)
        self.starts = np.array(starts)

    def level(self, size: int) -> int:
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def keys(self, members: np.ndarray) -> tuple[np.ndarray, tuple[int, int]]:
        """The buckets of a set, and how many of them it may leave out, at even levels and at odd ones; a key's last bit tells them apart."""
        level = self.level(len(members))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(members))])
        out, spare = [], [0, 0]
        reach = len(members) * self.whole // self.part >= self.starts[level + 1]
        for at in (level, level + 1) if reach else (level,):
            top = int(self.starts[at + 1]) - 1
            differ = 2 * top * (self.whole - self.part) // (self.whole + self.part)
            more = 1 + differ // 8 if differ else 0
            blocks = differ + 1 + 2 * more
            width = np.uint64(min((1 << 64) // blocks, (1 << 64) - 1))
            edges = np.searchsorted(members, np.arange(1, blocks, dtype=np.uint64) * width)
            edges = np.concatenate([[0], edges, [len(members)]])
            held = sums[edges[1:]] - sums[edges[:-1]]
            keys = mix(held + mix(np.arange(blocks, dtype=np.uint64) + np.uint64(at << 40)))
            keys = keys & ~np.uint64(1) | np.uint64(at & 1)
            full = edges[1:] > edges[:-1]
            empty = blocks - int(np.count_nonzero(full))
            if empty <= 2 * more:
                keys = keys[full]
                spare[at & 1] = more - -(-empty // 2)
            out.append(keys)
        return np.concatenate(out).astype(np.int64), (spare[0], spare[1])


class RTree:
    """Points packed into leaves and boxes by recursive splits at the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = 16, fan: int = 8):
        self.order = self._tiles(points, leaf)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []  # from leaves to the root: starts of children, upper ends, least and largest sizes
        upper, low, high, width = self.points, self.sizes, self.sizes, leaf
        while True:
            starts = np.arange(0, len(upper), width)
            upper, low, high = np.maximum.reduceat(upper, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((width, upper, low, high))
            if len(starts) == 1:
                break
            width = fan

    @staticmethod
    def _tiles(points: np.ndarray, leaf: int) -> np.ndarray:
        out, todo = [], [np.arange(len(points))]
        while todo:
            part = todo.pop()
            if len(part) <= leaf:
                out.append(part)
                continue
            own = points[part]
            widest = int(np.argmax(own.max(axis=0).astype(np.int64) - own.min(axis=0)))
            part = part[np.argsort(own[:, widest], kind="stable")]
            half = -(-(len(part) // 2) // leaf) * leaf
            todo += [part[half:], part[:half]] if 0 < half < len(part) else []
            if not 0 < half < len(part):
                out.append(part)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def search(self, asked: np.ndarray, sizes: np.ndarray, part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of asked points and of own points whose sets can link."""
        who, node = np.arange(len(asked)), np.zeros(len(asked), dtype=np.int64)
        for depth in reversed(range(len(self.levels))):
            width, upper, low, high = self.levels[depth]
            keep = self._may(asked, sizes, who, node, upper, low, high, part, whole)
            who, node = who[keep], node[keep]
            below = len(self.levels[depth - 1][1]) if depth else len(self.points)
            counts = np.minimum(width, below - node * width)
            children = np.repeat(node * width, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            who, node = np.repeat(who, counts), children
        keep = self._may(asked, sizes, who, node, self.points, self.sizes, self.sizes, part, whole)
        return who[keep], self.order[node[keep]]

    @staticmethod
    def _may(asked, sizes, who, node, upper, low, high, part, whole) -> np.ndarray:
        keep = np.zeros(len(who), dtype=bool)
        for at in range(0, len(who), 1 << 14):
            w, n = who[at : at + (1 << 14)], node[at : at + (1 << 14)]
            near = (low[n] * part <= sizes[w] * whole) & (sizes[w] * part <= high[n] * whole)
            overlap = np.minimum(asked[w], upper[n]).sum(axis=1, dtype=np.int64)
            keep[at : at + (1 << 14)] = near & ((part + whole) * overlap >= part * (sizes[w] + low[n]))
        return keep


def _sizes(docs: DataFrame, n: int, salt: int, levels: Levels) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = sets_of(b, 2, n)
            named = [_class(s, salt) for s in sets]
            points = [point(s) for s in sets]
            spare = [levels.keys(s)[1] if len(s) else (0, 0) for s in sets]
            yield batch({"doc_id": b.column(0).to_pylist(), "tag": b.column(1).to_pylist(), "n_shingles": [len(s) for s in sets], "cls": [c[0] for c in named], "rest": [c[1] for c in named], "spare": [e << 20 | o for e, o in spare], "point": points}, _SIZES)

    return docs.mapInArrow(run, "doc_id bigint, tag bigint, n_shingles bigint, cls bigint, rest bigint, spare bigint, point binary")


def _shared(docs: DataFrame, n: int, salt: int, levels: Levels) -> DataFrame:
    """key, cls, crowd: the buckets that two classes at least have, and of how many classes each is."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, None] = OrderedDict()  # classes that this task has dealt out just now
        for b in batches:
            found, classes = [], []
            size = 0
            for s in sets_of(b, 0, n):
                if not len(s):
                    continue
                cls = _class(s, salt)[0]
                if cls in seen:
                    seen.move_to_end(cls)
                    continue
                seen[cls] = None
                if len(seen) > SEEN:
                    seen.popitem(last=False)
                found.append(levels.keys(s)[0])
                classes.append(np.full(len(found[-1]), cls, dtype=np.int64))
                size += len(found[-1])
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(classes))], schema=_KEYS)
                    found, classes, size = [], [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(classes))], schema=_KEYS)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # of a large bucket whose next part follows
        for b, large in runs(batches, 100_000):
            key, cls = b.column(0).to_numpy(), b.column(1).to_numpy()
            fresh = np.concatenate([[last != (key[0], cls[0])], (np.diff(key) != 0) | (np.diff(cls) != 0)])
            last = (key[-1], cls[-1])
            key, cls = key[fresh], cls[fresh]
            if not len(key):
                continue
            edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            crowd = np.repeat(np.diff(edges), np.diff(edges))
            if large:
                crowd[:] = 1 << 30
            keep = crowd > 1
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(cls[keep]), pa.array(crowd[keep].astype(np.int32))], schema=_SHARED)

    rows = docs.select("text").mapInArrow(keys, "key bigint, cls bigint")
    return rows.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(shared, "key bigint, cls bigint, crowd int")


def _bucket_sets(kept: DataFrame) -> DataFrame:
    """sig, cls: the classes of each bucket of kept(key, cls), once for all buckets that have the same.

    Should two buckets of other classes share a signature, they are searched as one, which loses no pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, large in runs(batches, CROWD):
            key, cls = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not large:
                starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
                counts = np.diff(np.concatenate([starts, [len(key)]]))
                sums = mix(np.add.reduceat(mix(cls.astype(np.uint64)), starts) + counts.astype(np.uint64)).astype(np.int64)
                first = np.zeros(len(starts), dtype=bool)
                first[np.unique(sums, return_index=True)[1]] = True
                keep = np.repeat(first & (counts > 1), counts)
                key, cls = np.repeat(sums, counts)[keep], cls[keep]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(cls, pa.int64())], schema=_KEYS)

    rows = kept.select("key", "cls").repartition("key").sortWithinPartitions("key").mapInArrow(run, "key bigint, cls bigint")
    return rows.select(F.col("key").alias("sig"), "cls").distinct()


def _near_links(used: DataFrame, part: int, whole: int) -> DataFrame:
    """a, b: pairs that connect what the bound leaves connected within each bucket of used(sig, cls, n, point)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # of a crowded bucket whose next part follows
        for b, large in runs(batches, CROWD):
            key, cls, size = (b.column(k).to_numpy() for k in range(3))
            first, second = [], []
            if large:
                head = head if head is not None and head[0] == key[0] else (key[0], cls[0])
                first, second = [np.full(len(cls), head[1])], [cls]
            else:
                edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    if e - s > 1:
                        points = points_of(b.column(3).slice(s, e - s).to_pylist())
                        for x, others in _explore(points, size[s:e], part, whole):
                            first.append(np.full(len(others), cls[s + x]))
                            second.append(cls[s:e][others])
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first), pa.int64()), pa.array(np.concatenate(second), pa.int64())], schema=_PAIRS)

    return used.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, "a bigint, b bigint")


def _explore(points: np.ndarray, sizes: np.ndarray, part: int, whole: int, check=None, sides: np.ndarray | None = None, labels: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Links that connect what is linked, by searching from each class only for those not reached yet.

    check(x, others) leaves the linked ones of others; without it the bound alone decides. With sides only pairs across them
    count; classes with one label are connected already.
    """
    alive = np.ones(len(sizes), dtype=bool)
    own = np.arange(len(sizes))
    tree, places = None, own
    alike = {} if labels is None else {k: np.flatnonzero(labels == k) for k in np.unique(labels).tolist()}
    for seed in range(len(sizes)):
        if not alive[seed]:
            continue
        queue = [seed] if labels is None else alike[labels[seed]].tolist()
        alive[queue] = False
        while queue:
            x = queue.pop()
            left = own[alive] if tree is None or 2 * np.count_nonzero(alive) < len(places) else None
            if left is not None:
                if not len(left):
                    queue.clear()
                    break
                tree, places = RTree(points[left], sizes[left]), left
            others = places[tree.search(points[x : x + 1], sizes[x : x + 1], part, whole)[1]]
            others = others[alive[others]]
            if sides is not None:
                others = others[sides[others] != sides[x]]
            if check is not None and len(others):
                others = check(x, others)
            if len(others):
                yield x, others
                if labels is not None:
                    others = np.concatenate([alike[k] for k in np.unique(labels[others]).tolist()])
                    others = others[alive[others]]
                alive[others] = False
                queue += others.tolist()


class _Verifier:
    """Overlaps of sets in one cell, counted on their members."""

    def __init__(self, sets: list[np.ndarray], part: int, whole: int):
        self.sizes = np.array([len(x) for x in sets])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.numbers = np.concatenate(sets)
        self.held = np.zeros(int(self.numbers.max()) + 1, dtype=bool)
        self.part, self.whole = part, whole

    def linked(self, x: int, others: np.ndarray) -> np.ndarray:
        own = self.numbers[self.starts[x] : self.starts[x] + self.sizes[x]]
        self.held[own] = True
        keep = []
        for at in range(0, len(others), 512):
            some = others[at : at + 512]
            counts = self.sizes[some]
            ends = np.cumsum(counts)
            where = np.arange(ends[-1]) + np.repeat(self.starts[some] - (ends - counts), counts)
            overlap = np.add.reduceat(self.held[self.numbers[where]], ends - counts, dtype=np.int64)
            keep.append((self.part + self.whole) * overlap >= self.part * (self.sizes[x] + counts))
        self.held[own] = False
        return others[np.concatenate(keep)]


def _links(cells: DataFrame, levels: Levels, n: int, form: str) -> DataFrame:
    """Verified links of cells(gid, cls, side, mixed, label, count, point, packed); gid is a triple that names the cell.

    forest: a, b that connect what is connected within each cell. pairs: every a, b. counts: cls, n, the rows that a class links with.
    """
    part, whole = levels.part, levels.whole
    schema, ddl = (_COUNTS, "cls bigint, n bigint") if form == "counts" else (_PAIRS, "a bigint, b bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _ in runs(_cells(batches), 1 << 60):
            gid = b.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(gid)) + 1, [len(gid)]])
            first, second, size = [], [], 0
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if e - s < 2:
                    continue
                cell = b.slice(s, e - s)
                cls, side, mixed, label, rows = (cell.column(k).to_numpy(zero_copy_only=False) for k in range(4, 9))
                points = points_of(cell.column(9).to_pylist())
                sets = exact_sets([zlib.decompress(x) for x in cell.column(10).to_pylist()], n)
                verifier = _Verifier(sets, part, whole)
                if form == "forest":
                    found = _explore(points, verifier.sizes, part, whole, verifier.linked, side if mixed[0] else None, label if mixed[0] else None)
                else:
                    near = _near(points, verifier.sizes, side, bool(mixed[0]), part, whole)
                    found = ((x, others) for x, others in ((x, verifier.linked(x, o)) for x, o in near) if len(others))
                if form == "counts":
                    met = np.zeros(e - s, dtype=np.int64)
                    for x, others in found:
                        met[x] += rows[others].sum()
                        met[others] += rows[x]
                    first.append(cls[met > 0])
                    second.append(met[met > 0])
                    continue
                for x, others in found:
                    first.append(np.full(len(others), cls[x]))
                    second.append(cls[others])
                    size += len(others)
                    if size > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(second))], schema=schema)
                        first, second, size = [], [], 0
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(second))], schema=schema)

    def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers the cells in the order in which they come."""
        at, last = 0, None
        for b in batches:
            if not len(b):
                continue
            names = np.stack([b.column(k).to_numpy() for k in range(3)])
            fresh = np.concatenate([[last is None or bool((names[:, 0] != last).any())], (np.diff(names, axis=1) != 0).any(axis=0)])
            numbers = at + np.cumsum(fresh)
            at, last = int(numbers[-1]), names[:, -1]
            yield pa.RecordBatch.from_arrays([pa.array(numbers), *b.columns], names=["number", *b.schema.names])

    names = ("cluster", "low", "high")
    return cells.select(*names, "cls", "side", "mixed", "label", "count", "point", "packed").repartition(*names).sortWithinPartitions(*names).mapInArrow(run, ddl)


def _near(points: np.ndarray, sizes: np.ndarray, sides: np.ndarray, mixed: bool, part: int, whole: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs of one cell that the bound leaves, each once, by their first; in a cell of two pieces only pairs across them."""
    tree = RTree(points, sizes)
    for at in range(0, len(sizes), 128):
        who, other = tree.search(points[at : at + 128], sizes[at : at + 128], part, whole)
        who = who + at
        keep = who > other
        if mixed:
            keep &= sides[who] != sides[other]
        who, other = who[keep], other[keep]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(who)) + 1, [len(who)]])
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if e > s:
                yield int(who[s]), other[s:e]


def _packed(docs: DataFrame) -> DataFrame:
    """cls, packed: the compressed text, a third of the size of its hashes, which are made anew where they are compared."""
    schema = pa.schema([("cls", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch({"cls": b.column(0).to_pylist(), "packed": [zlib.compress(x or b"", 1) for x in binary_list(b.column(1))]}, schema)

    return docs.select("cls", "text").mapInArrow(run, "cls bigint, packed binary")


def _long(value) -> F.Column:
    return F.lit(value).cast("bigint")


def _forest(used: DataFrame, texts: DataFrame, levels: Levels, n: int) -> DataFrame:
    """a, b: verified links that connect what is connected, from used(cls, n, count, point, cluster, pieces)."""
    nothing = _long(0)
    # each piece alone, with the cluster's pivots beside it
    piece = F.pmod(F.xxhash64("cls"), F.col("pieces")).alias("low")
    alone = used.select("cluster", piece, nothing.alias("high"), "cls", nothing.alias("side"), F.lit(False).alias("mixed"), nothing.alias("label"), "count", "point")
    many = used.filter("pieces > 1")
    pivots = many.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("cls"), "cls"))).filter(F.col("rank") <= PIVOTS)
    beside = pivots.withColumn("low", F.explode(F.sequence(_long(0), F.col("pieces") - 1))).filter(F.col("low") != piece)
    beside = beside.select("cluster", "low", nothing.alias("high"), "cls", nothing.alias("side"), F.lit(False).alias("mixed"), nothing.alias("label"), "count", "point")
    links = materialize(_links(alone.unionByName(beside).join(texts, "cls"), levels, n, "forest"), "op10-links")
    if many.isEmpty():
        return links
    # what is outside the largest component of a large cluster meets all that it isn't connected to
    labels = components(links).select(F.col("node").alias("cls"), "label")
    many = materialize(many.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "op10-many")
    counts = many.groupBy("cluster", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("members"))
    sums = counts.groupBy("cluster").agg(F.max(F.struct("rows", "label", "members")).alias("top"), F.sum("rows").alias("rows"), F.sum("members").alias("members"))
    pieces = lambda rows, members: F.ceil(F.greatest(rows / PIECE, members / PIECE_MEMBERS, F.lit(1.0))).cast("bigint")
    outside = sums.withColumn("rows", F.col("rows") - F.col("top.rows")).filter("rows > 0").select("cluster", F.col("top.label").alias("largest"), pieces(F.col("rows"), F.col("members") - F.col("top.members")).alias("parts"))
    loose = many.join(outside, "cluster")
    few = loose.filter(F.col("label") != F.col("largest"))
    low, high = F.pmod(F.xxhash64("cls"), F.col("parts")), F.pmod(F.xxhash64("cls"), F.col("pieces"))
    each = lambda n: F.explode(F.sequence(_long(0), F.col(n) - 1))
    rest = ("cls", F.lit(True).alias("mixed"), "label", "count", "point")
    one = few.withColumn("low", low).withColumn("high", each("pieces")).select("cluster", "low", "high", _long(0).alias("side"), *rest)
    two = loose.withColumn("high", high).withColumn("low", each("parts")).select("cluster", "low", "high", _long(1).alias("side"), *rest)
    more = materialize(_links(one.unionByName(two).join(texts, "cls"), levels, n, "forest"), "op10-more")
    discard(many)
    return links.unionByName(more)


def _search(docs: DataFrame, n: int, part: int, whole: int, form: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their classes, the classes that have members, and the links in the given form."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text").cast("string").alias("text"))
    levels, salt = Levels(part, whole), 0
    while True:
        sizes = materialize(_sizes(docs, n, salt, levels), "op10-sizes")
        classes = sizes.filter("n_shingles > 0").groupBy("cls").agg(F.min("rest").alias("rest"), F.max("rest").alias("other"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "tag")).alias("witness"), F.first("n_shingles").alias("n"), F.first("spare").alias("spare"), F.first("point").alias("point"), F.count("*").alias("count"))
        classes = materialize(classes, "op10-classes")
        if classes.filter("rest <> other").isEmpty():  # else two sets share a class number: number anew
            break
        discard(sizes, classes)
        salt += 1
    shared = materialize(_shared(docs, n, salt, levels), "op10-shared")
    # each class leaves out its most crowded buckets, as many as it may
    odd = F.col("key").bitwiseAND(F.lit(1))
    may = F.when(odd == 1, F.col("spare").bitwiseAND(F.lit((1 << 20) - 1))).otherwise(F.shiftright("spare", 20))
    rank = F.row_number().over(Window.partitionBy("cls", "odd").orderBy(F.col("crowd").desc(), "key"))
    kept = shared.repartition("cls").withColumn("odd", odd).withColumn("rank", rank).join(classes.select("cls", "spare"), "cls").filter(F.col("rank") > may)
    sets = _bucket_sets(kept).join(classes.select("cls", "n", "point"), "cls").select("sig", "cls", "n", "point")
    near = materialize(_near_links(sets, part, whole), "op10-near")
    clusters = components(near).select(F.col("node").alias("cls"), F.col("label").alias("cluster"))
    discard(shared, near)
    used = clusters.join(classes.select("cls", "n", "point", "witness", "count"), "cls")
    counts = used.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / PIECE, F.sum("n") / PIECE_MEMBERS)).cast("bigint").alias("pieces"))
    used = materialize(used.join(counts, "cluster"), "op10-used")
    witness = used.select("cls", F.col("witness.doc_id").alias("doc_id"), F.col("witness.tag").alias("tag"))
    same = docs["doc_id"].eqNullSafe(witness["doc_id"]) & docs["tag"].eqNullSafe(witness["tag"])
    # by merging at any size, so that what is shuffled follows the input
    texts = materialize(_packed(docs.join(witness.hint("merge"), same).select("cls", "text")).dropDuplicates(["cls"]), "op10-texts")
    if form == "forest":
        links = _forest(used, texts, levels, n)
    else:
        # pieces i and j of a cluster meet in the cell (least, largest)
        spread = used.withColumn("side", F.pmod(F.xxhash64("cls"), "pieces")).withColumn("with", F.explode(F.sequence(_long(0), F.col("pieces") - 1)))
        cells = spread.select("cluster", F.least("side", "with").alias("low"), F.greatest("side", "with").alias("high"), "cls", "side", (F.col("side") != F.col("with")).alias("mixed"), _long(0).alias("label"), "count", "point")
        links = materialize(_links(cells.join(texts, "cls"), levels, n, form), "op10-links")
    discard(used, texts)
    return sizes, classes, links


def jaccard_join(docs: DataFrame, n: int = 5, part: int = 80, whole: int = 100) -> tuple[DataFrame, DataFrame]:
    """Every link, as pairs(a, b) of classes and members(cls, doc_id, tag, n_shingles).

    Members of one class have equal sets, so they link with each other and with all members of a linked class. Each pair
    stands once; rows whose set is empty are no members.
    """
    sizes, _, pairs = _search(docs, n, part, whole, "pairs")
    return pairs, sizes.filter("n_shingles > 0").select("cls", "doc_id", "tag", "n_shingles")


def link_counts(docs: DataFrame, n: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """doc_id, tag, n_shingles, n_links for each row: how many other rows it links with."""
    sizes, classes, links = _search(docs, n, part, whole, "counts")
    met = links.groupBy("cls").agg(F.sum("n").alias("met"))
    of_class = classes.select("cls", "count").join(met, "cls", "left").select("cls", (F.col("count") - 1 + F.coalesce("met", F.lit(0))).alias("n_links"))
    joined = sizes.drop("point", "rest", "spare").join(of_class, "cls", "left")
    return joined.select("doc_id", "tag", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("n_links")).otherwise(0).alias("n_links"))


def jaccard_components(docs: DataFrame, n: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """doc_id, tag, n_shingles, component_id for each row of docs(doc_id, text); sets link at part / whole and above."""
    sizes, classes, links = _search(docs, n, part, whole, "forest")
    final = components(links)
    groups = classes.select("cls", "least").join(final.select(F.col("node").alias("cls"), "label"), "cls")
    least = groups.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = classes.select("cls", "least").join(groups.select("cls", "label").join(least, "label"), "cls", "left").select("cls", F.coalesce("component_id", "least").alias("component_id"))
    joined = sizes.drop("point", "rest", "spare").join(of_class, "cls", "left")
    return joined.select("doc_id", "tag", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of linked documents that of the least doc_id, then tag; null ids last.

    Copies of that row with the same id and text stay with it (exact dedup takes them); of copies without an id one stays.
    """
    sizes, _, links = _search(docs, n, part, whole, "forest")
    rows = sizes.filter("n_shingles > 0").select("cls", "doc_id", "tag")
    own = rows.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("own"))
    groups = own.join(components(links).select(F.col("node").alias("cls"), "label"), "cls")
    first = groups.groupBy("label").agg(F.min("own").alias("first"))
    stays = own.join(groups.select("cls", "label").join(first, "label"), "cls", "left").select("cls", F.coalesce("first", "own").alias("stay"))
    again = F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col("tag") == F.col("stay.tag"))
    gone = rows.join(stays, "cls").withColumn("again", again).filter("NOT again OR doc_id IS NULL")
    gone = materialize(gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("tag").alias("gone_tag"), "again").count(), "op10-gone")

    def same(listed: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(listed["gone_id"]) & F.xxhash64(docs["text"]).eqNullSafe(listed["gone_tag"])

    other, copies = gone.filter("NOT again"), gone.filter("again AND count > 1")
    left = docs.join(other, same(other), "left_anti")
    if copies.isEmpty():
        return left
    return left.join(copies, same(copies), "left_anti").unionByName(left.join(copies, same(copies), "left_semi").dropDuplicates(["text"]))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for sets of 3-word shingles that link at 90 in 100."""
    return jaccard_components(docs, 3, 90, 100).select("doc_id", "n_shingles", "component_id")
