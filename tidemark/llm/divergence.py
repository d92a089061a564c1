"""How far the sources of a language are from it and from each other, by the terms that they use.

A term is a run of letters (A-Z lower-cased) and of characters beyond ASCII. A language keeps the terms that enough of its documents
hold; each source of a language, and the language, gives each kept term a smoothed share in whole billionths.

*Terms* that set a source apart are found by upper bounds. Terms of one count have one share in a source, so a source is a few buckets
of equal counts; with the least and the greatest share that the language gives to a bucket's terms, a bucket bounds how far any
of them stands out, from above and from below. Buckets whose upper bound is strictly below what enough terms are sure to
reach are never opened. The others are evaluated best bound first, each task stopping in a source as soon as the bounds
that it hasn't seen are strictly below its kth value; a source's results are the best of its tasks'.

*Pairs* of sources come from postings, the lists of the sources that hold a term. The distance is summed as if no term were held by
either, then corrected for what one of them holds (by buckets, with sums of the sorted shares) and for what both hold
(by the postings alone). Each task adds up what its postings say of a pair, so no row is made for a pair and a term.

Scale. Texts are counted in tasks into a bounded table that is flushed when full; counts are dealt out by (language, term), of which a
key has a row per task and source at most. A posting has one entry per source; the result has the square of their number.
All arithmetic is on integers.

Cases. Null text, lang and source are ''. Repeated rows are documents of their own. A group without kept terms has pairs
and no terms; a language without kept terms has value 0 for all pairs. Equal values go by the item's UTF-8 bytes. Empty tables give no
rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, batch, binary_list, materialize

MIN_DOCUMENTS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Entries of a task's table of counts, bytes of text that are split at once, pairs that are added up at once.
ENTRIES, BLOCK, PAIRS = 400_000, 1 << 20, 1 << 20
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_COUNTS_DDL = "lang string, source string, term string, n bigint, docs bigint"
_SUMS = pa.schema([("lang", pa.string()), ("g", pa.int32()), ("h", pa.int32()), ("value", pa.int64())])
_SUMS_DDL = "lang string, g int, h int, value bigint"
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_FOUND_DDL = "lang string, source string, item string, value bigint"


def blocks(data: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The terms of a lower-cased text, by blocks that end between terms."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        if end < len(data) and (more := _TERM.match(data, end)):
            end = more.end()
        yield _TERM.findall(data, at, end)
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by lang and source, from a table that is flushed when full."""
    own: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in own.items():
            terms = list(counts)
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                yield batch({"lang": [lang] * len(part), "source": [source] * len(part), "term": [t.decode() for t in part], "n": [counts[t] for t in part], "docs": [docs[t] for t in part]}, _COUNTS)
        own.clear()

    for b in batches:
        for text, lang, source in zip(binary_list(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            counts, docs = own.setdefault((lang, source), (Counter(), Counter()))
            found: set[bytes] = set()
            for terms in blocks(text.translate(ASCII_LOWER)):
                counts.update(terms)
                found.update(terms)
            docs.update(found)
        if sum(len(c) for c, _ in own.values()) > ENTRIES:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, term, in_lang, source, n: occurrences of the terms that at least min_documents of a lang's documents hold."""
    partial = docs.mapInArrow(_count, _COUNTS_DDL).repartition("lang", "term")
    counts = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    postings = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang"), F.collect_list(F.struct("source", "n")).alias("posting")).filter(F.col("docs") >= min_documents)
    return postings.select("lang", "term", "in_lang", F.explode("posting").alias("e")).select("lang", "term", "in_lang", "e.source", "e.n")


def _share(count: str, total: str) -> F.Column:
    """The smoothed share of a count in whole billionths, exactly; null where nothing is kept."""
    return F.expr(f"1 + (cast({SCALE} AS decimal(10, 0)) * cast({count} + {SMOOTHING} AS decimal(20, 0))) div nullif(cast({total} + {SMOOTHING} * v AS decimal(20, 0)), 0)")


def group_table(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, source, g (its number in the lang), total, v, lang_total, p0 (its share of a term it doesn't hold)."""
    groups = docs.select("lang", "source").distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.select("lang", "term", "in_lang").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_total"))
    out = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    out = out.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    return out.withColumn("p0", _share("0", "total"))


def top_terms(entries: DataFrame, k: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: the k terms whose share p in a source exceeds their share q in the lang the most, from
    entries(lang, source, term, p, q)."""
    group = ["lang", "source"]
    buckets = entries.groupBy(*group, "p").agg((F.col("p") - F.min("q")).alias("bound"), (F.col("p") - F.max("q")).alias("sure"), F.count("*").alias("n"))
    least = Window.partitionBy(*group).orderBy(F.desc("sure")).rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.withColumn("reached", F.when((F.sum("n").over(least) >= k) & (F.col("sure") > 0), F.col("sure")))
    buckets = buckets.withColumn("floor", F.coalesce(F.max("reached").over(Window.partitionBy(*group)), F.lit(1)))
    opened = materialize(buckets.filter("bound >= floor AND bound > 0").select(*group, "p", "bound"), "op11-buckets")

    def best_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group, then by falling bound. heap: the k best so far, worst first."""
        at, heap, done = None, [], False

        def rows() -> pa.RecordBatch:
            return batch({"lang": [at[0]] * len(heap), "source": [at[1]] * len(heap), "item": [h[1].term.decode() for h in heap], "value": [h[0] for h in heap]}, _FOUND)

        for b in batches:
            for lang, source, term, p, q, bound in zip(*(c.to_pylist() for c in b.columns[:2]), binary_list(b.column(2)), *(c.to_pylist() for c in b.columns[3:]), strict=True):
                if at != (lang, source):
                    if heap:
                        yield rows()
                    at, heap, done = (lang, source), [], False
                if done:
                    continue
                if len(heap) == k and bound < heap[0][0]:
                    done = True
                elif p > q:
                    own = (p - q, _Late(term))
                    if len(heap) < k:
                        heapq.heappush(heap, own)
                    elif own > heap[0]:
                        heapq.heapreplace(heap, own)
        if heap:
            yield rows()

    found = entries.select(*group, "term", "p", "q").join(opened, [*group, "p"]).select(*group, "term", "p", "q", "bound")
    found = found.sortWithinPartitions("lang", "source", F.desc("bound")).mapInArrow(best_first, _FOUND_DDL)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= k)


class _Late:
    """A term that counts as the greater the earlier its bytes come."""

    __slots__ = ("term",)

    def __init__(self, term: bytes) -> None:
        self.term = term

    def __lt__(self, other: _Late) -> bool:
        return self.term > other.term

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Late) and self.term == other.term


def _sums(lang: str, codes: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(codes), 50_000):
        c = codes[at : at + 50_000]
        yield batch({"lang": [lang] * len(c), "g": c >> 32, "h": c & 0xFFFFFFFF, "value": values[at : at + 50_000]}, _SUMS)


def _added(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values summed by code."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(values[order], first) if len(codes) else values


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections for terms that both sources of a pair hold, added up by pair."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            yield from _sums(lang, *_added(*(np.concatenate(x) for x in zip(*parts, strict=True))))
        held.clear()

    for b in batches:
        langs, lists = b.column(0).to_pylist(), b.column(1)
        cuts, flat = lists.offsets.to_numpy(), lists.values
        gs, ps, zeros = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        for lang in set(langs):
            rows = [k for k, x in enumerate(langs) if x == lang]
            place = np.concatenate([np.arange(cuts[k], cuts[k + 1]) for k in rows])
            after = np.concatenate([np.arange(cuts[k + 1] - cuts[k])[::-1] for k in rows])  # entries of the posting behind each
            total = np.cumsum(after)
            at = 0
            while at < len(place):
                until = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
                n, own = after[at:until], place[at:until]
                x = np.repeat(own, n)
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
                p, q, p0, q0 = ps[x], ps[y], zeros[x], zeros[y]
                value = np.abs(p - q) - np.abs(p - q0) - np.abs(p0 - q) + np.abs(p0 - q0)
                codes = np.minimum(gs[x], gs[y]) << 32 | np.maximum(gs[x], gs[y])
                part = _added(codes, value)
                held.setdefault(lang, []).append(part)
                size += len(part[0])
                at = until
        if size > 2 * PAIRS:
            held = {lang: [_added(*(np.concatenate(x) for x in zip(*parts, strict=True)))] for lang, parts in held.items()}
            size = sum(len(codes) for ((codes, _),) in held.values())
            if size > PAIRS:
                yield from flush()
                size = 0
    yield from flush()


def _one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distance of a source to each other one if neither held a term (counted once a pair), and its own terms' correction."""
    for b in batches:
        for lang, g, v, p0, others, buckets in zip(*(c.to_pylist() for c in b.columns), strict=True):
            others = sorted((o["g"], o["p0"]) for o in others if o["g"] != g)
            if not others:
                continue
            h, q0 = (np.array(x, dtype=np.int64) for x in zip(*others, strict=True))
            own = sorted((x["p"], x["n"]) for x in buckets or [])
            p, n = np.array([x[0] for x in own], dtype=np.int64), np.array([x[1] for x in own], dtype=np.int64)
            below, amount = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * p)]
            k = np.searchsorted(p, q0)
            apart = np.abs(q0 - p0)
            value = q0 * below[k] - amount[k] + (amount[-1] - amount[k]) - q0 * (below[-1] - below[k]) - below[-1] * apart + np.where(h > g, v * apart, 0)
            yield from _sums(lang, np.minimum(h, g) << 32 | np.maximum(h, g), value)


def pair_distances(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, g, h, value: the summed difference of shares of each pair g < h of a lang's sources."""
    postings = entries.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "p0")).alias("posting")).filter(F.size("posting") > 1)
    both = postings.select("lang", "posting").mapInArrow(_both, _SUMS_DDL)
    buckets = entries.groupBy("lang", "g", "p").agg(F.count("*").alias("n")).groupBy("lang", "g").agg(F.collect_list(F.struct("p", "n")).alias("buckets"))
    others = groups.filter("v > 0").groupBy("lang").agg(F.collect_list(F.struct("g", "p0")).alias("others"))
    one = groups.filter("v > 0").select("lang", "g", "v", "p0").join(others, "lang").join(buckets, ["lang", "g"], "left")
    one = one.select("lang", "g", "v", "p0", "others", "buckets").mapInArrow(_one, _SUMS_DDL)
    return both.unionByName(one).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, k: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of docs(text, lang, source) its distance to each other of its lang
    (part pair) and the k terms that stand out most against the lang (part term)."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = materialize(term_counts(docs, min_documents), "op11-counts")
    groups = materialize(group_table(docs, counts), "op11-groups")
    joined = counts.join(groups, ["lang", "source"])
    entries = materialize(joined.select("lang", "source", "g", "term", _share("n", "total").alias("p"), _share("in_lang", "lang_total").alias("q"), "p0"), "op11-entries")
    terms = top_terms(entries, k).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    apart = materialize(pair_distances(entries, groups), "op11-pairs")
    ways = apart.select("lang", "g", "h", "value").unionByName(apart.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    names = groups.select("lang", "g", "source")
    pairs = names.select("lang", "source", "g").join(names.select("lang", F.col("source").alias("item"), F.col("g").alias("h")), "lang").filter("g != h")
    pairs = pairs.join(ways, ["lang", "g", "h"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return terms.unionByName(ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"))


def report(docs: DataFrame) -> DataFrame:
    """The audit with 30 documents a term and the 50 first terms."""
    return audit(docs)
