"""Rolling windows over event time, bounds inclusive, current row and its peers included.

Two forms that give the same. *Streams* (``sliding``), for all keys but hot ones: rows pass once, sorted by key and time, through Arrow
batches; a task holds the longest window of one key. Where a window starts is found for all rows of a batch at once, and what it
holds is put together from aggregates of 1, 2, 4, ... consecutive rows, so a row costs the logarithm of its window, no frame is
read again, and any aggregate that merges will do: deviations are merged as moments, not taken from differences of sums.
*Pieces*, for keys that hold more than two tasks' share of rows: time is parted into blocks as long as the window, so a window is the
end of one block and the beginning of the next. Rows come twice, at their own time and at the one when they leave the window, which
is in the block after theirs: a row's window is then what has come in its block and what has yet to leave in it. One range
partitioning over key and time cuts both where it likes, even within one second; what a piece takes from those beside it comes from
one row a piece. Distinct values there are running totals of intervals (``scan``): a value is in a window from each time it comes
until the window has passed its last one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .scan import LEAST, cut, hot_keys, merged, running

SECOND = 1_000_000
#: Window names and lengths in seconds.
LENGTHS = {"1m": 60, "5m": 300, "1h": 3600, "24h": 86_400}
#: What sliding adds: name, the statistic, its window, and the column whose values are distinct.
Stat = tuple[str, str, str | None, str | None]


def frame(key: str, name: str, order: str = "us"):
    return Window.partitionBy(key).orderBy(order).rangeBetween(-LENGTHS[name] * SECOND, 0)


def present(value: str) -> Column:
    """The value, or null for an empty one."""
    return F.nullif(F.col(value), F.lit(""))


def _named(txns: DataFrame, key: str) -> DataFrame:
    return txns.filter(F.coalesce(F.col(key), F.lit("")) != "")


class _Lifts:
    """Aggregates of any stretches of a row of values, from those of 1, 2, 4, ... consecutive ones."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def over(self, low: np.ndarray, high: np.ndarray, want: set[str]) -> dict[str, np.ndarray]:
        """sum, m2, max, min of x[low] to x[high], both included."""
        size, at = high - low + 1, low.copy()
        names = [n for n in ("sum", "m2", "max", "min") if n in want or (n == "sum" and "m2" in want)]
        if not names:
            return {}
        parts = {n: np.zeros(len(self.x)) if n == "m2" else self.x for n in names}
        out = {n: np.full(len(low), {"sum": 0.0, "m2": 0.0, "max": -np.inf, "min": np.inf}[n]) for n in names}
        done = np.zeros(len(low))
        width = 1
        while len(size) and width <= size.max():
            own = np.flatnonzero(size & width)
            place = at[own]
            if "m2" in want:
                first = done[own] == 0
                a, b = out["sum"][own] / np.maximum(done[own], 1), parts["sum"][place] / width
                out["m2"][own] += parts["m2"][place] + np.where(first, 0.0, (b - a) ** 2 * (done[own] * width / np.maximum(done[own] + width, 1)))
            if "sum" in out:
                out["sum"][own] += parts["sum"][place]
            if "max" in want:
                out["max"][own] = np.maximum(out["max"][own], parts["max"][place])
            if "min" in want:
                out["min"][own] = np.minimum(out["min"][own], parts["min"][place])
            done[own] += width
            at[own] += width
            if 2 * width <= size.max():
                a, b = {n: parts[n][:-width] for n in parts}, {n: parts[n][width:] for n in parts}
                both = {"sum": lambda a=a, b=b: a["sum"] + b["sum"], "m2": lambda a=a, b=b, w=width: a["m2"] + b["m2"] + (b["sum"] - a["sum"]) ** 2 / (2 * w), "max": lambda a=a, b=b: np.maximum(a["max"], b["max"]), "min": lambda a=a, b=b: np.minimum(a["min"], b["min"])}
                parts = {n: both[n]() for n in names}
            width *= 2
        return out


def _distinct(codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many different codes, negative ones aside, each stretch holds; both ends never fall from one to the next."""
    n = len(codes)
    order = np.lexsort((np.arange(n), codes))
    again = np.full(n, n)
    same = codes[order][1:] == codes[order][:-1]
    again[order[:-1][same]] = order[1:][same]
    # a row is its value's last one in the stretches from the first that reaches it to the first that reaches the next or has passed it
    starts = np.searchsorted(high, np.arange(n))
    ends = np.minimum(np.searchsorted(high, again), np.searchsorted(low, np.arange(n), side="right"))
    own = (codes >= 0) & (ends > starts)
    return np.cumsum(np.bincount(starts[own], minlength=n + 1) - np.bincount(ends[own], minlength=n + 1))[: len(low)]


def _codes(column: pa.Array) -> np.ndarray:
    """A number for each value; -1 for null and empty ones."""
    coded = pc.dictionary_encode(column.cast(pa.string()))
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = coded.dictionary.index("").as_py() if len(coded.dictionary) else -1
    return np.where(codes == empty, -1, codes) if empty >= 0 else codes


def _wanted(stats: list[Stat], window: str) -> set[str]:
    """What _Lifts has to give for the statistics of a window."""
    kinds = {s[1] for s in stats if s[2] == window}
    return ({"sum"} if kinds & {"sum", "mean", "std"} else set()) | ({"m2"} if "std" in kinds else set()) | (kinds & {"max", "min"})


def _batch_stats(table: pa.Table, old: int, key: str, us: str, amount: str, stats: list[Stat], before: int) -> tuple[list[pa.Array], int]:
    """The statistics of the rows from old on, and how many rows the last key has had; before: how many the first key had had by then."""
    t = table.column(us).to_numpy().astype(np.int64)
    key_codes = pc.dictionary_encode(table.column(key).combine_chunks()).indices.to_numpy(zero_copy_only=False)
    fresh = np.r_[True, key_codes[1:] != key_codes[:-1]]
    segment = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    longest = max(LENGTHS.values()) * SECOND
    # keys one after the other on one axis, farther apart than any window
    last = np.r_[first[1:], len(t)] - 1
    spans = t[last] - t[first] + longest + 1
    base = np.r_[0, np.cumsum(spans)[:-1]]
    axis = t - t[first][segment] + base[segment]
    high = np.searchsorted(axis, axis, side="right") - 1
    lifts = _Lifts(table.column(amount).cast(pa.float64()).fill_null(0.0).to_numpy())
    lows = {w: np.searchsorted(axis, axis - LENGTHS[w] * SECOND) for w in {s[2] for s in stats if s[2]}}
    got: dict[str, dict[str, np.ndarray]] = {}
    for w, low in lows.items():
        got[w] = lifts.over(low[old:], high[old:], _wanted(stats, w))
    place = np.arange(len(t)) - first[segment] + 1 + np.where(segment == 0, before - old, 0)
    codes: dict[str, np.ndarray] = {}
    out = []
    for _, stat, w, value in stats:
        if stat == "freq":
            out.append(pa.array(place[old:]))
            continue
        n = high[old:] - lows[w][old:] + 1
        if stat == "count":
            out.append(pa.array(n))
        elif stat == "distinct":
            if value not in codes:
                own = _codes(table.column(value).combine_chunks())
                codes[value] = np.where(own < 0, -1, own + segment * (own.max(initial=0) + 1))
            out.append(pa.array(_distinct(codes[value], lows[w], high)[old:].astype(np.int64)))
        else:
            g = got[w]
            out.append(pa.array({"sum": lambda g=g: g["sum"], "mean": lambda g=g, n=n: g["sum"] / n, "std": lambda g=g, n=n: np.sqrt(g["m2"] / n), "max": lambda g=g: g["max"], "min": lambda g=g: g["min"]}[stat]()))
    return out, int(place[-1]) if len(place) else before


def _stream_stats(batches: Iterator[pa.RecordBatch], names: list[str], key: str, stats: list[Stat], us: str, amount: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key, time and tie. Held between batches: the last rows of one time, whose peers may follow, and before them
    the rows of their key that a window can still reach. Batches wait until they are as many rows as are held, so a row is looked at
    twice on average, however many of them a window holds."""
    longest = max((LENGTHS[s[2]] for s in stats if s[2]), default=0) * SECOND
    held, old, before = None, 0, 0  # rows, how many of them are done, and how many of their key are
    waiting, rows = [], 0

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal before
        if table.num_rows > old:
            got, before = _batch_stats(table, old, key, us, amount, stats, before)
            done = table.slice(old)
            yield from pa.Table.from_arrays([*done.columns, *got], names=names).to_batches()

    for b in chain(batches, [None]):
        if b is not None:
            waiting, rows = [*waiting, b], rows + b.num_rows
        if not rows or (b is not None and held is not None and rows < held.num_rows):
            continue
        table = pa.Table.from_batches(waiting)
        table = table if held is None else pa.concat_tables([held, table])
        waiting, rows = [], 0
        t, keys = table.column(us).to_numpy(), table.column(key)
        mine = pc.equal(keys, keys[-1]).to_numpy(zero_copy_only=False)
        open_ = int(np.flatnonzero(~(mine & (t == t[-1])))[-1]) + 1 if not (mine & (t == t[-1])).all() else 0
        if open_ > old:
            ready = table.slice(0, open_)
            of_last = bool(mine[open_ - 1])
            yield from emit(ready)
            if not of_last:
                before = 0
            keep = np.flatnonzero(mine[:open_] & (t[:open_] >= t[-1] - longest))
            start = int(keep[0]) if len(keep) else open_
            held, old = table.slice(start).combine_chunks(), open_ - start
        else:
            held = table
    if held is not None:
        yield from emit(held)


def _streamed(txns: DataFrame, key: str, stats: list[Stat], us: str, tie: str, amount: str) -> DataFrame:
    if all(stat == "freq" for _, stat, _, _ in stats):  # no window to look back into
        place = F.count("*").over(Window.partitionBy(key).orderBy(us, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return txns.select("*", *(place.alias(name) for name, _, _, _ in stats))
    types = {"count": "bigint", "distinct": "bigint", "freq": "bigint"}
    schema = T.StructType([*txns.schema, *(T.StructField(name, T.LongType() if stat in types else T.DoubleType()) for name, stat, _, _ in stats)])
    names = [f.name for f in schema]
    return txns.repartition(key).sortWithinPartitions(key, us, tie).mapInArrow(lambda batches: _stream_stats(batches, names, key, stats, us, amount), schema)


#: Moments of no values: count, sum, squared deviations, greatest and least.
NONE = (0, 0.0, 0.0, -np.inf, np.inf)
_PARTS = ("n", "s", "m2", "hi", "lo")


def _both(a: tuple, b: tuple) -> tuple:
    """The moments of two disjoint sets of values together; numbers or arrays of them."""
    n = a[0] + b[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        some = (np.asarray(a[0]) > 0) & (np.asarray(b[0]) > 0)
        apart = np.where(some, (np.divide(b[1], b[0]) - np.divide(a[1], a[0])) ** 2 * (np.multiply(a[0], b[0]) / np.maximum(n, 1)), 0.0)
    return n, a[1] + b[1], a[2] + b[2] + apart, np.maximum(a[3], b[3]), np.minimum(a[4], b[4])


def _stretches(lifts: _Lifts, low: np.ndarray, high: np.ndarray, want: set[str]) -> tuple:
    got = lifts.over(low, high, want)
    at = lambda name, none: got[name] if name in got else np.full(len(low), none)
    return high - low + 1, at("sum", 0.0), at("m2", 0.0), at("max", -np.inf), at("min", np.inf)


def _piece_stats(table: pa.Table, key: str, stats: list[Stat], windows: list[str], amount: str) -> tuple[pa.Table, list[pa.Array], dict]:
    """A piece's own rows, their moments as far as the piece has them, and what the pieces beside it have to know of it. Rows are
    sorted by key, time and kind: 0 for one that comes, k + 1 for one that leaves windows[k]."""
    at, kind = table.column("_at").to_numpy().astype(np.int64), table.column("_kind").to_numpy()
    keys = table.column(key).combine_chunks()
    codes = pc.dictionary_encode(keys).indices.to_numpy(zero_copy_only=False)
    segment = np.cumsum(np.r_[False, codes[1:] != codes[:-1]])
    x = table.column(amount).cast(pa.float64()).fill_null(0.0).to_numpy()
    own = np.flatnonzero(kind == 0)
    t, of, lifts = at[own], segment[own], _Lifts(x[own])
    whole = {"sum", "m2", "max", "min"}
    run = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (of[1:] != of[:-1])]) if len(own) else np.zeros(0, int)
    peers = np.repeat(np.r_[run[1:], len(own)] - 1, np.diff(np.r_[run, len(own)])) if len(own) else run
    stretch = lambda lifts, low, high, want=whole: tuple(v[0].item() for v in _stretches(lifts, np.array([low]), np.array([high]), want))
    name = lambda k: keys[int(k)].as_py()
    # equal times at either end: those that go on in the next piece, and those that came in the one before
    open_ = np.full(len(own), False)
    about: dict = {"head": None, "tail": None, "all_head": len(run) == 1, "groups": {}}
    if len(own):
        open_[run[-1] :] = True
        about["head"], about["tail"] = (name(own[0]), int(t[0])), (name(own[-1]), int(t[-1]))
        about["head_moments"] = stretch(lifts, 0, int(peers[0]))
    first_of = np.searchsorted(of, of)
    place = np.arange(len(own)) - first_of + 1
    columns = [pa.array(place), pa.array(of == segment[0]), pa.array(open_)]
    last_of = np.searchsorted(of, segment[-1])
    about["keys"] = (name(0), name(len(at) - 1), int(segment[-1]) + 1, int((of == segment[0]).sum()), int(len(own) - last_of))
    for k, w in enumerate(windows):
        want = _wanted(stats, w)
        rows = np.flatnonzero((kind == 0) | (kind == k + 1))
        if not len(rows):
            columns += [pa.array(np.zeros(0, d)) for d in (np.int64, float, float, float, float, bool, bool)]
            continue
        block = at[rows] // (LENGTHS[w] * SECOND)
        group = np.cumsum(np.r_[False, (block[1:] != block[:-1]) | (segment[rows][1:] != segment[rows][:-1])])
        comes = kind[rows] == 0
        mine, leaves = np.flatnonzero(comes), np.flatnonzero(~comes)
        own_group, left_group = group[mine], group[leaves]
        left = _Lifts(x[rows[leaves]])
        come = _stretches(lifts, np.searchsorted(own_group, own_group), peers, want)
        go = _stretches(left, np.searchsorted(leaves, mine), np.searchsorted(left_group, own_group, side="right") - 1, want)
        columns += [pa.array(v) for v in _both(come, go)] + [pa.array(own_group == 0), pa.array(own_group == group[-1])]
        ends = []
        for g, row in ((0, rows[0]), (group[-1], rows[-1])):
            span = lambda groups, g=g: (int(np.searchsorted(groups, g)), int(np.searchsorted(groups, g, side="right")) - 1)
            ends.append(((name(row), int(at[row] // (LENGTHS[w] * SECOND))), stretch(lifts, *span(own_group)), stretch(left, *span(left_group))))
        about["groups"][w] = (int(group[-1]) + 1, *ends)
    return table.take(pa.array(own)), columns, about


def _beside(about: dict[int, dict], windows: list[str]) -> list[tuple]:
    """For each piece what those beside it add: to the places of its first key, to its last rows of equal times, and by window to its
    first block and to its last one."""
    order = sorted(about)
    places, spills, before, after = {}, {}, {w: {} for w in windows}, {w: {} for w in windows}
    carry = (None, 0)
    for p in order:
        first, last, n, of_first, of_last = about[p]["keys"]
        places[p] = carry[1] if carry[0] == first else 0
        carry = (last, of_last + (places[p] if n == 1 else 0))
    following, more = None, NONE
    for p in reversed(order):
        a = about[p]
        spills[p] = more if a["tail"] is not None and following == a["tail"] else NONE
        following = a["head"]
        more = NONE if a["head"] is None else _both(a["head_moments"], spills[p]) if a["all_head"] else a["head_moments"]
    for w in windows:
        for found, way, side, end, start in ((before, order, 1, 2, 1), (after, order[::-1], 2, 1, 2)):
            held = (None, NONE)
            for p in way:
                if w not in about[p]["groups"]:
                    continue
                groups = about[p]["groups"][w]
                found[w][p] = held[1] if held[0] == groups[start][0] else NONE
                held = (groups[end][0], _both(found[w][p], groups[end][side]) if groups[0] == 1 else groups[end][side])
    plain = lambda m: (int(m[0]), *map(float, m[1:]))
    return [(p, places[p], plain(spills[p]), *(plain(side[w].get(p, NONE)) for w in windows for side in (before, after))) for p in order]


def _pieced(txns: DataFrame, key: str, stats: list[Stat], us: str, tie: str, amount: str, least: int, pieces: int) -> DataFrame:
    """The same from pieces of time. They are written below spark.checkpoint.dir, since a range partitioning isn't the same twice."""
    windows = sorted({w for _, stat, w, _ in stats if w and stat != "distinct"}, key=lambda w: LENGTHS[w])
    ends = F.array(*(F.struct(F.lit(k).alias("kind"), (F.col(us) + F.lit(long * SECOND)).cast("bigint").alias("at")) for k, long in enumerate((0, *(LENGTHS[w] for w in windows)))))
    rows = txns.select("*", F.explode(ends).alias("_end"))
    rows = rows.select(*(F.col(c) if c in (key, tie, amount) else F.when(F.col("_end.kind") == 0, F.col(c)).alias(c) for c in txns.columns), F.col("_end.kind").alias("_kind"), F.col("_end.at").alias("_at"))
    fields = [*txns.schema, T.StructField("_place", T.LongType()), T.StructField("_first", T.BooleanType()), T.StructField("_open", T.BooleanType())]
    for w in windows:
        fields += [T.StructField(f"_{w}_{c}", T.LongType() if c == "n" else T.DoubleType()) for c in _PARTS] + [T.StructField(f"_{w}_{c}", T.BooleanType()) for c in ("first", "last")]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("_part", T.IntegerType()), T.StructField("_about", T.BinaryType())])
    columns, names = txns.columns, [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        from pyspark import TaskContext

        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        part = TaskContext.get().partitionId()
        done, got, about = _piece_stats(table.combine_chunks(), key, stats, windows, amount)
        n = done.num_rows
        arrays = [*(done.column(c).combine_chunks() for c in columns), *got]
        ends = [pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.binary())]
        yield from pa.Table.from_arrays([*arrays, *ends], names=names).to_batches(max_chunksize=10_000)
        note = [pa.nulls(1, a.type) for a in arrays] + [pa.array([part], pa.int32()), pa.array([pickle.dumps(about)], pa.binary())]
        yield from pa.Table.from_arrays(note, names=names).to_batches()

    order = [key, "_at", "_kind", tie]
    written = stored(rows.repartitionByRange(max(2, pieces), *order).sortWithinPartitions(*order).mapInArrow(run, schema), "pieces")
    out = written.filter("_about IS NULL").drop("_about")
    out = out.join(F.broadcast(_notes(written, windows)), "_part")
    struct = lambda w: F.struct(*(F.col(f"_{w}_{c}").alias(c) for c in _PARTS))
    if_ = lambda flag, moments: F.when(F.col(flag), F.col(moments)).otherwise(F.col("_none"))
    none = F.struct(*(F.lit(v).cast("bigint" if c == "n" else "double").alias(c) for c, v in zip(_PARTS, NONE, strict=True)))
    out = out.withColumn("_none", none)
    for w in windows:
        for flag, moments in ((f"_{w}_first", f"_{w}_before"), (f"_{w}_last", f"_{w}_after"), ("_open", "_spill")):
            out = out.withColumn(f"_m_{w}", merged(F.col(f"_m_{w}") if f"_m_{w}" in out.columns else struct(w), if_(flag, moments)))
    of = lambda stat, m: {"count": m["n"], "sum": m["s"], "mean": m["s"] / m["n"], "std": F.sqrt(m["m2"] / m["n"]), "max": m["hi"], "min": m["lo"]}[stat]
    place = F.col("_place") + F.when(F.col("_first"), F.col("_places")).otherwise(0)
    out = out.select(*txns.columns, *((place if stat == "freq" else of(stat, F.col(f"_m_{w}"))).alias(name) for name, stat, w, _ in stats if stat != "distinct"))
    different = [(value, w, name) for name, stat, w, value in stats if stat == "distinct"]
    if different:
        out = out.join(_distinct_by_intervals(txns, key, different, us, tie, least), F.col(tie) == F.col("_tie")).drop("_tie")
    return out.select(*txns.columns, *(name for name, _, _, _ in stats))


def _notes(written: DataFrame, windows: list[str]) -> DataFrame:
    """One row a piece."""
    import pickle

    about = {r["_part"]: pickle.loads(r["_about"]) for r in written.filter("_about IS NOT NULL").select("_part", "_about").collect()}
    moments = "struct<n: bigint, s: double, m2: double, hi: double, lo: double>"
    sides = "".join(f", _{w}_{side} {moments}" for w in windows for side in ("before", "after"))
    return written.sparkSession.createDataFrame(_beside(about, windows), f"_part int, _places bigint, _spill {moments}{sides}")


def _distinct_by_intervals(txns: DataFrame, key: str, wanted: list[tuple[str, str, str]], us: str, tie: str, least: int) -> DataFrame:
    """_tie and for each (value, window, name) how many different values the window holds. A row starts an interval if the same value
    isn't in the window before it, and ends one if it doesn't come again within the window."""
    values = list(dict.fromkeys(v for v, _, _ in wanted))
    changes = []
    for v in values:
        rows = txns.filter(present(v).isNotNull()).select(key, F.col(v).alias("_v"), F.col(us).alias("_at"), F.col(tie).alias("_tie"))
        rows = with_previous(rows, [key, "_v"], "_at", "_tie", least=least, name="_prev")
        rows = with_previous(rows.withColumn("_at", -F.col("_at")), [key, "_v"], "_at", "_tie", least=least, name="_next").withColumn("_at", -F.col("_at"))
        for value, w, name in wanted:
            if value == v:
                long = LENGTHS[w] * SECOND
                opens = F.coalesce(F.col("_at") - F.col("_prev"), F.lit(1 << 62)) > long
                closes = F.coalesce(-F.col("_next") - F.col("_at"), F.lit(1 << 62)) > long
                changes.append(rows.filter(opens).select(key, F.lit(name).alias("_name"), "_at", "_tie", F.lit(1).alias("_change")))
                changes.append(rows.filter(closes).select(key, F.lit(name).alias("_name"), (F.col("_at") + long + 1).alias("_at"), "_tie", F.lit(-1).alias("_change")))
    reads = txns.select(key, F.explode(F.array(*(F.lit(n) for _, _, n in wanted))).alias("_name"), F.col(us).alias("_at"), F.col(tie).alias("_tie"), F.lit(0).alias("_change"), F.lit(1).alias("_read"))
    both = reads
    for c in changes:
        both = both.unionByName(c.withColumn("_read", F.lit(0)))
    seen = running(both, [key, "_name"], ["_at", "_read", "_tie", "_change"], {"_n": F.col("_change")}, least=least).filter("_read = 1")
    return seen.groupBy("_tie").agg(*(F.max(F.when(F.col("_name") == n, F.col("_n"))).alias(n) for _, _, n in wanted))


def sliding(txns: DataFrame, key: str, stats: list[Stat], us: str = "us", tie: str = "event_id", amount: str = "amount", least: int = LEAST, hot: dict[str, DataFrame | None] | None = None) -> DataFrame:
    """Rows of a named key with their statistics: (name, count | sum | mean | std | max | min | distinct | freq, window, value column). freq
    counts the key's rows up to this one. tie must tell rows apart. hot: the hot keys by column (scan.hot_of), where they are known."""
    rows = _named(txns, key)
    hot = hot_keys(rows, [key], least) if hot is None else hot[key]
    if hot is None:
        return _streamed(rows, key, stats, us, tie, amount)
    pieces = hot.agg(F.sum("_pieces")).first()[0]
    hot = F.broadcast(hot.select(key))
    usual = _streamed(rows.join(hot, key, "left_anti"), key, stats, us, tie, amount)
    return usual.unionByName(_pieced(rows.join(hot, key, "left_semi"), key, stats, us, tie, amount, least, pieces))


USER: list[Stat] = [
    ("user_global_freq", "freq", None, None), *((f"user_txn_count_{k}", "count", k, None) for k in LENGTHS),
    ("user_amount_mean_1h", "mean", "1h", None), ("user_amount_std_1h", "std", "1h", None), ("user_amount_max_24h", "max", "24h", None),
    ("user_unique_cities_1h", "distinct", "1h", "payer_city"), ("user_unique_devices_24h", "distinct", "24h", "device_id"),
]


def user_windows(txns: DataFrame, least: int = LEAST, hot: dict[str, DataFrame | None] | None = None, stats: list[Stat] = USER) -> DataFrame:
    """Per transaction of a named user: counts, mean, deviation (population), maximum and distinct cities and devices."""
    return sliding(txns, "payer_vpa", stats, least=least, hot=hot)


def all_stats(txns: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """For each of the four windows a struct of nine statistics."""
    kinds = ("count", "sum", "mean", "std", "max", "min")
    stats: list[Stat] = [(f"_{s}_{k}", s, k, None) for k in LENGTHS for s in kinds]
    stats += [(f"_{n}_{k}", "distinct", k, v) for k in LENGTHS for v, n in (("payer_city", "cities"), ("device_id", "devices"))]
    rows = sliding(txns, key, stats, least=least)
    c = lambda s, k: F.col(f"_{s}_{k}")
    out = [
        F.struct(
            c("count", k).alias("count"), F.round(c("sum", k), 2).alias("sum"), F.round(c("mean", k), 2).alias("mean"), F.round(c("std", k), 2).alias("std"), c("max", k).alias("max"),
            c("min", k).alias("min"), c("cities", k).alias("unique_cities"), c("devices", k).alias("unique_devices"), F.round(c("count", k) / F.lit(seconds / 60), 4).alias("velocity"),
        ).alias(f"stats_{k}")
        for k, seconds in LENGTHS.items()
    ]
    return rows.select(*txns.columns, *out)


def totals_asof(events: DataFrame, probes: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """For each probe (key, at, and its other columns) the count and sum of events (key, us, amount) up to and with `at`.

    A sort-merge as-of form: events and probes are ordered together, so the cost is that of one sort. An event_id, if there is one,
    tells events of one time apart."""
    extra = [c for c in probes.columns if c not in (key, "at")]
    tie = [c for c in ("event_id", "us", "amount") if c in events.columns]
    both = events.select(F.col(key), F.col("us").alias("at"), F.lit(0).alias("_probe"), F.xxhash64(*tie).alias("_tie"), F.lit(1).alias("_n"), F.coalesce("amount", F.lit(0.0)).alias("_x"), *(F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra))
    both = both.unionByName(probes.select(key, "at", F.lit(1).alias("_probe"), F.xxhash64(*extra).alias("_tie") if extra else F.lit(0).cast("bigint").alias("_tie"), F.lit(0).alias("_n"), F.lit(0.0).alias("_x"), *extra))
    out = running(both, [key], ["at", "_probe", "_tie"], {"n": F.col("_n"), "total": F.col("_x")}, least=least)
    return out.filter("_probe = 1").select(key, "at", *extra, "n", "total")


def entity_windows(txns: DataFrame, key: str, windows: list[str], least: int = LEAST, hot: dict[str, DataFrame | None] | None = None) -> DataFrame:
    """event_id with n_<window> and total_<window> for the entity's rolling windows, and freq, its transactions up to this one;
    rows of unnamed entities are absent."""
    stats: list[Stat] = [x for w in windows for x in ((f"n_{w}", "count", w, None), (f"total_{w}", "sum", w, None))]
    out = sliding(txns.select("event_id", key, "us", "amount"), key, [*stats, ("freq", "freq", None, None)], least=least, hot=hot)
    return out.select("event_id", *(name for name, _, _, _ in stats), "freq")


def stats_asof(txns: DataFrame, probes: DataFrame, key: str, window: str, least: int = LEAST) -> DataFrame:
    """probe columns with count, sum and mean of the window that ends at each probe's `now`; empty windows give zeros."""
    ends = F.array(F.struct(F.lit(1).alias("sign"), F.col("now").alias("at")), F.struct(F.lit(-1).alias("sign"), (F.col("now") - LENGTHS[window] * SECOND - 1).alias("at")))
    points = probes.select(key, "now", F.explode(ends).alias("p")).select(key, "now", "p.sign", "p.at")
    found = totals_asof(txns, points, key, least)
    out = found.groupBy(key, "now").agg(F.sum(F.col("n") * F.col("sign")).alias("count"), F.sum(F.col("total") * F.col("sign")).alias("total"))
    return out.select(key, "now", "count", F.when(F.col("count") > 0, F.col("total")).otherwise(0.0).alias("sum"), F.when(F.col("count") > 0, F.col("total") / F.col("count")).otherwise(0.0).alias("mean"))


def running_frequency(txns: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """event_id, freq: how many of the entity's transactions there are up to this one, itself included."""
    return running(_named(txns, key).select("event_id", key, "us"), [key], ["us", "event_id"], {"freq": F.lit(1)}, least=least).select("event_id", "freq")


def with_previous(rows: DataFrame, keys: str | list[str], at: str, tie: str, least: int = LEAST, name: str = "previous") -> DataFrame:
    """Adds the key's time before each row. Pieces of a hot key are ordered apart; a piece's first row looks at the last time of those before."""
    keys = [keys] if isinstance(keys, str) else keys
    pieced, several = cut(rows, keys, [at, tie], least)
    inside = F.lag(at).over(Window.partitionBy(*keys, *["_piece"] * several).orderBy(at, tie))
    if not several:
        return pieced.withColumn(name, inside).drop("_piece")
    last = pieced.groupBy(*keys, "_piece").agg(F.max(at).alias("_last"))
    before = last.select(*keys, "_piece", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_piece")).alias("_before"))
    return pieced.join(before, [*keys, "_piece"]).withColumn(name, F.coalesce(inside, "_before")).drop("_piece", "_before")


def timing_regularity(txns: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """Deviation of the times between an entity's transactions over their mean; null below three transactions."""
    rows = with_previous(txns.filter(F.col(key).isNotNull()).select(key, "us", "event_id"), key, "us", "event_id", least)
    gaps = rows.select(key, ((F.col("us") - F.col("previous")) / F.lit(float(SECOND))).alias("gap"))
    return gaps.groupBy(key).agg(F.count("gap").alias("n_gaps"), F.when(F.count("gap") >= 2, F.stddev_pop("gap") / F.avg("gap")).alias("regularity"))


def ewma_last(rows: DataFrame, key: str, value: str, at: str, tie: str, decay: float = 0.95, least: int = LEAST) -> DataFrame:
    """key, ewma: the exponential average after the key's last value. A value's weight follows from how many come after it, so
    no history is gathered: the first counts decay^(n-1), another (1 - decay) decay^(values after it)."""
    rows = rows.select(key, at, tie, F.col(value).cast("double").alias("_x"))
    placed = running(rows, [key], [at, tie], {"_place": F.lit(1)}, least=least)
    sizes = rows.groupBy(key).agg(F.count("*").alias("_all"))
    weight = F.when(F.col("_place") == 1, 1.0).otherwise(1 - decay) * F.pow(F.lit(decay), F.col("_all") - F.col("_place"))
    return placed.join(sizes, key).groupBy(key).agg(F.sum(F.col("_x") * weight).alias("ewma"))


def first_seen(txns: DataFrame, key: str) -> DataFrame:
    """Each entity's first transaction: key, event_id, us. A partial aggregation, no window."""
    return txns.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min(F.struct("us", "event_id")).alias("f")).select(key, "f.event_id", "f.us")


def recent(txns: DataFrame, key: str, n: int, order: list[str]) -> DataFrame:
    """The last n rows of each entity; 0 means all."""
    if n <= 0:
        return txns
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return txns.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n).drop("_place")
