"""Running aggregates by key that neither a hot key nor a burst of one keeps in one task.

Keys with more than their share of rows are cut: a range partitioning of their rows by the order asked for gives the cuts, a few for each
such key, so a piece holds about as many rows as any other however close in time they are. Pieces are aggregated apart and what
a piece starts with, the aggregate of those before, comes from one row a piece. All other keys take a window as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key of fewer rows is never cut; a piece of a cut one has a sixteenth of these at least.
LEAST = 1 << 16
#: A piece of a cut key has about these rows at most, however few tasks there are.
MOST = 1 << 19


def _width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(rows: DataFrame, keys: list[str], least: int = LEAST) -> DataFrame | None:
    """The keys that hold more rows than two tasks' share, with the pieces to cut them into; None if there are none. There are fewer
    of them than half the shuffle partitions."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    size = counts.agg(F.max("_n").alias("hottest"), F.sum("_n").alias("all")).first()
    limit = max(least, 2 * (size["all"] or 0) // _width(rows))
    if (size["hottest"] or 0) <= limit:
        return None
    piece = max(least // 16, min(size["all"] // (2 * _width(rows)), MOST), 1)
    found = counts.filter(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / piece).cast("int").alias("_pieces")).collect()
    return rows.sparkSession.createDataFrame(found, T.StructType([*(rows.schema[k] for k in keys), T.StructField("_pieces", T.IntegerType())]))


def hot_of(rows: DataFrame, keys: list[str], least: int = LEAST, leasts: dict[str, int] | None = None) -> dict[str, DataFrame | None]:
    """hot_keys of each of several text columns by itself, empty values aside, in one pass. leasts: other ones for some columns."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("_kind"), F.col(k).alias("_key")) for k in keys)))
    counts = rows.select(each.alias("e")).select("e.*").filter(F.coalesce("_key", F.lit("")) != "").groupBy("_kind", "_key").agg(F.count("*").alias("_n"))
    width = _width(rows)
    # partial sums and a broadcast: a window would take all keys of a column through one task; the counts' shuffle is used for both
    sizes = counts.join(F.broadcast(counts.groupBy("_kind").agg(F.sum("_n").alias("_all"))), "_kind")
    own = F.lit(least)
    for k, n in (leasts or {}).items():
        own = F.when(F.col("_kind") == k, n).otherwise(own)
    limit, piece = F.greatest(own, F.expr(f"2 * _all div {width}")), F.greatest(F.lit(1), (own / 16).cast("int"), F.least(F.expr(f"_all div {2 * width}"), F.lit(MOST)))
    found = sizes.filter(F.col("_n") > limit).select("_kind", "_key", F.ceil(F.col("_n") / piece).cast("int").alias("_pieces")).collect()
    of = {k: [(r["_key"], r["_pieces"]) for r in found if r["_kind"] == k] for k in keys}
    return {k: rows.sparkSession.createDataFrame(own, f"{k} string, _pieces int") if own else None for k, own in of.items()}


def cut(rows: DataFrame, keys: list[str], order: list[str], least: int = LEAST, hot: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Adds _piece, which doesn't decrease in the order within a key, and tells whether any key has more than one."""
    hot = hot_keys(rows, keys, least) if hot is None else hot
    if hot is None:
        return rows.withColumn("_piece", F.lit(0)), False
    pieces = hot.agg(F.sum("_pieces")).first()[0]
    mine = rows.join(F.broadcast(hot.drop("_pieces")), keys, "left_semi").select(*keys, F.struct(*order).alias("_at"))
    ranged = mine.repartitionByRange(max(2, pieces), *keys, "_at").withColumn("_part", F.spark_partition_id())
    found = ranged.groupBy(*keys, "_part").agg(F.min("_at").alias("_at")).groupBy(*keys).agg(F.sort_array(F.collect_list("_at")).alias("_cuts"))
    held = found.collect()  # one place a piece
    step = max(1, math.isqrt(max((len(r["_cuts"]) for r in held), default=1)))
    groups = [(*(r[k] for k in keys), [r["_cuts"][k : k + step] for k in range(0, len(r["_cuts"]), step)]) for r in held]
    cuts = rows.sparkSession.createDataFrame(groups, T.StructType([*(rows.schema[k] for k in keys), T.StructField("_cuts", T.ArrayType(found.schema["_cuts"].dataType))]))
    at = F.struct(*order)
    coarse = F.size(F.filter("_cuts", lambda g: g[0] <= at))
    fine = F.size(F.filter(F.element_at("_cuts", coarse), lambda c: c <= at))
    piece = F.when(F.col("_cuts").isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + fine)
    return rows.join(F.broadcast(cuts), keys, "left").withColumn("_piece", piece).drop("_cuts"), True


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None, least: int = LEAST) -> DataFrame:
    """Adds running sums and maxima, nulls aside, in a total order within each key, each row's own value included."""
    sums, tops = sums or {}, tops or {}
    pieced, several = cut(rows, keys, order, least)
    inside = Window.partitionBy(*keys, *["_piece"] * several).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not several:
        return pieced.select(*rows.columns, *(F.sum(x).over(inside).alias(n) for n, x in sums.items()), *(F.max(x).over(inside).alias(n) for n, x in tops.items()))
    whole = pieced.groupBy(*keys, "_piece").agg(*(F.sum(x).alias(f"_b_{n}") for n, x in sums.items()), *(F.max(x).alias(f"_b_{n}") for n, x in tops.items()))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select(*keys, "_piece", *(F.sum(f"_b_{n}").over(before).alias(f"_b_{n}") for n in sums), *(F.max(f"_b_{n}").over(before).alias(f"_b_{n}") for n in tops))
    return pieced.join(starts, [*keys, "_piece"]).select(
        *rows.columns,
        *(F.coalesce(F.sum(x).over(inside) + F.col(f"_b_{n}"), F.col(f"_b_{n}"), F.sum(x).over(inside)).alias(n) for n, x in sums.items()),
        *(_later(F.max(x).over(inside), F.col(f"_b_{n}")).alias(n) for n, x in tops.items()),
    )


def _later(x: Column, y: Column) -> Column:
    """The greater of two, of which either may be null."""
    return F.when(y.isNull() | (x >= y), x).otherwise(y)


def running_moments(rows: DataFrame, keys: list[str], order: list[str], value: str, least: int = LEAST) -> DataFrame:
    """Adds n, s, m2, hi, lo of the values up to each row: count, sum, squared deviations from their mean, greatest and least."""
    pieced, several = cut(rows, keys, order, least)
    x = F.col(value)
    moments = {"n": F.count(x), "s": F.coalesce(F.sum(x), F.lit(0.0)), "m2": F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)), "hi": F.max(x), "lo": F.min(x)}
    inside = Window.partitionBy(*keys, *["_piece"] * several).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = {"n": F.count(x).over(inside), "s": F.coalesce(F.sum(x).over(inside), F.lit(0.0)), "m2": F.coalesce(F.var_pop(x).over(inside) * F.count(x).over(inside), F.lit(0.0)), "hi": F.max(x).over(inside), "lo": F.min(x).over(inside)}
    own = pieced.select(*rows.columns, "_piece", *(c.alias(n) for n, c in over.items()))
    if not several:
        return own.drop("_piece")
    whole = pieced.groupBy(*keys, "_piece").agg(F.struct(*(c.alias(n) for n, c in moments.items())).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("m2"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("double").alias("lo"))
    starts = whole.select(*keys, "_piece", F.aggregate(F.collect_list("_m").over(before), none, merged).alias("_b"))
    both = own.join(starts, [*keys, "_piece"]).withColumn("_m", merged(F.col("_b"), F.struct("n", "s", "m2", "hi", "lo")))
    return both.select(*rows.columns, "_m.*")


def merged(a: Column, b: Column) -> Column:
    """The moments of two disjoint sets of values together."""
    n = a["n"] + b["n"]
    apart = b["s"] / b["n"] - a["s"] / a["n"]
    m2 = a["m2"] + b["m2"] + F.when((a["n"] > 0) & (b["n"] > 0), apart * apart * (a["n"] * b["n"] / n)).otherwise(0.0)
    return F.struct(n.alias("n"), (a["s"] + b["s"]).alias("s"), m2.alias("m2"), F.greatest(a["hi"], b["hi"]).alias("hi"), F.least(a["lo"], b["lo"]).alias("lo"))
