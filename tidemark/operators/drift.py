"""Distribution drift: equal-frequency edges, histograms and the population stability index, per feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import digitize

FLOOR = 1e-4


def melt(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per feature and row."""
    return df.select(*(keep or []), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("f")).select(*(keep or []), "f.feature", "f.x")


def reference(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """feature, interior edges (percentiles by linear interpolation), mean, deviation: one row per feature."""
    from .metrics import order_statistics

    rows = melt(df, columns)
    moments = rows.groupBy("feature").agg(F.avg("x").alias("mean"), (F.stddev_pop("x") + 1e-8).alias("std"), F.count("*").alias("n"))
    return order_statistics(rows, "feature", "x", [k / bins for k in range(1, bins)]).join(moments, "feature").select("feature", "edges", "mean", "std", "n")


def save_reference(ref: DataFrame, path: str) -> None:
    """One row a feature: edges and moments, as they are."""
    ref.coalesce(1).write.mode("overwrite").parquet(path)


def load_reference(spark, path: str) -> DataFrame:
    return spark.read.schema("feature string, edges array<double>, mean double, std double, n bigint").parquet(path)


def histogram(df: DataFrame, columns: list[str], ref: DataFrame) -> DataFrame:
    """feature, bin, cnt, n: values below the first interior edge are bin 0; NaN counts in n only."""
    rows = melt(df, columns).join(F.broadcast(ref.select("feature", "edges")), "feature")
    binned = rows.withColumn("bin", F.when(~F.isnan("x"), digitize(F.col("x"), F.col("edges"))))
    counted = binned.groupBy("feature", "bin").agg(F.count("*").alias("cnt"))
    return counted.withColumn("n", F.sum("cnt").over(Window.partitionBy("feature"))).filter("bin IS NOT NULL")


def psi(expected: DataFrame, actual: DataFrame, ref: DataFrame, bins: int = 10) -> DataFrame:
    """feature, psi of two histograms: shares at least FLOOR, scaled to one again."""
    grid = ref.select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    both = grid.join(expected.select("feature", "bin", (F.col("cnt") / F.col("n")).alias("e")), ["feature", "bin"], "left").join(actual.select("feature", "bin", (F.col("cnt") / F.col("n")).alias("a")), ["feature", "bin"], "left")
    clipped = both.select("feature", "bin", F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(FLOOR)).alias("e"), F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(FLOOR)).alias("a"))
    w = Window.partitionBy("feature")
    scaled = clipped.select("feature", (F.col("e") / F.sum("e").over(w)).alias("e"), (F.col("a") / F.sum("a").over(w)).alias("a"))
    return scaled.groupBy("feature").agg(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi"))


def label(value: Column) -> Column:
    return F.when(value < 0.10, "stable").when(value < 0.20, "monitor").otherwise("alert")


def report(base: DataFrame, current: DataFrame, columns: list[str], bins: int = 10, ref: DataFrame | None = None) -> DataFrame:
    """feature, psi, status, mean_shift in deviations of the reference, which may be a loaded one."""
    ref = reference(base, columns, bins) if ref is None else ref
    values = psi(histogram(base, columns, ref), histogram(current, columns, ref), ref, bins)
    means = melt(current, columns).groupBy("feature").agg(F.avg("x").alias("now"))
    out = values.join(ref.select("feature", "mean", "std"), "feature").join(means, "feature")
    return out.select("feature", "psi", label(F.col("psi")).alias("status"), ((F.col("now") - F.col("mean")) / F.col("std")).alias("mean_shift"))


def top_drifted(rep: DataFrame, k: int = 5) -> DataFrame:
    return rep.orderBy(F.col("psi").desc(), "feature").limit(k)


def overall(rep: DataFrame, score: str = "score") -> DataFrame:
    """alert if the score drifts by 0.10 or any feature by 0.20; the first five features above it by name."""
    score_psi = F.max(F.when(F.col("feature") == score, F.col("psi")))
    high = F.filter(F.array_sort(F.collect_list(F.when((F.col("feature") != score) & (F.col("psi") >= 0.20), F.col("feature")))), lambda x: x.isNotNull())
    return rep.agg(score_psi.alias("score_psi"), F.slice(high, 1, 5).alias("features")).select("score_psi", "features", ((F.coalesce("score_psi", F.lit(0.0)) >= 0.10) | (F.size("features") > 0)).alias("alert"))


def status_counts(rep: DataFrame) -> DataFrame:
    return rep.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("alert", "monitor", "stable")))


def normalizer(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean, std (population, plus 1e-8)."""
    return melt(df, columns).groupBy("feature").agg(F.avg("x").alias("mean"), (F.stddev_pop("x") + 1e-8).alias("std"))


def normalize(df: DataFrame, columns: list[str], stats: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns with each feature's z-score. The statistics are one row of two numbers a feature."""
    wide = stats.agg(*(F.max(F.when(F.col("feature") == c, F.struct("mean", "std"))).alias(f"_{c}") for c in columns))
    return df.crossJoin(F.broadcast(wide)).select(*keep, *(((F.col(c) - F.col(f"_{c}.mean")) / F.col(f"_{c}.std")).alias(c) for c in columns))


def windows_of(rows: DataFrame, order: list[str], size: int = 500) -> DataFrame:
    """Adds the number of the drift window that each row falls in. Places come from counts by partition of a range sort, so
    no single task numbers all rows."""
    from .metrics import global_place

    return global_place(rows, order, "_place").withColumn("window", F.floor((F.col("_place") - 1) / size)).drop("_place")
