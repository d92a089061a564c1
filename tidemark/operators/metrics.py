"""Measures of decisions, scores and models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clean_number
from .scan import LEAST, running


def global_place(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds each row's place from 1 in a total order. The order must be total for the places to be defined."""
    return running_sums(df.withColumn("_one", F.lit(1)), order, {name: "_one"}).drop("_one")


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds running sums of columns in a total order, each row's own value included: all rows are one key, cut at fixed places."""
    return running(df.withColumn("_all", F.lit(0)), ["_all"], order, {n: F.col(c) for n, c in sums.items()}).drop("_all")


def order_statistics(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """group, edges: for each share the value at share * (n - 1), between neighbours by linear interpolation; nulls and NaN
    aside. Distinct values are counted and ordered over all machines; only the few that are asked for come together. There are
    few groups (features)."""
    counts = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(group, value).agg(F.count("*").alias("_n"))
    sizes = counts.groupBy(group).agg(F.sum("_n").alias("_all"))
    before = sizes.withColumn("_skip", F.coalesce(F.sum("_all").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.lit(p) * (F.col("_all") - 1)).alias("at")) for k, p in enumerate(shares))))
    asked = before.select(F.col(group), "_skip", at.alias("a")).select(group, F.col("a.k").alias("k"), (F.col("a.at") - F.floor("a.at")).alias("rest"), (F.floor("a.at") + F.col("_skip") + 1).alias("low"), (F.ceil("a.at") + F.col("_skip") + 1).alias("high"))
    placed = running_sums(counts, [group, value], {"_upto": "_n"}).withColumn("_from", F.col("_upto") - F.col("_n"))
    wanted = F.broadcast(asked.select(F.col(group).alias("_g"), "k", "rest", "low", "high"))
    hit = lambda c: (F.col(c) > F.col("_from")) & (F.col(c) <= F.col("_upto"))
    met = placed.join(wanted, (F.col(group) == F.col("_g")) & (hit("low") | hit("high")))
    pairs = met.groupBy(group, "k", "rest").agg(F.max(F.when(hit("low"), F.col(value))).alias("x"), F.max(F.when(hit("high"), F.col(value))).alias("y"))
    edge = F.struct("k", (F.col("x") + (F.col("y") - F.col("x")) * F.col("rest")).alias("e"))
    return pairs.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(edge)), lambda r: r["e"]).alias("edges"))


def auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Area under the curve from score groups: ties count half. Scores are grouped first, so what is ordered is the distinct
    scores; 0.5 where there is one class only."""
    groups = df.groupBy((-F.col(score)).alias("_down")).agg(F.sum(F.col(y).cast("bigint")).alias("p"), F.sum(1 - F.col(y).cast("bigint")).alias("q"))
    ranked = running_sums(groups, ["_down"], {"before": "p"}).withColumn("before", F.col("before") - F.col("p"))
    total = ranked.agg(F.sum("p").alias("pos"), F.sum("q").alias("neg"), F.sum(F.col("q") * F.col("before") + F.col("p") * F.col("q") / 2).alias("area"))
    return total.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("area") / (F.col("pos") * F.col("neg"))).otherwise(0.5).alias("auc"), F.col("pos").alias("positives"), F.col("neg").alias("negatives"))


def confusion(df: DataFrame, score: str, y: str, threshold: float = 0.5) -> DataFrame:
    hit, real = F.col(score) >= threshold, F.col(y).cast("int") == 1
    out = df.agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"))
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp") + 1e-8), F.col("tp") / (F.col("tp") + F.col("fn") + 1e-8)
    return out.select("tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall + 1e-8)).alias("f1"))


def bce(p: Column, y: Column, eps: float = 1e-7) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def focal(p: Column, y: Column, gamma: float = 2.0, alpha: float = 0.25, eps: float = 1e-7) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    right, weight = F.when(y == 1, q).otherwise(1 - q), F.when(y == 1, F.lit(alpha)).otherwise(F.lit(1 - alpha))
    return -weight * F.pow(1 - right, F.lit(gamma)) * F.log(right)


def percentile_nearest(column: str, share: float) -> Column:
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})")


def latencies(df: DataFrame, column: str, order: list[str], last: int = 10_000) -> DataFrame:
    """Total, decision counts, and nearest-rank p50 and p99 of the last so many rows."""
    tail = df.orderBy(*(F.col(c).desc() for c in order)).limit(last)
    return tail.agg(F.count("*").alias("n"), percentile_nearest(column, 0.5).alias("p50"), percentile_nearest(column, 0.99).alias("p99"))


def histogram_fixed(df: DataFrame, score: str, bins: int = 20) -> DataFrame:
    """bin, cnt for all bins of [0, 1]; 1 falls in the last."""
    counted = df.groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("cnt"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(counted), "bin", "left").select("bin", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def decision_counts(df: DataFrame, decision: str) -> DataFrame:
    return df.groupBy(F.col(decision).alias("decision")).agg(F.count("*").alias("n"))


def kpis(df: DataFrame, order: list[str], last: int = 500) -> DataFrame:
    """Of the last rows of the feed: counts, rates and means."""
    tail = df.orderBy(*(F.col(c).desc() for c in order)).limit(last)
    return tail.agg(
        F.count("*").alias("n"), F.count_if(F.col("decision") == "BLOCK").alias("blocked"), F.count_if(F.col("decision") == "REVIEW").alias("review"),
        (F.count_if(F.col("decision") == "BLOCK") / F.count("*")).alias("block_rate"), F.avg("score").alias("avg_score"),
    )


def label_precision(confirmed: Column, false: Column) -> Column:
    return confirmed / F.greatest(F.lit(1), confirmed + false)


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """n, positives, rate, and weights n / (2 * class)."""
    out = df.agg(F.count("*").alias("n"), F.sum(F.col(y).cast("bigint")).alias("positives"))
    n, p = F.col("n"), F.col("positives")
    return out.select("n", "positives", (p / n).alias("fraud_rate"), (n / (2 * (n - p))).alias("weight_0"), (n / (2 * p)).alias("weight_1"))


def bin_features(df: DataFrame, columns: list[str], keep: list[str], bins: int = 256) -> DataFrame:
    """Each feature's equal-frequency bin. Edges are one array a feature."""
    from .drift import melt
    from ..functions.scalar import digitize

    edges = order_statistics(melt(df, columns), "feature", "x", [k / bins for k in range(1, bins)])
    wide = edges.agg(*(F.first(F.when(F.col("feature") == c, F.col("edges")), ignorenulls=True).alias(f"_{c}") for c in columns))
    return df.crossJoin(F.broadcast(wide)).select(*keep, *(digitize(F.col(c).cast("double"), F.col(f"_{c}")).alias(c) for c in columns))


def stratified(df: DataFrame, y: str, order: list[str], ratio: int = 20) -> DataFrame:
    """All positives, and ratio times as many negatives: those first in a fixed order, by their places in it."""
    flag = F.col(y).cast("int")
    wanted = df.agg((F.count_if(flag == 1) * ratio).alias("_wanted"))
    negatives = global_place(df.filter(flag == 0), order, "_place").crossJoin(F.broadcast(wanted)).filter(F.col("_place") <= F.col("_wanted"))
    return df.filter(flag == 1).unionByName(negatives.select(*df.columns))


def split_positional(df: DataFrame, order: list[str], share: float = 0.8) -> DataFrame:
    """Adds `train`: whether the row is among the first share of the order."""
    n = df.count()
    return global_place(df, order, "_place").withColumn("train", F.col("_place") <= int(share * n)).drop("_place")


def reservoir(df: DataFrame, k: int, seed: int, *of: str) -> DataFrame:
    """k rows, each with equal chance, the same for a seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), *of)).limit(k)


def ewma(values: Column, decay: float = 0.95) -> Column:
    """Ordered fold of an array: the first value, then decay times before plus the rest times now."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(a * decay + x * (1 - decay)))


def rolling_loss(df: DataFrame, key: str, order: str, loss: str, last: int = 50, decay: float = 0.99, least: int = LEAST) -> DataFrame:
    """Adds the mean of the last losses and a slow average of all. A key's rows are parted into blocks, by place, so long that what comes
    before the block before weighs less than rounding does; a block has the last rows of the one before beside its own."""
    long = max(last, math.ceil(math.log(1e-30) / math.log(decay)))
    placed = running(df.withColumn("_x", F.col(loss).cast("double")), [key], [order], {"_place": F.lit(1)}, least=least).withColumn("_place", F.col("_place") - 1)
    own, inside = F.expr(f"_place div {long}"), F.col("_place") % long
    share = F.when(F.col("_place") == 0, 1.0).otherwise(1 - decay)
    placed = placed.withColumns({"_block": own, "_term": F.col("_x") * share * F.pow(F.lit(1 / decay), inside)})
    ends = placed.groupBy(key, "_block").agg((F.sum("_term") * decay ** (long - 1)).alias("_end"))
    before = ends.select(key, (F.col("_block") + 1).alias("_block"), "_end")
    upto = Window.partitionBy(key, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slow = F.pow(F.lit(decay), inside) * (F.sum("_term").over(upto) + decay * F.coalesce("_end", F.lit(0.0)))
    rows = placed.join(before, [key, "_block"], "left").withColumn("baseline_loss", slow).drop("_end", "_term")
    edge = inside >= long - last + 1
    halo = placed.filter(edge).select(key, (F.col("_block") + 1).alias("_block"), "_place", "_x").withColumn("_halo", F.lit(True))
    near = Window.partitionBy(key, "_block").orderBy("_place").rowsBetween(-(last - 1), 0)
    both = rows.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True).withColumn("recent_loss", F.avg("_x").over(near))
    return both.filter("NOT _halo").select(*df.columns, "recent_loss", "baseline_loss")


def feedback(log: DataFrame, labels: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Decisions beside analysts' labels: key, decision, confirmed; the newest label of a transaction counts."""
    newest = labels.groupBy(key).agg(F.max_by("confirmed", "seq").alias("confirmed"))
    return log.select(key, "decision").join(newest, key)


def feedback_precision(joined: DataFrame) -> DataFrame:
    """For each decision the labels and the share that was confirmed."""
    out = joined.groupBy("decision").agg(F.count_if("confirmed").alias("confirmed"), F.count_if(~F.col("confirmed")).alias("false_alarms"))
    return out.withColumn("precision", label_precision(F.col("confirmed"), F.col("false_alarms")))


def review_queue(scored: DataFrame, order: list[str], capacity: int = 50, shown: int = 10) -> DataFrame:
    """The last rows to review that a queue of this capacity shows, newest first."""
    return scored.filter("decision = 'REVIEW'").orderBy(*(F.col(c).desc() for c in order)).limit(min(capacity, shown))


def feed(scored: DataFrame, order: list[str], shown: int = 30) -> DataFrame:
    """The newest rows, newest first."""
    return scored.orderBy(*(F.col(c).desc() for c in order)).limit(shown)


def service_metrics(scored: DataFrame, order: list[str], mode: str = "live", latency: str = "latency_ms") -> DataFrame:
    """One row: transactions scored, decisions by kind, latencies of the last rows, and whether the mode is shadow."""
    counts = scored.agg(F.count("*").alias("total_scored"), *(F.count_if(F.col("decision") == d).alias(d.lower()) for d in ("BLOCK", "REVIEW", "PASS")))
    tail = latencies(scored, latency, order).select(F.round("p50", 2).alias("p50_ms"), F.round("p99", 2).alias("p99_ms"))
    return counts.crossJoin(tail).withColumn("shadow_mode", F.lit(mode == "shadow"))


def cleaned(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(clean_number(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def gradient_sums(df: DataFrame, columns: list[str], g: str, h: str) -> DataFrame:
    """feature, bin, sums of gradient and Hessian up to and with the bin: what a split search reads."""
    from .drift import melt

    sums = melt(df, columns, [g, h]).groupBy("feature", F.col("x").cast("int").alias("bin")).agg(F.sum(g).alias("g"), F.sum(h).alias("h"), F.count("*").alias("n"))
    w = Window.partitionBy("feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("feature", "bin", F.sum("g").over(w).alias("g_left"), F.sum("h").over(w).alias("h_left"), F.sum("n").over(w).alias("n_left"))


def best_split(df: DataFrame, columns: list[str], g: str, h: str, penalty: float = 1.0, least: int = 1) -> DataFrame:
    """The split of greatest gain: feature, bin, gain."""
    left = gradient_sums(df, columns, g, h)
    w = Window.partitionBy("feature")
    both = left.withColumns({f"{c}_all": F.max_by(f"{c}_left", "bin").over(w) for c in ("g", "h", "n")})
    gain = lambda a, b: a * a / (b + penalty)
    value = 0.5 * (gain(F.col("g_left"), F.col("h_left")) + gain(F.col("g_all") - F.col("g_left"), F.col("h_all") - F.col("h_left")) - gain(F.col("g_all"), F.col("h_all")))
    fine = (F.col("n_left") >= least) & (F.col("n_all") - F.col("n_left") >= least)
    return both.filter(fine).select("feature", "bin", value.alias("gain")).orderBy(F.col("gain").desc(), "feature", "bin").limit(1)
