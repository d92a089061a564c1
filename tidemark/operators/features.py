"""The 23 features of a transaction."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES
from .scan import MOST, hot_of
from .windows import USER, Stat, sliding, user_windows


def transaction_features(txns: DataFrame, ts: str = "ts") -> DataFrame:
    """Hour, weekday (Monday 0) and weekend; an unreadable time counts as noon of a Monday."""
    return txns.select(
        "*",
        F.coalesce(F.hour(ts), F.lit(12)).alias("hour_of_day"),
        F.coalesce(F.weekday(ts), F.lit(0)).alias("day_of_week"),
        F.coalesce((F.weekday(ts) >= 5).cast("int"), F.lit(0)).alias("is_weekend"),
    )


def with_defaults(txns: DataFrame) -> DataFrame:
    """Missing values by column: amount 0, not a new device, device age 9,999 hours."""
    fill = {"amount": 0.0, "is_new_device": False, "device_age_hours": 9999.0}
    return txns.select(*(F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in txns.columns))


def amount_zscore(amount: Column, mean: Column, std: Column) -> Column:
    """Against the rounded mean and the rounded deviation, the latter at least 1; four places."""
    return F.round((amount - F.round(mean, 2)) / F.greatest(F.round(std, 2), F.lit(1.0)), 4)


def _of_entity(txns: DataFrame, key: str, stats: list[Stat], hot: dict[str, DataFrame | None]) -> DataFrame:
    return sliding(txns.select("event_id", key, "us", "amount"), key, stats, hot=hot).select("event_id", *(name for name, _, _, _ in stats))


DEVICE: list[Stat] = [("device_txn_count_1h", "count", "1h", None), ("device_txn_count_24h", "count", "24h", None), ("device_global_freq", "freq", None, None)]
MERCHANT: list[Stat] = [("merchant_txn_count_1h", "count", "1h", None), ("merchant_amount_mean_1h", "mean", "1h", None), ("merchant_global_freq", "freq", None, None)]


def features(txns: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """All features beside the transaction's own columns: a shuffle by each entity and one join by event_id. Transactions of
    an unnamed entity have zeros for it. Devices and merchants pass with four columns, so one is cut only where it has more rows than
    a piece holds: a stream takes a row once, pieces take it once and again for each window.

    only: the columns that are read afterwards, where that is known; of all rows event_id and these are given, and no other
    statistic is taken. Catalyst can't tell, since it doesn't look into Python."""
    txns = transaction_features(with_defaults(txns))
    wanted = {*txns.columns, *FEATURES} if only is None else {"event_id", *only}
    asked = wanted | ({"user_amount_mean_1h", "user_amount_std_1h"} if "amount_zscore_1h" in wanted else set())
    user, device, merchant = ([s for s in stats if s[0] in asked] for stats in (USER, DEVICE, MERCHANT))
    entities = [(key, stats) for key, stats in (("device_id", device), ("payee_vpa", merchant)) if stats]
    keys = ["payer_vpa"] * bool(user) + [key for key, _ in entities]
    hot = hot_of(txns, keys, leasts={key: MOST for key, _ in entities}) if keys else {}
    carried = wanted | {"us", "payer_vpa", "amount"} | {value for _, _, _, value in user if value}
    out = txns.select(*(c for c in txns.columns if c in carried))
    if user:
        unnamed = F.coalesce(F.col("payer_vpa"), F.lit("")) == ""
        out = user_windows(out, hot=hot, stats=user).unionByName(out.filter(unnamed), allowMissingColumns=True)
    if entities:
        found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (_of_entity(txns, key, stats, hot) for key, stats in entities))
        found = found.groupBy("event_id").agg(*(F.max(c).alias(c) for c in found.columns if c != "event_id"))
        out = out.join(found, "event_id", "left")
    there = [name for name, _, _, _ in (*user, *device, *merchant)]
    counts = [c for c in there if "count" in c or "freq" in c or "unique" in c]
    out = out.fillna(0, counts).fillna(0.0, [c for c in there if c not in counts])
    if "amount_zscore_1h" in wanted:
        out = out.withColumn("amount_zscore_1h", amount_zscore(F.col("amount"), F.col("user_amount_mean_1h"), F.col("user_amount_std_1h")))
    return out if only is None else out.select(*(c for c in out.columns if c in wanted))


def vector(columns: list[str] = FEATURES) -> Column:
    """The features in their order as floats; missing ones are 0."""
    return F.array(*(F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in columns))


def padded(vectors: Column, width: int) -> Column:
    """Right-padded with zeros."""
    return F.concat(vectors, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), F.lit(width) - F.size(vectors))))
