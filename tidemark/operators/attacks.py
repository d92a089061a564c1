"""Six attack scenarios as arithmetic over a range, and the report of how they fare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.transactions import CITIES
from .metrics import percentile_nearest

#: Codes that attacks use, pairs of distant cities, and each attack's number of transactions in the suite.
CODES = ["5411", "5812", "5541", "5999", "6051"]
PAIRS = [("Mumbai", "Delhi"), ("Bangalore", "Kolkata"), ("Chennai", "Ahmedabad"), ("Hyderabad", "Jaipur")]
SUITE = {"velocity": 30, "device_farm": 150, "low_and_slow": 20, "amount_splitting": 8, "geo_spoofing": 20, "bot": 40}


def spread(attack: str, i: Column, seed: int) -> Column:
    """A number in [0, 1) for a step of an attack, the same in any engine: a multiplicative sequence."""
    return ((i * 7919 + len(attack) * 104729 + seed) % 10007) / 10007.0


def _rows(spark: SparkSession, attack: str, n: int, user: Column, merchant: Column, amount: Column, city: Column, device: Column, seconds: Column) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(
        F.lit(attack).alias("attack"), i.alias("step"), F.concat(F.lit(f"atk_{attack}_"), i.cast("string")).alias("transaction_id"), user.alias("payer_vpa"), merchant.alias("payee_vpa"),
        amount.cast("double").alias("amount"), F.element_at(F.array(*map(F.lit, CODES)), (i % len(CODES) + 1).cast("int")).alias("merchant_category_code"), city.alias("payer_city"), device.alias("device_id"),
        F.floor(seconds * 1_000_000).cast("bigint").alias("us"), F.create_map(F.lit("attack"), F.lit(attack), F.lit("sequence"), i.cast("string")).alias("metadata"),
    )


def _name(prefix: str, x: Column) -> Column:
    return F.concat(F.lit(prefix), x.cast("string"))


def velocity(spark: SparkSession, n: int = 50, amount: float = 4500.0, interval: float = 30.0, seed: int = 0) -> DataFrame:
    i = F.col("id")
    return _rows(spark, "velocity", n, F.lit("u_vel"), F.lit("merch_vel"), amount - 50 + 100 * spread("velocity", i, seed), F.lit("Mumbai"), F.lit("dev_vel"), i * interval)


def device_farm(spark: SparkSession, users: int = 200, devices: int = 5, each: int = 3, low: float = 500.0, high: float = 2000.0, seed: int = 0) -> DataFrame:
    i = F.col("id")
    user = F.floor(i / each)
    cities = list(CITIES)
    city = F.element_at(F.array(*map(F.lit, cities)), (i % len(cities) + 1).cast("int"))
    return _rows(spark, "device_farm", users * each, _name("u_farm_", user), _name("merch_", i % 20 + 1), low + (high - low) * spread("device_farm", i, seed), city, _name("dev_farm_", user % devices), i * 20)


def low_and_slow(spark: SparkSession, days: int = 7, final: float = 50_000.0, each: int = 4, seed: int = 0) -> DataFrame:
    """Amounts rise with the square of the day's share; one day alone has the final amount's start."""
    i = F.col("id")
    day = F.floor(i / each)
    share = day / F.lit(float(max(1, days - 1)))
    usual = 500 + (final - 500) * share * share
    return _rows(spark, "low_and_slow", days * each, F.lit("u_las"), _name("merch_", i % 10 + 1), F.greatest(F.lit(100.0), usual * (0.9 + 0.2 * spread("low_and_slow", i, seed))), F.lit("Bangalore"), F.lit("dev_las"), day * 86_400 + (i % each) * 21_600)


def amount_splitting(spark: SparkSession, target: float = 100_000.0, n: int = 10, seed: int = 0) -> DataFrame:
    """Parts of random weight that add up to the target, over 48 hours."""
    total = sum(0.5 + ((k * 7919 + len("amount_splitting") * 104729 + seed) % 10007) / 10007.0 for k in range(n))
    i = F.col("id")
    cities = list(CITIES)
    city = F.element_at(F.array(*map(F.lit, cities)), (i * 3 % len(cities) + 1).cast("int"))
    return _rows(spark, "amount_splitting", n, F.lit("u_split"), _name("merch_split_", i), F.round((0.5 + spread("amount_splitting", i, seed)) / total * target, 2), city, F.lit("dev_split"), i * (48 * 3600.0 / n))


def geo_spoofing(spark: SparkSession, n: int = 20, seed: int = 0) -> DataFrame:
    i = F.col("id")
    flat = [PAIRS[k % 4][k % 2] for k in range(4)]
    return _rows(spark, "geo_spoofing", n, F.lit("u_geo"), _name("merch_", i % 20 + 1), 500 + 4500 * spread("geo_spoofing", i, seed), F.element_at(F.array(*map(F.lit, flat)), (i % 4 + 1).cast("int")), F.lit("dev_geo"), i * 3660)


def bot(spark: SparkSession, n: int = 100, amount: float = 999.0, interval: float = 60.0, seed: int = 0) -> DataFrame:
    i = F.col("id")
    return _rows(spark, "bot", n, F.lit("u_bot"), _name("merch_bot_", i % 5), amount + (i % 3) * 0.01, F.lit("Mumbai"), F.lit("dev_bot"), i * interval)


def suite(spark: SparkSession, seed: int = 0) -> DataFrame:
    parts = [
        velocity(spark, SUITE["velocity"], seed=seed), device_farm(spark, SUITE["device_farm"] // 3, seed=seed), low_and_slow(spark, SUITE["low_and_slow"] // 4, seed=seed),
        amount_splitting(spark, n=SUITE["amount_splitting"], seed=seed), geo_spoofing(spark, SUITE["geo_spoofing"], seed), bot(spark, SUITE["bot"], seed=seed),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(scored: DataFrame) -> DataFrame:
    """By attack and for all: counts by decision, rates, mean and p99 latency. scored: attack, decision, latency_ms."""
    n, blocked, reviewed = F.count("*"), F.count_if(F.col("decision") == "BLOCK"), F.count_if(F.col("decision") == "REVIEW")
    out = scored.rollup("attack").agg(
        n.alias("n"), blocked.alias("blocked"), reviewed.alias("reviewed"), F.count_if(F.col("decision") == "PASS").alias("passed"),
        ((blocked + reviewed) / n).alias("detection_rate"), (blocked / n).alias("block_rate"), F.avg("latency_ms").alias("avg_latency_ms"), percentile_nearest("latency_ms", 0.99).alias("p99_latency_ms"),
    )
    return out.withColumn("attack", F.coalesce("attack", F.lit("ALL")))


def run(spark: SparkSession, score: Callable[[DataFrame], DataFrame], seed: int = 0) -> DataFrame:
    """The suite through a function that adds decision and latency_ms."""
    return report(score(suite(spark, seed)))


def summary(rep: DataFrame) -> str:
    rows = rep.orderBy("attack").collect()
    lines = [f"{r['attack']:<18} n={r['n']:>5} blocked={r['blocked']:>5} reviewed={r['reviewed']:>5} detected={r['detection_rate']:.1%} p99={r['p99_latency_ms']:.2f} ms" for r in rows]
    return "\n".join(lines)
