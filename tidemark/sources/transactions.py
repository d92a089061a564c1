"""Transactions from the events table, and a seeded generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Home cities with latitude and longitude, in their listed order.
CITIES = {
    "Mumbai": (19.0760, 72.8777), "Delhi": (28.6139, 77.2090), "Bangalore": (12.9716, 77.5946), "Hyderabad": (17.3850, 78.4867), "Chennai": (13.0827, 80.2707),
    "Kolkata": (22.5726, 88.3639), "Pune": (18.5204, 73.8567), "Ahmedabad": (23.0225, 72.5714), "Jaipur": (26.9124, 75.7873), "Surat": (21.1702, 72.8311),
}
#: Merchant category codes, names and weights; the weights add up to 0.98 and are scaled.
CATEGORIES = [
    ("5411", "Grocery Stores", 0.22), ("5812", "Eating Places", 0.18), ("5541", "Service Stations", 0.10), ("5912", "Drug Stores", 0.08), ("5311", "Department Stores", 0.07),
    ("4111", "Local Transit", 0.06), ("5999", "Retail Misc", 0.05), ("7011", "Hotels/Motels", 0.04), ("4816", "Computer Network Services", 0.04), ("6011", "ATM/Cash", 0.03),
    ("5945", "Electronics", 0.03), ("7922", "Entertainment", 0.03), ("5047", "Medical Supplies", 0.02), ("9399", "Government Services", 0.02), ("6051", "Crypto/Non-Fiat", 0.01),
]
#: Banks, device types, and the codes that the events view deals out.
BANKS = ["HDFC", "SBI", "ICICI", "Axis", "Kotak", "PNB", "BOB", "Canara", "IDFC", "Yes"]
DEVICE_TYPES = ["android", "ios", "web"]
VIEW_CODES = ["5411", "5812", "5541", "5912", "5999", "6051", "7995"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical view of events; `us` is event time in microseconds from 2024, compressed 600 times."""
    return view(events(spark, sf_dir))


def transaction_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same view of the events file as a stream."""
    schema = events(spark, sf_dir).schema
    return view(spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet"))


def view(e: DataFrame) -> DataFrame:
    return e.select(
        "event_id",
        F.concat(F.lit("txn_"), F.col("event_id").cast("string")).alias("transaction_id"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) div 600").alias("us"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("payer_vpa"),
        F.concat(F.lit("merchant_"), F.col("event_type")).alias("payee_vpa"),
        F.concat(F.lit("dev_"), F.get_json_object("props", "$.k")).alias("device_id"),
        (F.col("value") * F.lit(100.0)).alias("amount"),
        pick(list(CITIES), F.col("event_id") % 10).alias("payer_city"),
        pick(VIEW_CODES, F.col("event_id") % 7).alias("merchant_category_code"),
        (F.col("event_id") % 33 == 0).alias("is_new_device"),
        (F.col("event_id") % 8760).cast("double").alias("device_age_hours"),
        (F.col("event_type") == "error").alias("is_fraud"),
    )


def draw(column: Column, weights: list[float]) -> Column:
    """The place that a uniform draw falls on, weights scaled to one."""
    total, upto, out = sum(weights), 0.0, None
    for place, w in enumerate(weights[:-1]):
        upto += w / total
        out = F.when(column < upto, place) if out is None else out.when(column < upto, place)
    return out.otherwise(len(weights) - 1) if out is not None else F.lit(0)


def generate(spark: SparkSession, n: int, start: str = "2024-01-01 00:00:00", tps: float = 10.0, n_users: int = 1000, fraud_rate: float = 0.012, seed: int = 42, n_merchants: int = 200) -> DataFrame:
    """n transactions spaced 1 / tps seconds apart: lognormal amounts about each user's mean, 85 % in the home city, 3 % from a
    new device, and four kinds of fraud. Rows depend on the seed and their number only."""
    return decorate(spark.range(n), F.col("id"), start, tps, n_users, fraud_rate, seed, n_merchants)


def _unit(seed: int, salt: str, *of: Column) -> Column:
    """A uniform number from a hash, the same on any partitioning."""
    return (F.pmod(F.xxhash64(F.lit(f"{seed}:{salt}"), *of), F.lit(1 << 30)) + F.lit(0.5)) / float(1 << 30)


def _normal(seed: int, salt: str, *of: Column) -> Column:
    return F.sqrt(-2 * F.log(_unit(seed, salt + "r", *of))) * F.cos(2 * 3.141592653589793 * _unit(seed, salt + "a", *of))


def decorate(rows: DataFrame, number: Column, start: str, tps: float, n_users: int, fraud_rate: float, seed: int, n_merchants: int) -> DataFrame:
    names, coordinates = list(CITIES), list(CITIES.values())
    unit = lambda salt, *of: _unit(seed, salt, *(of or (number,)))
    user = F.floor(unit("user") * n_users).cast("long")
    home = F.floor(unit("home", user) * 10).cast("int")
    usual = F.exp(7.0 + 1.2 * _normal(seed, "mean", user))
    fraud = unit("fraud") < fraud_rate
    kind = draw(unit("kind"), [0.3, 0.3, 0.2, 0.2])
    is_kind = lambda k: fraud & (kind == k)  # noqa: E731  0 velocity, 1 new device and amount, 2 place, 3 category
    city = F.when(is_kind(2) | (unit("away") >= 0.85), F.floor(unit("city") * 10).cast("int")).otherwise(home)
    new = is_kind(1) | (unit("new") < 0.03)
    code = F.when(is_kind(3), F.lit(len(CATEGORIES) - 1)).otherwise(draw(unit("mcc"), [w for _, _, w in CATEGORIES]))
    base = F.greatest(F.lit(1.0), usual * F.exp(0.6 * _normal(seed, "amount", number)))
    at = lambda values, place: F.element_at(F.array(*map(F.lit, values)), place + 1)
    octet = lambda k: F.floor(unit(f"ip{k}") * 256).cast("string")
    return rows.select(
        F.concat(F.lit("txn_"), F.sha2(F.concat_ws(":", F.lit(str(seed)), number.cast("string")), 256).substr(1, 32)).alias("transaction_id"),
        F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.floor(number * 1e6 / tps).cast("long")).alias("ts"),
        F.concat(F.lit("user"), user.cast("string"), F.lit("@"), F.lower(at(BANKS, F.floor(unit("bank", user) * 10).cast("int")))).alias("payer_vpa"),
        F.concat(F.lit("merchant"), F.floor(unit("merchant") * n_merchants).cast("string")).alias("payee_vpa"),
        F.round(F.when(is_kind(1), base * (5 + 10 * unit("more"))).otherwise(base), 2).alias("amount"), F.lit("INR").alias("currency"),
        F.when(new, F.concat(F.lit("dev_new_"), number.cast("string"))).otherwise(F.concat(F.lit("dev_"), user.cast("string"), F.lit("_"), F.floor(unit("device") * 2).cast("string"))).alias("device_id"),
        at(DEVICE_TYPES, F.floor(unit("type", user) * 3).cast("int")).alias("device_type"),
        F.concat_ws(".", (F.lit(103) + city).cast("string"), octet(1), octet(2), octet(3)).alias("ip_address"),
        at(names, city).alias("payer_city"), at([c[0] for c in coordinates], city).alias("payer_lat"), at([c[1] for c in coordinates], city).alias("payer_lon"),
        at([c for c, _, _ in CATEGORIES], code).alias("merchant_category_code"), at([c for _, c, _ in CATEGORIES], code).alias("merchant_category_name"),
        new.alias("is_new_device"), F.when(new, unit("age") * 24).otherwise(24 + unit("age") * 8736).alias("device_age_hours"),
        F.when(is_kind(0), F.lit(20) + F.floor(unit("burst") * 30)).otherwise(F.floor(unit("count") * 12)).cast("int").alias("user_txn_count_24h"),
        usual.alias("user_avg_amount_30d"), fraud.alias("is_fraud"),
        F.when(fraud, at(["velocity", "amount_anomaly", "geo_anomaly", "high_risk_merchant"], kind)).alias("fraud_type"),
    )


def stream(spark: SparkSession, tps: int = 10, **options) -> DataFrame:
    """The generator as an endless stream of tps rows a second."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", tps).load()
    defaults = {"start": "2024-01-01 00:00:00", "tps": float(tps), "n_users": 1000, "fraud_rate": 0.012, "seed": 42, "n_merchants": 200}
    return decorate(rate, F.col("value"), **(defaults | options)).drop("ts").withColumn("ts", F.current_timestamp())
