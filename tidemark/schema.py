"""Record schemas and the names they are known by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTION = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("payer_vpa", T.StringType()), T.StructField("payee_vpa", T.StringType()),
        T.StructField("amount", T.DoubleType()), T.StructField("currency", T.StringType()), T.StructField("device_id", T.StringType()), T.StructField("device_type", T.StringType()),
        T.StructField("ip_address", T.StringType()), T.StructField("payer_city", T.StringType()), T.StructField("payer_lat", T.DoubleType()), T.StructField("payer_lon", T.DoubleType()),
        T.StructField("merchant_category_code", T.StringType()), T.StructField("merchant_category_name", T.StringType()), T.StructField("is_new_device", T.BooleanType()), T.StructField("device_age_hours", T.DoubleType()),
        T.StructField("user_txn_count_24h", T.IntegerType()), T.StructField("user_avg_amount_30d", T.DoubleType()), T.StructField("is_fraud", T.BooleanType()), T.StructField("fraud_type", T.StringType()),
    ]
)

AUDIT = T.StructType(
    [
        T.StructField("entry_id", T.StringType()), T.StructField("transaction_id", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("model_version", T.StringType()),
        T.StructField("feature_hash", T.StringType()), T.StructField("rule_score", T.DoubleType()), T.StructField("ml_score", T.DoubleType()), T.StructField("ensemble_score", T.DoubleType()),
        T.StructField("decision", T.StringType()), T.StructField("top_shap_features", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())]))),
        T.StructField("latency_ms", T.DoubleType()), T.StructField("shadow_mode", T.BooleanType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

#: Other names under which fields arrive.
ALIASES = {"user_id": "payer_vpa", "merchant_id": "payee_vpa", "mcc": "merchant_category_code", "city": "payer_city"}

#: The feature vector's order.
WINDOW_FEATURES = [
    "user_txn_count_1m", "user_txn_count_5m", "user_txn_count_1h", "user_txn_count_24h", "user_amount_mean_1h", "user_amount_std_1h", "user_amount_max_24h", "amount_zscore_1h",
    "user_unique_cities_1h", "user_unique_devices_24h", "device_txn_count_1h", "device_txn_count_24h", "merchant_txn_count_1h", "merchant_amount_mean_1h",
    "user_global_freq", "device_global_freq", "merchant_global_freq",
]
TRANSACTION_FEATURES = ["amount", "is_new_device", "device_age_hours", "hour_of_day", "day_of_week", "is_weekend"]
FEATURES = WINDOW_FEATURES + TRANSACTION_FEATURES


def canonical_names(df: DataFrame) -> DataFrame:
    """Renames aliased fields; a canonical name that is there already wins."""
    return df.select(*(F.col(c).alias(ALIASES[c]) if c in ALIASES and ALIASES[c] not in df.columns else F.col(c) for c in df.columns if c not in ALIASES or ALIASES[c] not in df.columns))


def valid_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with an amount above 0 and all required ids, and the others."""
    ok = F.coalesce(F.col("amount") > 0, F.lit(False)) & F.col("transaction_id").isNotNull() & F.col("payer_vpa").isNotNull() & F.col("payee_vpa").isNotNull()
    return df.filter(ok), df.filter(~ok)
