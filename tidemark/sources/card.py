"""Card transactions from two CSV files, in the engine's normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import flag_number, number_default

#: The columns that are read, where the files have them.
COUNTS, DELTAS, MATCHES, EXTRA = [f"C{k}" for k in range(1, 15)], [f"D{k}" for k in range(1, 5)], [f"M{k}" for k in range(1, 10)], ["V1", "V2", "V3"]
TRANSACTION_COLUMNS = ["TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD", *(f"card{k}" for k in range(1, 7)), "addr1", "addr2", "dist1", "dist2", "P_emaildomain", "R_emaildomain", *COUNTS, *DELTAS, *MATCHES, *EXTRA]
IDENTITY_COLUMNS = ["TransactionID", "DeviceType", "DeviceInfo", *(f"id_{k}" for k in (12, 13, 14, 15, 16, 17, 18, 19, 20, 28, 29, 30, 31, 32, 33))]
TEXT = {"ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain", "DeviceType", "DeviceInfo", *MATCHES}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, asked of Spark's own file system layer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """The wanted columns that the header has, all as text: types are set by name, so no pass infers them."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return raw.select(*(c for c in wanted if c in raw.columns))


def load(spark: SparkSession, transactions: str, identity: str | None = None) -> DataFrame:
    """Transactions left-joined with identities by TransactionID; the identity file may be absent."""
    if not exists(spark, transactions):
        raise FileNotFoundError(transactions)
    df = read_csv(spark, transactions, TRANSACTION_COLUMNS)
    if identity and exists(spark, identity):
        df = df.join(read_csv(spark, identity, IDENTITY_COLUMNS), "TransactionID", "left")
    return df


def normalize(df: DataFrame) -> DataFrame:
    """19 fields; missing numbers, texts and flags take each field's default."""
    has = set(df.columns)
    text = lambda c, missing="": F.coalesce(F.lower(F.col(c).cast("string")), F.lit(missing)) if c in has else F.lit(missing)
    num = lambda c, missing=0.0: number_default(F.col(c).try_cast("double"), missing) if c in has else F.lit(missing)
    maybe = lambda c, kind: F.col(c).try_cast(kind) if c in has else F.lit(None).cast(kind)
    packed = lambda names, f: F.create_map(*(x for c in names for x in (F.lit(c), f(c))))
    return df.select(
        F.concat(F.lit("ieee_"), F.col("TransactionID").cast("string")).alias("transaction_id"), num("TransactionDT").cast("bigint").alias("timestamp_delta"), num("TransactionAmt").alias("amount"),
        (F.coalesce(F.col("ProductCD").cast("string"), F.lit("")) if "ProductCD" in has else F.lit("")).alias("product_code"), text("card4", "unknown").alias("card_type"), text("card6", "unknown").alias("card_category"),
        text("P_emaildomain").alias("email_domain_payer"), text("R_emaildomain").alias("email_domain_payee"), maybe("DeviceType", "string").alias("device_type"), maybe("DeviceInfo", "string").alias("device_info"),
        maybe("addr1", "double").alias("addr_billing"), maybe("addr2", "double").alias("addr_zip"), maybe("dist1", "double").alias("dist_from_home"),
        packed(COUNTS, lambda c: num(c, 0.0)).alias("count_features"), packed(DELTAS, lambda c: num(c, -1.0)).alias("timedelta_features"),
        packed(MATCHES, lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) if c in has else F.lit("unknown")).alias("match_features"),
        F.array(*(num(c, 0.0) for c in EXTRA)).alias("vesta_features"), (num("isFraud") == 1).alias("is_fraud"), F.lit("ieee_cis").alias("source"),
    )


def vector(df: DataFrame) -> Column:
    """33 numbers of a normal row: amount, time and distance, then the four packed groups."""
    first = [F.col("amount"), F.col("timestamp_delta").cast("double"), F.coalesce("dist_from_home", F.lit(0.0))]
    flags = [flag_number(F.element_at("match_features", F.lit(c))) for c in MATCHES]
    return F.concat(F.array(*first, *(F.element_at("count_features", F.lit(c)) for c in COUNTS), *(F.element_at("timedelta_features", F.lit(c)) for c in DELTAS), *flags), F.col("vesta_features"))


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def batches(rows: DataFrame, size: int = 1000):
    """Lists of at most so many rows, a partition at a time on the driver."""
    part = []
    for r in rows.toLocalIterator():
        part.append(r)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
