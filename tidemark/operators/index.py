"""Secondary indexes as tables: time order, posting lists, and what an index manager reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_query(index: DataFrame, low, high, at: str = "us", order: list[str] | None = None) -> DataFrame:
    """Rows with low <= at <= high, in order of time and insertion."""
    return index.filter(F.col(at).between(low, high)).orderBy(at, *(order or []))


def point_query(index: DataFrame, value, at: str = "us") -> DataFrame:
    return index.filter(F.col(at) == value)


def delete_entries(index: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Takes out one entry for each (time, id) asked for, the first inserted."""
    first = Window.partitionBy(*keys).orderBy("seq")
    marked = index.withColumn("_place", F.row_number().over(first))
    asked = gone.groupBy(*keys).agg(F.count("*").alias("_n"))
    return marked.join(asked, keys, "left").filter(F.col("_place") > F.coalesce("_n", F.lit(0))).drop("_place", "_n")


def retained(n: Column, cap: int) -> Column:
    """How many postings are left of n inserts when, at each insert past the cap, the older half goes."""
    half = cap // 2
    if half == 0:
        return n
    return F.when(n <= cap, n).otherwise((cap + 1 - half) + (n - cap - 1) % half)


def postings(rows: DataFrame, entity: str, item: str, order: list[str], cap: int = 10_000) -> DataFrame:
    """entity, items (in insertion order, the retained ones), n_inserted. Each list has at most cap members: rows beyond are
    dropped by their place before lists are gathered."""
    w = Window.partitionBy(entity)
    last_first = w.orderBy(*(F.col(c).desc() for c in order))
    known = rows.filter(F.coalesce(F.col(entity), F.lit("")) != "")
    counts = known.groupBy(entity).agg(F.count("*").alias("n_inserted"))
    placed = known.select(entity, item, *order, F.row_number().over(last_first).alias("_back")).filter(F.col("_back") <= max(cap, 1) if cap > 1 else F.lit(True))
    kept = placed.join(counts, entity).filter(F.col("_back") <= retained(F.col("n_inserted"), cap))
    lists = kept.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("k"), F.col(item).alias("v")))).alias("_l"), F.first("n_inserted").alias("n_inserted"))
    return lists.select(entity, F.transform("_l", lambda x: x["v"]).alias("items"), "n_inserted")


def postings_of(lists: DataFrame, entity: str, value: str) -> DataFrame:
    """One row: the entity's items, empty if it has none."""
    return lists.filter(F.col(entity) == value).agg(F.coalesce(F.first("items"), F.array().cast("array<string>")).alias("items"))


def recent_of(items: Column, n: int) -> Column:
    """The last n items; 0 gives all."""
    return items if n == 0 else F.slice(items, F.greatest(F.lit(1), F.size(items) - n + 1), F.lit(n))


def remove_entity(lists: DataFrame, entity: str, value: str) -> DataFrame:
    return lists.filter(F.col(entity) != value)


def serialize(lists: DataFrame, entity: str) -> DataFrame:
    """One JSON text for each posting list."""
    return lists.select(F.to_json(F.struct(F.col(entity).alias("entity"), "items")).alias("json"))


def deserialize(texts: DataFrame, entity: str, cap: int = 10_000) -> DataFrame:
    read = texts.select(F.from_json("json", "struct<entity: string, items: array<string>>").alias("r"))
    return read.select(F.col("r.entity").alias(entity), F.slice("r.items", F.greatest(F.lit(1), F.size("r.items") - cap + 1), F.lit(cap)).alias("items"))


def index_stats(txns: DataFrame) -> DataFrame:
    """Size and ends of the time index, and how many entities each posting index has."""
    named = lambda c: F.count_distinct(F.nullif(F.col(c), F.lit("")))
    return txns.agg(F.count("*").alias("size"), F.min("us").alias("min_key"), F.max("us").alias("max_key"), named("payer_vpa").alias("users"), named("device_id").alias("devices"), named("payee_vpa").alias("merchants"))
