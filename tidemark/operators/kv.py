"""Key-value tables: the newest entry of a key wins, and a deletion hides older ones. Deletions are a flag of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import LEAST, running


def compact(entries: DataFrame, key: str = "key", seq: str = "seq", value: str = "value", deleted: str = "deleted") -> DataFrame:
    """key, seq, value for live keys. A partial aggregation keeps one entry for each key and task."""
    newest = F.max_by(F.struct(F.col(value), F.col(deleted), F.col(seq)), F.col(seq)).alias("_e")
    return entries.groupBy(key).agg(newest).filter(~F.coalesce(F.col(f"_e.{deleted}"), F.lit(False))).select(key, F.col(f"_e.{seq}").alias(seq), F.col(f"_e.{value}").alias(value))


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Entries of several runs, the newest of each key, deletions kept: a merge that isn't the last."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.groupBy("key").agg(F.max_by(F.struct("seq", "value", "deleted"), "seq").alias("e")).select("key", "e.seq", "e.value", "e.deleted")


def get(entries: DataFrame, key: str) -> DataFrame:
    """The live entry of one key; the filter reaches the scan."""
    return compact(entries.filter(F.col("key") == key))


def scan(entries: DataFrame) -> DataFrame:
    """Live entries in key order."""
    return compact(entries).orderBy("key")


def write_run(entries: DataFrame, path: str, level: int = 0) -> None:
    """A sorted run: sorted within files, so that row-group statistics serve as a sparse index."""
    entries.withColumn("level", F.lit(level)).repartitionByRange("key").sortWithinPartitions("key", "seq").write.mode("append").partitionBy("level").parquet(path)


def read_runs(spark, path: str) -> DataFrame:
    """All runs; files that can't be read are skipped."""
    return spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "false").parquet(path)


def run_stats(entries: DataFrame) -> DataFrame:
    """Each file's entries and key range."""
    return entries.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("entries"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def ttl_lookup(store: DataFrame, probes: DataFrame, entity: str, ttl_us: int, least: int = LEAST) -> DataFrame:
    """For each probe (entity, now) the latest stored value at or before now, null where there is none or it is older than
    ttl. A stored null hides what was before: an invalidation. As-of by one ordering of both sides: no range join. Of values of
    one time the greatest counts."""
    extra = [c for c in probes.columns if c not in (entity, "now")]
    stored = store.select(entity, F.col("us").alias("at"), F.lit(0).alias("_probe"), F.xxhash64("us", "value").alias("_tie"), F.struct("us", "value").alias("_v"), *(F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra))
    asked = probes.select(entity, F.col("now").alias("at"), F.lit(1).alias("_probe"), F.xxhash64("now", *extra).alias("_tie"), F.lit(None).cast(stored.schema["_v"].dataType).alias("_v"), *extra)
    seen = running(stored.unionByName(asked), [entity], ["at", "_probe", "_tie"], tops={"_last": F.col("_v")}, least=least).filter("_probe = 1")
    fresh = F.col("at") - F.col("_last.us") <= ttl_us
    return seen.select(entity, F.col("at").alias("now"), *extra, F.when(fresh, F.col("_last.value")).alias("value"))


def put(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The store with more rows (entity, us, value); the newest up to a probe's time counts."""
    return store.unionByName(rows)


def invalidate(store: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """The store with a null value for each of entities(entity, us): nothing is found until a newer one is put."""
    return store.unionByName(entities.select(entity, "us").withColumn("value", F.lit(None).cast(store.schema["value"].dataType)))
