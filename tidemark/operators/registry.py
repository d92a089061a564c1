"""Model registry and audit log."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import feature_hash
from ..schema import AUDIT


class ModelRegistry:
    """A small manifest on the driver, replaced in one step."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.records: list[dict] = json.loads(self.path.read_text()) if self.path.exists() else []

    def _save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        handle, name = tempfile.mkstemp(dir=self.path.parent)
        with os.fdopen(handle, "w") as f:
            json.dump(self.records, f)
        os.replace(name, self.path)

    def register(self, model_type: str, artifact_path: str, dataset: str, hyperparams: dict | None = None, metrics: dict | None = None, notes: str = "", now: datetime | None = None) -> str:
        now = now or datetime.now(UTC)
        base = f"{model_type}-{now:%Y%m%d}-{file_hash(artifact_path)[:4]}"
        taken = {r["version"] for r in self.records}
        version, k = base, 1
        while version in taken:
            version, k = f"{base}-{k}", k + 1
        self.records.append({"version": version, "model_type": model_type, "artifact_path": artifact_path, "registered_at": now.isoformat(), "training_dataset": dataset, "hyperparams": hyperparams or {}, "train_metrics": metrics or {}, "is_active": False, "notes": notes})
        self._save()
        return version

    def activate(self, version: str) -> bool:
        record = self.get(version)
        if record is None:
            return False
        for r in self.records:
            if r["model_type"] == record["model_type"]:
                r["is_active"] = r["version"] == version
        self._save()
        return True

    def update_metrics(self, version: str, metrics: dict) -> bool:
        record = self.get(version)
        if record is None:
            return False
        record["train_metrics"].update(metrics)
        self._save()
        return True

    def get(self, version: str) -> dict | None:
        return next((r for r in self.records if r["version"] == version), None)

    def get_active(self, model_type: str) -> dict | None:
        return next((r for r in self.records if r["model_type"] == model_type and r["is_active"]), None)

    def list_all(self) -> list[dict]:
        return list(self.records)

    def list_by_type(self, model_type: str) -> list[dict]:
        return [r for r in self.records if r["model_type"] == model_type]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [{k: json.dumps(v) if isinstance(v, dict) else v for k, v in r.items()} for r in self.records]
        return spark.createDataFrame(rows, "version string, model_type string, artifact_path string, registered_at string, training_dataset string, hyperparams string, train_metrics string, is_active boolean, notes string")


def file_hash(path: str) -> str:
    """SHA-256 of a file, 64 KiB at a time; zeros if it isn't there."""
    if not os.path.exists(path):
        return "0" * 64
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(65_536):
            digest.update(block)
    return digest.hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def audit_entries(scored: DataFrame, model_version: str, shadow: bool = False) -> DataFrame:
    """Rows of the audit schema from scored transactions: transaction_id, vector, rule_score, ml_score, score, decision, and the
    decision that would hold without shadow mode."""
    optional = lambda c, kind: F.col(c) if c in scored.columns else F.lit(None).cast(kind)
    return scored.select(
        F.uuid().alias("entry_id"), "transaction_id", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), F.lit(model_version).alias("model_version"),
        feature_hash(F.col("vector").cast("array<double>")).alias("feature_hash"), "rule_score", "ml_score", F.col("score").alias("ensemble_score"), "decision",
        optional("top_shap_features", AUDIT["top_shap_features"].dataType).alias("top_shap_features"), optional("latency_ms", "double").alias("latency_ms"), F.lit(shadow).alias("shadow_mode"),
        optional("metadata", "map<string,string>").alias("metadata"),
    )


def append_audit(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def load_audit(spark: SparkSession, path: str) -> DataFrame:
    """The log; lines that aren't records are skipped."""
    return spark.read.schema(AUDIT).option("mode", "DROPMALFORMED").json(path)


def audit_get(log: DataFrame, transaction_id: str) -> DataFrame:
    return log.filter(F.col("transaction_id") == transaction_id)


def audit_latest(log: DataFrame, seq: str = "timestamp") -> DataFrame:
    """The newest entry of each transaction."""
    rest = [c for c in log.columns if c != "transaction_id"]
    return log.groupBy("transaction_id").agg(F.max_by(F.struct(*rest), seq).alias("e")).select("transaction_id", "e.*")


def audit_stats(log: DataFrame) -> DataFrame:
    """decision, n, shadow; with the total as the row of no decision."""
    return log.rollup("decision").agg(F.count("*").alias("n"), F.count_if(F.col("shadow_mode")).alias("shadow")).select(F.coalesce("decision", F.lit("ALL")).alias("decision"), "n", "shadow")
