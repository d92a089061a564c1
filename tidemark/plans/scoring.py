"""The whole decision: features, rules, model score where rules leave it open, decision, response."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.features import features, vector
from ..operators.rules import RuleEngine
from ..schema import FEATURES

MODES = ("live", "shadow", "degraded", "fail_open", "fail_closed")


def threshold(score: Column) -> Column:
    return F.when(score >= 0.90, "BLOCK").when(score >= 0.70, "REVIEW").otherwise("PASS")


def enforced(decision: Column, mode: str) -> Column:
    """In shadow mode nothing is enforced."""
    return F.lit("PASS") if mode == "shadow" else decision


def fallback(mode: str) -> tuple[Column, Column]:
    """Score and decision when scoring fails altogether."""
    return (F.lit(1.0), F.lit("BLOCK")) if mode == "fail_closed" else (F.lit(0.0), F.lit("PASS"))


def fuse(ml: Column, rule: Column) -> Column:
    return 0.4 * ml + 0.6 * rule


def decide(txns: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None, engine: RuleEngine | None = None, mode: str = "live", model_version: str = "none", vectors: bool = True) -> DataFrame:
    """Scores transactions. model adds ml_score to rows with `vector`; rows that rules block don't reach it.

    Without a model, in degraded mode and where the model gives nothing, the rule score stands in for the model's; in degraded
    mode it is the score. Where the model gives nothing in fail_closed mode the row is blocked with score 1. The decision that
    would hold is kept beside the enforced one, so that shadow mode loses nothing. Without vectors, where no model asks for them, only event_id and the columns
    that rules read come with the decisions, so features that none of them reads needn't be taken."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    engine = engine or RuleEngine()
    return decide_featured(features(txns, None if vectors else engine.reads()), model, engine, mode, model_version, vectors)


def decide_featured(featured: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None, engine: RuleEngine | None = None, mode: str = "live", model_version: str = "none", vectors: bool = True) -> DataFrame:
    """The same for transactions that have their features already."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    if mode == "degraded":
        model = None
    if model is not None and not vectors:
        raise ValueError("a model needs vectors")
    ruled = (engine or RuleEngine()).evaluate(featured)
    ruled = ruled.withColumn("vector", vector(FEATURES)) if vectors else ruled
    # the model gets no vector for blocked rows and gives null for them: one pass, and no model time
    open_vector = F.when(~F.col("blocked"), F.col("vector"))
    unscored = F.lit(None).cast("double")
    scored = ruled.withColumn("ml_score", unscored) if model is None else model(ruled.withColumns({"_all": F.col("vector"), "vector": open_vector})).withColumn("vector", F.col("_all")).drop("_all")
    failed = F.col("ml_score").isNull() & ~F.col("blocked") if model is not None and mode == "fail_closed" else F.lit(False)
    stop_score, stop_decision = fallback("fail_closed")
    scored = scored.withColumns({"_failed": failed, "ml_score": F.when(F.col("blocked"), F.col("ml_score")).otherwise(F.coalesce("ml_score", "rule_score"))})
    open_score = F.col("rule_score") if model is None else F.least(F.lit(1.0), fuse(F.col("ml_score"), F.col("rule_score")))
    score = F.when(F.col("blocked"), 1.0).when(F.col("_failed"), stop_score).otherwise(open_score)
    decision = F.when(F.col("blocked"), "BLOCK").when(F.col("_failed"), stop_decision).otherwise(threshold(score))
    scored = scored.withColumns({"score": F.round(score, 4), "would_decide": decision}).drop("_failed")
    return scored.withColumns({"decision": enforced(F.col("would_decide"), mode), "shadow_mode": F.lit(mode == "shadow"), "model_version": F.lit(model_version)})


def response(scored: DataFrame) -> DataFrame:
    return scored.select("transaction_id", F.col("score").alias("risk_score"), F.round("rule_score", 4).alias("rule_score"), F.round("ml_score", 4).alias("ml_score"), "decision", "shadow_mode", "model_version")


def health(mode: str, model_loaded: bool) -> str:
    return "degraded" if mode == "degraded" or not model_loaded else "ok"


def health_response(spark, mode: str, model_loaded: bool, uptime_s: float) -> DataFrame:
    return spark.createDataFrame([(health(mode, model_loaded), mode, model_loaded, round(uptime_s, 1))], "status string, mode string, model_loaded boolean, uptime_s double")


def audit_response(log: DataFrame, transaction_id: str) -> DataFrame:
    """One row: whether there are entries of the transaction, and the entries."""
    entries = log.filter(F.col("transaction_id") == transaction_id)
    return entries.agg((F.count("*") > 0).alias("found"), F.collect_list(F.struct("*")).alias("entries"))


def normalise_decision(decision: Column) -> Column:
    return F.upper(decision)
