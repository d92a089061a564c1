"""The rule engine: rules are column factories, evaluated in order, and results stop after the first block."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "struct<rule_name: string, decision: string, reason: string, score: double>"
#: Codes of high risk, with their labels.
HIGH_RISK = {"6051": "Crypto/Non-Fiat currency", "7995": "Gambling", "5933": "Pawn shops", "6211": "Security brokers"}


@dataclass(frozen=True)
class Limits:
    """The thresholds of the seven rules."""

    count_1m: int = 5
    count_5m: int = 12
    count_1h: int = 40
    least_mean: float = 10.0
    z_block: float = 8.0
    z_review: float = 5.0
    old_device_hours: float = 24.0
    young_device_hours: float = 2.0
    amount_factor: float = 5.0
    cities_block: int = 3
    device_total: int = 500
    night: tuple[int, int] = (2, 5)
    night_amount: float = 10_000.0


def result(name: str, decision: str, reason: Column, score: float) -> Column:
    return F.struct(F.lit(name).alias("rule_name"), F.lit(decision).alias("decision"), reason.alias("reason"), F.lit(score).alias("score"))


def number(name: str, missing: float = 0) -> Column:
    return F.coalesce(F.col(name), F.lit(missing))


def transaction_velocity(limits: Limits) -> Column:
    steps = (("1m", "1 minute", limits.count_1m, "block", 0.70), ("5m", "5 minutes", limits.count_5m, "block", 0.65), ("1h", "1 hour", limits.count_1h, "review", 0.25))
    out = None
    for name, words, least, decision, score in steps:
        n = number(f"user_txn_count_{name}")
        value = result(f"txn_velocity_{name}", decision, F.format_string(f"%d transactions within {words}", n), score)
        out = F.when(n >= least, value) if out is None else out.when(n >= least, value)
    return out


def amount_velocity(limits: Limits) -> Column:
    z, mean = number("amount_zscore_1h"), number("user_amount_mean_1h")
    reason = F.format_string("amount lies %.1fσ above the user's mean of the last hour (₹%.0f)", z.cast("double"), mean.cast("double"))
    return F.when(mean < limits.least_mean, F.lit(None).cast(RESULT)).when(z > limits.z_block, result("amount_velocity", "block", reason, 0.60)).when(z > limits.z_review, result("amount_velocity", "review", reason, 0.30))


def new_device_high_amount(limits: Limits) -> Column:
    new, age = F.coalesce(F.col("is_new_device"), F.lit(False)), number("device_age_hours", 9999.0)
    amount, mean = number("amount", 0.0), number("user_amount_mean_1h", 0.0)
    high = F.format_string("device is new (%.1f h) and ₹%.0f is %.1f× the user's mean", age, amount, amount / mean)
    young = F.format_string("device is new or young (%.1f h)", age)
    return (
        F.when(~new & (age > limits.old_device_hours), F.lit(None).cast(RESULT))
        .when((mean > 0) & (amount > mean * limits.amount_factor), result("new_device_high_amount", "block", high, 0.55))
        .when(new | (age < limits.young_device_hours), result("new_device", "review", young, 0.20))
    )


def geo_velocity(limits: Limits) -> Column:
    n = number("user_unique_cities_1h")
    reason = F.format_string("transactions in %d cities within 1 hour", n)
    return F.when(n >= limits.cities_block, result("geo_velocity", "block", reason, 0.65)).when(n == 2, result("geo_velocity", "review", reason, 0.20))


def device_sharing(limits: Limits) -> Column:
    n = number("device_global_freq")
    return F.when(n > limits.device_total, result("device_farm", "block", F.format_string("device has %d transactions in all", n), 0.60))


def high_risk_mcc(limits: Limits) -> Column:
    code = F.coalesce(F.col("merchant_category_code"), F.lit(""))
    label = F.element_at(F.create_map(*(F.lit(x) for pair in HIGH_RISK.items() for x in pair)), code)
    return F.when(code.isin(*HIGH_RISK), result("high_risk_mcc", "review", F.concat_ws(": ", F.concat(F.lit("category of high risk "), code), label), 0.15))


def off_hours_high_amount(limits: Limits) -> Column:
    hour, amount = F.hour("ts"), number("amount", 0.0)
    reason = F.format_string("₹%.0f at %02d:00", amount, hour)
    return F.when(hour.between(*limits.night) & (amount > limits.night_amount), result("off_hours_high_amount", "review", reason, 0.20))


RuleFactory = Callable[[Limits], Column]
#: The rules in their order.
RULES: tuple[tuple[str, RuleFactory], ...] = (
    ("transaction_velocity", transaction_velocity), ("amount_velocity", amount_velocity), ("new_device_high_amount", new_device_high_amount), ("geo_velocity", geo_velocity),
    ("device_sharing", device_sharing), ("high_risk_mcc", high_risk_mcc), ("off_hours_high_amount", off_hours_high_amount),
)

#: The columns that each of them reads.
READS: dict[RuleFactory, tuple[str, ...]] = {
    transaction_velocity: ("user_txn_count_1m", "user_txn_count_5m", "user_txn_count_1h"), amount_velocity: ("amount_zscore_1h", "user_amount_mean_1h"),
    new_device_high_amount: ("is_new_device", "device_age_hours", "amount", "user_amount_mean_1h"), geo_velocity: ("user_unique_cities_1h",),
    device_sharing: ("device_global_freq",), high_risk_mcc: ("merchant_category_code",), off_hours_high_amount: ("ts", "amount"),
}


@dataclass
class RuleEngine:
    """Rules can be added and removed; each engine has a list of its own."""

    limits: Limits = field(default_factory=Limits)
    rules: list[tuple[str, RuleFactory]] = field(default_factory=lambda: list(RULES))

    def add_rule(self, name: str, factory: RuleFactory) -> None:
        self.rules.append((name, factory))

    def remove_rule(self, name: str) -> None:
        self.rules = [r for r in self.rules if r[0] != name]

    def reads(self) -> set[str] | None:
        """The columns that the rules read; None if there are rules of another making, which may read any."""
        return {c for _, f in self.rules for c in READS[f]} if all(f in READS for _, f in self.rules) else None

    def evaluate(self, df: DataFrame) -> DataFrame:
        """Adds rule_results, rule_score, rule_decision, passed_to_ml, blocked and needs_review."""
        if not self.rules:
            fired = F.array().cast(f"array<{RESULT}>")
        else:
            fired = F.filter(F.array(*(f(self.limits).cast(RESULT) for _, f in self.rules)), lambda r: r.isNotNull())
        df = df.withColumn("_fired", fired)
        first_block = F.array_position(F.transform("_fired", lambda r: r["decision"]), "block").cast("int")
        df = df.withColumn("rule_results", F.when(first_block > 0, F.slice("_fired", F.lit(1), first_block)).otherwise(F.col("_fired"))).drop("_fired")
        score = F.least(F.lit(1.0), F.aggregate("rule_results", F.lit(0.0), lambda a, r: a + r["score"]))
        decisions = F.transform("rule_results", lambda r: r["decision"])
        final = F.when(F.array_contains(decisions, "block"), "BLOCK").when(F.array_contains(decisions, "review"), "REVIEW").otherwise("PASS")
        df = df.withColumns({"rule_score": score, "rule_decision": final})
        passed = (F.col("rule_decision") != "BLOCK") & ((F.col("rule_decision") == "REVIEW") | (F.col("rule_score") > 0.1))
        return df.withColumns({"passed_to_ml": passed, "blocked": F.col("rule_decision") == "BLOCK", "needs_review": F.col("rule_decision") == "REVIEW"})
