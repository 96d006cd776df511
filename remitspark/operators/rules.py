"""Quarantine rules over stored transactions: each is a function (transactions, parameters) -> hits.

Hits carry rule_type, customer_id, transaction_id (null for grouped rules) and evidence columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mismatched_discount(min_discount: float = 0.0) -> Column:
    return (F.col("discount") > min_discount) & (F.size(F.coalesce("promotions", F.array().cast("array<string>"))) == 0)


def discount_mismatch(txn: DataFrame, min_discount: float = 0.0) -> DataFrame:
    """Discounted although no promotion was active at billing."""
    return txn.where(mismatched_discount(min_discount))


def velocity_anomaly(txn: DataFrame, as_of, window_seconds: int = 300, max_transactions: int = 5, group_by: tuple[str, ...] = ("customer_id", "merchant_id")) -> DataFrame:
    """More than ``max_transactions`` of a group since ``as_of`` minus the window."""
    recent = txn.where(F.col("ts") >= as_of - F.expr(f"INTERVAL {window_seconds} SECONDS"))
    g = recent.groupBy(*group_by).agg(F.count("*").alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).alias("total"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return g.where(F.col("n") > max_transactions)


def amount_outlier(txn: DataFrame, multiplier: float = 3.0, lookback_days: int = 90, minimum_history: int = 10, as_of=None) -> DataFrame:
    """Farther from the customer's earlier mean than ``multiplier`` sample deviations (no deviation counts as 0)."""
    if as_of is not None:
        txn = txn.where(lookback(as_of, lookback_days))
    return with_history(txn).where(outlying(multiplier, minimum_history))


def with_history(txn: DataFrame, since: Column | None = None, name: str = "") -> DataFrame:
    """Count, mean and sample deviation of the customer's amounts before each row; with ``since`` only of rows that it holds for."""
    before = W.partitionBy("customer_id").orderBy("ts", "transaction_id").rowsBetween(W.unboundedPreceding, -1)
    x = F.col("amount").cast("double") if since is None else F.when(since, F.col("amount").cast("double"))
    return txn.withColumns({f"n_before{name}": F.count(x).over(before), f"mean_before{name}": F.avg(x).over(before), f"std_before{name}": F.coalesce(F.stddev_samp(x).over(before), F.lit(0.0))})


def outlying(multiplier: float = 3.0, minimum_history: int = 10, name: str = "") -> Column:
    return (F.col(f"n_before{name}") >= minimum_history) & (F.abs(F.col("amount").cast("double") - F.col(f"mean_before{name}")) > multiplier * F.col(f"std_before{name}"))


def lookback(as_of, lookback_days: int = 90) -> Column:
    return F.col("ts") >= as_of - F.expr(f"INTERVAL {lookback_days} DAYS")


def missing_entitlements() -> Column:
    return F.array_except("purchased", F.coalesce("entitled", F.array().cast("array<bigint>")))


def entitlement_mismatch(txn: DataFrame) -> DataFrame:
    """Purchased references that are not all entitled; needs arrays ``purchased`` and ``entitled``."""
    return txn.withColumn("missing", missing_entitlements()).where(F.size("missing") > 0)


def geographic_anomaly(txn: DataFrame) -> DataFrame:
    """Transaction state present and not the home state (an unknown home counts as different)."""
    return txn.where(away())


def away() -> Column:
    return F.col("txn_state").isNotNull() & ~F.col("txn_state").eqNullSafe(F.col("home_state"))


def duplicate_transaction(txn: DataFrame, window_seconds: int = 60, fields: tuple[str, ...] = ("customer_id", "merchant_id", "amount")) -> DataFrame:
    """Several rows of equal fields whose whole span is within the window."""
    g = txn.groupBy(*fields).agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return g.where((F.col("n") > 1) & (F.unix_timestamp("last_at") - F.unix_timestamp("first_at") <= window_seconds))


def termination_fee_check(txn: DataFrame, min_amount: float = 50.0, delta_tolerance: float = 0.0) -> DataFrame:
    """A termination fee inside the lock-in, or billed off the expected fee by more than the tolerance."""
    return txn.where(doubtful_fee(min_amount, delta_tolerance))


def doubtful_fee(min_amount: float = 50.0, delta_tolerance: float = 0.0) -> Column:
    fee = (F.col("txn_type") == "termination_fee") & (F.col("amount") >= min_amount)
    off = F.abs(F.coalesce(F.col("billed_delta"), F.lit(0))) > delta_tolerance
    return fee & (F.coalesce("lock_in", F.lit(False)) | off)


def unearned_earned_segregation(txn: DataFrame, types: tuple[str, ...] = ("subscription_charge", "addon_charge", "addon_purchase"), tolerance: float = 0.5) -> DataFrame:
    """The split is missing, or its parts do not sum to the line."""
    return txn.where(split_off(types, tolerance))


def split_off(types: tuple[str, ...] = ("subscription_charge", "addon_charge", "addon_purchase"), tolerance: float = 0.5) -> Column:
    off = F.abs(F.col("earned") + F.col("unearned") - F.col("gross")) > tolerance
    return F.col("txn_type").isin(*types) & (F.col("earned").isNull() | F.col("unearned").isNull() | off)


def double_charge_multi_code(items: DataFrame, codes: tuple[str, ...], match: tuple[str, ...] = ("customer_id", "product_ref"), window_seconds: int = 600) -> DataFrame:
    """Two lines or more under two codes or more for the same thing, close in time."""
    g = items.where(F.col("charge_code").isin(*codes)).groupBy(*match).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("charge_code")).alias("codes"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return g.where((F.col("n") >= 2) & (F.size("codes") >= 2) & (F.unix_timestamp("last_at") - F.unix_timestamp("first_at") <= window_seconds))


def proration_check(txn: DataFrame, tolerance_pct: float = 0.05) -> DataFrame:
    """A change in mid-cycle whose proration is missing or off by more than the tolerance."""
    return txn.where(proration_off(tolerance_pct))


def proration_off(tolerance_pct: float = 0.05) -> Column:
    off = F.abs(F.col("proration") - F.col("expected_proration")) > tolerance_pct * F.col("expected_proration")
    return F.col("mid_cycle") & (F.col("proration").isNull() | F.col("expected_proration").isNull() | off)


#: All rule types by name, each a function of transactions (``double_charge_multi_code``: of lines) and parameters.
RULES: dict[str, Callable[..., DataFrame]] = {
    "discount_mismatch": discount_mismatch, "velocity_anomaly": velocity_anomaly, "amount_outlier": amount_outlier, "entitlement_mismatch": entitlement_mismatch,
    "geographic_anomaly": geographic_anomaly, "duplicate_transaction": duplicate_transaction, "termination_fee_check": termination_fee_check,
    "unearned_earned_segregation": unearned_earned_segregation, "double_charge_multi_code": double_charge_multi_code, "proration_check": proration_check,
}
#: Those that judge a row by itself or by what ``with_history`` adds to it, as conditions.
BY_ROW: dict[str, Callable[..., Column]] = {
    "discount_mismatch": mismatched_discount, "amount_outlier": outlying, "entitlement_mismatch": lambda: F.size(missing_entitlements()) > 0, "geographic_anomaly": away,
    "termination_fee_check": doubtful_fee, "unearned_earned_segregation": split_off, "proration_check": proration_off,
}


@dataclass(frozen=True)
class Rule:
    kind: str
    params: dict = field(default_factory=dict)
    mode: str = "active"
    enabled: bool = True


def run_rules(txn: DataFrame, rules: list[Rule], lines: DataFrame | None = None, lean: DataFrame | None = None) -> DataFrame:
    """Hits (rule_type, mode, transaction_id, customer_id) of the enabled rules; shadow rules are told by their mode, an
    unknown type is an error. All rules that judge rows are one pass over the transactions; grouped rules follow, each an
    aggregation, and give a row a group, without a transaction. ``lines``: what double charges are looked for in."""
    for r in rules:
        if r.kind not in RULES:
            raise KeyError(f"unknown rule type {r.kind}")
    on = [r for r in rules if r.enabled]
    rows, out = [r for r in on if r.kind in BY_ROW], []
    none = lambda kind: F.lit(None).cast(kind)
    if rows:
        t, fires = txn, []
        for k, r in enumerate(rows):
            params = {n: x for n, x in r.params.items() if n not in ("lookback_days", "as_of")}
            if r.kind == "amount_outlier":
                since = lookback(r.params["as_of"], r.params.get("lookback_days", 90)) if r.params.get("as_of") is not None else None
                t = with_history(t, since, f"_{k}")
                hit = outlying(**params, name=f"_{k}")
                fires.append(hit if since is None else hit & since)
            else:
                fires.append(BY_ROW[r.kind](**params))
        name = lambda r: F.struct(F.lit(r.kind).alias("rule_type"), F.lit(r.mode).alias("mode"))
        fired = F.filter(F.array(*[F.when(hit, name(r)) for hit, r in zip(fires, rows)]), lambda x: x.isNotNull())
        out.append(t.select("transaction_id", "customer_id", F.explode(fired).alias("r")).select("r.rule_type", "r.mode", "transaction_id", "customer_id"))
    for r in on:
        if r.kind not in BY_ROW:
            hits = RULES[r.kind](lines if r.kind == "double_charge_multi_code" and lines is not None else txn if lean is None else lean, **r.params)
            who = F.col("customer_id") if "customer_id" in hits.columns else none("bigint")
            out.append(hits.select(F.lit(r.kind).alias("rule_type"), F.lit(r.mode).alias("mode"), none("bigint").alias("transaction_id"), who.alias("customer_id")))
    if not out:
        return txn.select(F.lit("").alias("rule_type"), F.lit("").alias("mode"), "transaction_id", "customer_id").where("false")
    return reduce(DataFrame.unionByName, out)


def backtest(latest: DataFrame, rule: Rule, sample_size: int, shown: int = 50) -> DataFrame:
    """One row: hits of a row rule on the given latest transactions, their share of the sample asked for, and the first
    hits, newest first."""
    hits = RULES[rule.kind](latest, **rule.params)
    first = hits.orderBy(F.desc("ts"), "transaction_id").limit(shown).agg(F.array_sort(F.collect_list(F.struct((-F.unix_timestamp("ts")).alias("t"), "transaction_id"))).alias("x"))  # at most ``shown`` rows
    g = hits.agg(F.count("*").alias("hit_count"))
    shown_ids = F.transform("x", lambda e: e["transaction_id"])
    return g.crossJoin(F.broadcast(first)).select(F.lit(rule.kind).alias("rule_type"), F.lit(sample_size).alias("sample_size"), "hit_count", (F.col("hit_count") / F.lit(float(sample_size))).alias("hit_rate"), shown_ids.alias("hits"))
