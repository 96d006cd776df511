"""Windowed stream features and rules; each works on a batch DataFrame as it does on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str, hop: str | None, keys: list[str]) -> DataFrame:
    """Counts and sums by window and keys: tumbling without a hop, else hopping."""
    w = F.window("ts", length, hop) if hop else F.window("ts", length)
    g = events.groupBy(w.alias("w"), *keys).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"), F.coalesce(F.sum("discount"), F.lit(0)).alias("discount"),
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
    )
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "amount", "discount", "first_at", "last_at")


def with_rate(w: DataFrame) -> DataFrame:
    return w.withColumn("discount_rate", F.try_divide(F.col("discount").cast("double"), F.col("amount").cast("double")))


def velocity_cases(events: DataFrame, most: int = 50, length: str = "5 minutes") -> DataFrame:
    """More than ``most`` events of a customer at a merchant in a fixed window: a case of medium severity, its evidence
    first and last event and time, count and total."""
    w = F.window("ts", length)
    g = events.groupBy(w.alias("w"), "customer_id", "merchant_id").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).alias("total"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.min("event_id").alias("least_id"), F.max("event_id").alias("largest_id"),
    ).where(F.col("n") > most)
    case_id = F.concat_ws("-", F.lit("case-velocity"), "customer_id", "merchant_id", F.unix_timestamp(F.col("w.end")))
    return g.select(case_id.alias("case_id"), "customer_id", "merchant_id", F.lit("medium").alias("severity"), F.lit("open").alias("status"), F.col("w.end").alias("created_at"), "n", "total", "first_at", "last_at", "least_id", "largest_id")


def duplicate_cases(events: DataFrame, most: int = 2, length: str = "60 seconds", keys: tuple[str, ...] = ("customer_id", "merchant_id", "amount")) -> DataFrame:
    """More than ``most`` equal charges in a fixed minute: a case of medium severity with its evidence."""
    w = F.window("ts", length)
    g = events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.min("event_id").alias("least_id"), F.max("event_id").alias("largest_id")).where(F.col("n") > most)
    case_id = F.concat_ws("-", F.lit("case-dup"), "customer_id", F.unix_timestamp(F.col("w.end")))
    return g.select(case_id.alias("case_id"), *keys, F.lit("medium").alias("severity"), F.lit("open").alias("status"), F.col("w.end").alias("created_at"), "n", "first_at", "last_at", "least_id", "largest_id")


#: Largest lag in seconds that counts.
LAG_MOST = 60


def rate_and_lag(events: DataFrame, arrived: Column, length: str = "60 seconds", hop: str = "10 seconds") -> DataFrame:
    """Events a second and median and 99th percentile of whole seconds of lag in a sliding minute. Lags are counted in a
    histogram of ``LAG_MOST`` + 1 bins, which adds up across tasks and batches, so no window's events are gathered."""
    t = lag_seconds(events, arrived)
    bins = [F.count_if(F.col("lag_s") == k).alias(f"b{k}") for k in range(LAG_MOST + 1)]
    g = t.groupBy(F.window("ts", length, hop).alias("w")).agg(F.count("*").alias("n"), *bins)
    counts = F.array(*[F.col(f"b{k}") for k in range(LAG_MOST + 1)])

    def at(p: float) -> Column:
        """The lag at 0-based place max(0, min(n - 1, floor(n p) - 1)) of the sorted lags."""
        place = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor(F.col("n") * p) - 1))
        below = F.aggregate("counts_", F.struct(F.lit(0).cast("long").alias("c"), F.lit(-1).alias("k")), lambda a, x: F.struct((a["c"] + x).alias("c"), F.when(a["c"] > place, a["k"]).otherwise(a["k"] + 1).alias("k")))
        return below["k"]

    g = g.withColumn("counts_", counts)
    return g.select(F.col("w.start").alias("window_start"), "n", (F.col("n") / F.lit(60.0)).alias("rate"), at(0.5).alias("p50"), at(0.99).alias("p99"))


#: Stateless rules over enriched events: name -> condition.
STATELESS = {
    "discount": lambda: F.exists("discounts", lambda d: d["promo_id"] == "PROMO_ANOMALY"),
    "entitlement": lambda: F.get(F.filter("content_ids", lambda c: c.isNotNull()), 0).isNotNull() & ~F.array_contains("entitlements", F.get(F.filter("content_ids", lambda c: c.isNotNull()), 0)),
    "geography": lambda: F.col("txn_state").isNotNull() & F.col("home_state").isNotNull() & (F.col("txn_state") != F.col("home_state")),
    "termination_fee": lambda: F.coalesce((F.col("expected_fee") > 0) & (F.abs(F.col("actual_fee") - F.col("expected_fee")) / F.col("expected_fee") > 0.15), F.lit(False)),
    "earned_split": lambda: F.coalesce(F.abs(F.col("earned") + F.col("unearned") - F.col("gross")) > 0.5, F.lit(False)),
    "double_charge": lambda: (F.size("redundant_codes") >= 2) & (F.size(F.array_distinct("redundant_content")) == 1) & (F.size(F.array_distinct("redundant_codes")) >= 2),
    "proration": lambda: F.coalesce(F.col("mid_cycle") & (F.abs(F.col("proration") - F.col("expected_proration")) > 0.05 * F.col("expected_proration")), F.lit(False)),
}


def stateless_hits(events: DataFrame, names: list[str]) -> DataFrame:
    """One row for each event and rule that fires; a stream stays a stream."""
    fired = F.filter(F.array(*[F.when(STATELESS[n](), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    return events.withColumn("rule_type", F.explode(fired))


def lag_seconds(events: DataFrame, now) -> DataFrame:
    """Seconds between event time and the given processing time; negative lags count as 0, over a minute are left out."""
    lag = F.unix_timestamp(now) - F.unix_timestamp("ts")
    return events.withColumn("lag_s", F.greatest(lag, F.lit(0))).where(lag <= 60)
