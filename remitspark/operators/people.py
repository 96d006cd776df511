"""What a customer's figures say: risk of leaving with its drivers, and the offers that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitspark.functions.stats import band

#: Drivers and their weight in hundredths, bands of the score.
DRIVERS = {"no_txn_in_14d": 40, "no_txn_in_7d": 20, "low_package_utilisation": 15, "recent_quarantines": 15, "multiple_open_cases": 10, "inactive_subscription": 10, "high_discount_dependency": 5}
NO_ACTIVITY = ("no_recent_activity", 30)
HIGH, MEDIUM = 0.65, 0.35
DAY = 1440


def churn_band(score: Column) -> Column:
    return band(score, [(HIGH, "high"), (MEDIUM, "medium")], "low")


def churn_score(t: DataFrame) -> DataFrame:
    """Customers with ``drivers`` and ``score`` (0 to 1). Of minutes_silent, ratio (spend to package), quarantines, open_cases,
    idle_subs, discount_rate a null says nothing; ``recent`` counts recent transactions."""
    silent, ratio = F.col("minutes_silent"), F.col("ratio")
    when = {
        "no_txn_in_14d": silent > 14 * DAY, "no_txn_in_7d": silent.between(7 * DAY, 14 * DAY) & (silent > 7 * DAY), "low_package_utilisation": (ratio > 0) & (ratio < 0.30), "recent_quarantines": F.col("quarantines") >= 3,
        "multiple_open_cases": F.col("open_cases") >= 2, "inactive_subscription": F.col("idle_subs") >= 1, "high_discount_dependency": F.col("discount_rate") > 0.25,
    }
    driver = lambda n, w: F.struct(F.lit(n).alias("n"), F.lit(w).alias("w"))
    hits = F.array_compact(F.array(*[F.when(when[n], driver(n, w)) for n, w in DRIVERS.items()]))
    hits = F.when((F.size(hits) == 0) & (F.col("recent") == 0), F.array(driver(*NO_ACTIVITY))).otherwise(hits)
    t = t.withColumn("hits_", hits)
    total = F.aggregate("hits_", F.lit(0), lambda a, x: a + x["w"])
    return t.withColumns({"drivers": F.transform("hits_", lambda x: x["n"]), "score": F.least(F.lit(100), total) / F.lit(100.0)}).drop("hits_")


def with_offers(t: DataFrame) -> DataFrame:
    """Scored customers with ``offers``, the most pressing first: priority, offer, and what it may bring in."""
    high, value = F.col("score") >= HIGH, F.col("package_value")
    money = lambda c: F.round(c, 2).cast("decimal(18,2)")
    rate = lambda x: F.lit(x).cast("decimal(4,2)")
    rules = [
        (high, F.lit(1), "retention_discount", money(value * rate("2.55"))),  # 85 percent for three cycles
        ((F.col("ratio") > 0.85) & (value > 0), F.when(high, 3).otherwise(2), "upgrade", money(value * rate("0.30"))),
        (F.col("recent_ppv") >= 3, F.lit(3), "addon", money(F.lit(15).cast("decimal(18,2)"))),
        (F.col("live_subs") == 0, F.lit(4), "winback", money(F.lit(0).cast("decimal(18,2)"))),
        ((F.col("score") < MEDIUM) & (F.col("spend_24h") > 100) & (F.size("promotions") == 0), F.lit(5), "loyalty_perk", money(F.lit(25).cast("decimal(18,2)"))),
    ]
    made = [F.when(c, F.struct(p.alias("priority"), F.lit(k).alias("k"), F.lit(name).alias("offer"), gain.alias("uplift"))) for k, (c, p, name, gain) in enumerate(rules)]
    return t.withColumn("offers", F.array_sort(F.array_compact(F.array(*made))))
