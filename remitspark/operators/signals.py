"""Signals of a transaction: those it says by itself and its customer's record, and rolling ones stamped on later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remitspark.operators.joins import as_of_join

#: Distance that stands for another state than the customer's, in km.
AWAY_KM = 1500
#: Bills in the 30 days before from which a ratio to their mean says something.
LEAST_BEFORE = 3


def ratio(a: Column, b: Column, places: int = 4) -> Column:
    """a / b where b is positive, else null."""
    return F.when(b > 0, F.round(a.cast("double") / b.cast("double"), places))


def stateless(t: DataFrame) -> DataFrame:
    """Adds discount_pct (of the subtotal, 0 without one), promo_active, lock_in (an active subscription is locked in beyond the
    transaction), first_ppv (pay-per-view of a customer without entitlements), distance_km and fee_pct (null but for
    termination fees). Needs total, subtotal, discount, ts, txn_type, txn_state, home_state, promotions, entitlements,
    subscriptions array<struct<status, lock_in_end>>, termination_fee. Works on streams; null lists are empty, an
    unknown state is no distance."""
    size = lambda c: F.coalesce(F.size(F.when(F.col(c).isNotNull(), F.col(c))), F.lit(0))
    locked = F.exists("subscriptions", lambda s: F.coalesce((s["status"] == "active") & (s["lock_in_end"] > F.col("ts")), F.lit(False)))
    away = F.col("txn_state").isNotNull() & ~F.col("txn_state").eqNullSafe(F.col("home_state"))
    kind = lambda k: F.coalesce(F.col("txn_type") == k, F.lit(False))
    return t.withColumns({
        "discount_pct": F.coalesce(ratio(F.col("discount"), F.col("subtotal")), F.lit(0.0)), "promo_active": size("promotions") > 0, "lock_in": F.coalesce(locked, F.lit(False)),
        "first_ppv": kind("ppv_charge") & (size("entitlements") == 0), "distance_km": F.when(away, AWAY_KM).otherwise(0),
        "fee_pct": F.when(kind("termination_fee"), ratio(F.coalesce(F.col("total"), F.lit(0)), F.col("termination_fee"))),
    })


def stamped(rows: DataFrame, features: DataFrame, history: DataFrame, at: Column) -> DataFrame:
    """Rolling signals put on the rows that lack them: ``velocity_5m`` from the customer's newest five-minute feature at or
    before the row, and ``vs_mean_30d``, how far the amount is off the mean of the 30 days before (4 places; null under three
    bills or a mean of 0). What is there stays, and ``computed_at`` moves only where something was put; rows without a
    customer or a time stay as they are.

    rows(row_id, customer_id, ts, amount, velocity_5m, vs_mean_30d, computed_at), features(customer_id, window_end, n),
    history(customer_id, ts, amount). Sums up to a time are carried by two as-of joins, one for each end of the 30 days,
    so no row meets its month of history.
    """
    lacks = F.col("velocity_5m").isNull() | F.col("vs_mean_30d").isNull()
    lacks &= F.col("customer_id").isNotNull() & F.col("ts").isNotNull()
    some = rows.where(lacks)
    fast = as_of_join(some, features.withColumnRenamed("n", "fast_"), ["customer_id"], "ts", "window_end", ["fast_"]).drop("window_end")
    # all of a customer's bills up to and with each second
    w = W.partitionBy("customer_id").orderBy("until_").rowsBetween(W.unboundedPreceding, 0)
    a_second = history.where("ts is not null").groupBy("customer_id", F.date_trunc("second", "ts").alias("until_")).agg(F.count("amount").alias("k_"), F.sum("amount").alias("s_"))
    sums = a_second.select("customer_id", "until_", F.sum("k_").over(w).alias("count_"), F.sum("s_").over(w).alias("sum_"))
    second = F.date_trunc("second", "ts")
    for end, shift in (("hi_", "1 SECOND"), ("lo_", "2592001 SECONDS")):
        made = sums.withColumnsRenamed({"count_": f"count_{end}", "sum_": f"sum_{end}", "until_": f"until_{end}"})
        fast = as_of_join(fast.withColumn(f"at_{end}", second - F.expr(f"INTERVAL {shift}")), made, ["customer_id"], f"at_{end}", f"until_{end}", [f"count_{end}", f"sum_{end}"])
    n = F.coalesce("count_hi_", F.lit(0)) - F.coalesce("count_lo_", F.lit(0))
    total = F.coalesce("sum_hi_", F.lit(0)) - F.coalesce("sum_lo_", F.lit(0))
    mean = F.try_divide(total.cast("double"), n.cast("double"))
    off = F.when((n >= LEAST_BEFORE) & (mean > 0), F.round((F.coalesce("amount", F.lit(0)).cast("double") - mean) / mean, 4))
    velocity, vs = F.coalesce("velocity_5m", "fast_"), F.coalesce("vs_mean_30d", off)
    put = (F.col("velocity_5m").isNull() & velocity.isNotNull()) | (F.col("vs_mean_30d").isNull() & vs.isNotNull())
    new = fast.withColumns({"computed_at": F.when(put, at).otherwise(F.col("computed_at")), "velocity_5m": velocity, "vs_mean_30d": vs})
    return rows.where(~lacks).unionByName(new.select(*rows.columns))
