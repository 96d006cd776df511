"""Joins that need a deliberate form: as-of, range on cycles, first of two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], how: str = "left") -> DataFrame:
    """Each left row with the right row of its keys that is latest at or before its time.

    Both sides are tagged, unioned and sorted once by key; the last right row seen is carried along. One shuffle on
    the keys and no product of a key's rows; needs a column ``row_id`` that tells left rows apart.
    """
    payload = F.struct(right_time, *columns)
    r = right.select(*keys, F.col(right_time).alias("t_"), F.lit(0).alias("side_"), payload.alias("r_"), F.lit(None).cast("long").alias("row_id"))
    cols = [c for c in left.columns if c not in keys + ["row_id"]]
    l = left.select(*keys, F.col(left_time).alias("t_"), F.lit(1).alias("side_"), F.struct(*cols).alias("l_"), "row_id")
    w = W.partitionBy(*keys).orderBy("t_", "side_", "r_").rowsBetween(W.unboundedPreceding, 0)
    t = l.unionByName(r, allowMissingColumns=True).withColumn("hit_", F.last("r_", ignorenulls=True).over(w)).where("side_ = 1")
    out = t.select(*keys, "row_id", *[F.col(f"l_.{c}") for c in cols], *[F.col(f"hit_.{c}").alias(c) for c in [right_time, *columns]])
    return out.where(F.col(right_time).isNotNull()) if how == "inner" else out


def cycle_join(txn: DataFrame, cycles: DataFrame) -> DataFrame:
    """Transactions in the cycle that covers their time; month-shaped cycles meet on customer and month."""
    t = txn.withColumn("month_", F.date_trunc("month", "ts"))
    c = cycles.withColumn("month_", F.explode(F.sequence(F.date_trunc("month", "cycle_start"), F.date_trunc("month", "cycle_end"), F.expr("INTERVAL 1 MONTH"))))
    return t.join(c, ["customer_id", "month_"]).where("ts >= cycle_start AND ts < cycle_end").drop("month_")


def first_match(tables: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Rows of several tables under one key; the earlier table wins."""
    t = None
    for order, (name, df) in enumerate(tables):
        x = df.withColumn("found_in", F.lit(name)).withColumn("o_", F.lit(order))
        t = x if t is None else t.unionByName(x, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy("o_")
    return t.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_", "o_")
