"""Quantile conventions, bands and windows that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Ranges of values that a group's running counts are cut into.
BUCKETS = 64


def running(df: DataFrame, value: str, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    """(keys, value, counts, running counts ``<name>_upto``, totals ``<name>_all``) for each different value of a group,
    nulls left out. Equal values are combined first; the rest is cut into ranges of values by approximate quantiles, so
    that a large group is many tasks' work: ranges are summed up, and a window runs inside each range only."""
    names = list(counts)
    ties = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[c.alias(n) for n, c in counts.items()])
    cuts = ties.groupBy(*keys).agg(F.percentile_approx(value, [k / BUCKETS for k in range(1, BUCKETS)], 1000).alias("cuts_"))
    side = cuts.select(*[F.col(k).alias(f"{k}_k") for k in keys], "cuts_")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_k")) for k in keys]
    t = ties.join(side, same) if keys else ties.crossJoin(F.broadcast(side))  # without keys one row
    t = t.withColumn("range_", F.size(F.filter("cuts_", lambda c: c < F.col(value)))).drop("cuts_", *[f"{k}_k" for k in keys])
    sums = t.groupBy(*keys, "range_").agg(*[F.sum(n).alias(f"{n}_s") for n in names])
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))  # at most BUCKETS rows a group
    before = whole.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"{k}_k") for k in keys], F.col("range_").alias("range_k"), *[F.coalesce(F.sum(f"{n}_s").over(before), F.lit(0)).alias(f"{n}_before") for n in names], *[F.sum(f"{n}_s").over(whole).alias(f"{n}_all") for n in names])
    t = t.join(sums, [*same, F.col("range_") == F.col("range_k")])
    inside = W.partitionBy(*keys, "range_").orderBy(value)
    return t.select(*keys, value, *names, *[(F.col(f"{n}_before") + F.sum(n).over(inside)).alias(f"{n}_upto") for n in names], *[f"{n}_all" for n in names])


def ranked(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, value, first, last, n): the 1-based ranks that each different value of a group takes, and its size."""
    t = running(df, value, keys, {"c": F.count("*")})
    return t.select(*keys, value, (F.col("c_upto") - F.col("c") + 1).alias("first"), F.col("c_upto").alias("last"), F.col("c_all").alias("n"))


def holds(place: Column) -> Column:
    """Whether a row of ``ranked`` takes the 0-based place."""
    return place.between(F.col("first") - 1, F.col("last") - 1)


#: 0-based index into n sorted values of the p-quantile, by convention.
CONVENTIONS = {
    "truncated": lambda n, p: F.least(n - 1, F.floor(p * n)),
    "ceiling": lambda n, p: F.ceil(p * n) - 1,
    "live": lambda n, p: F.greatest(F.lit(0), F.least(n - 1, F.floor(n * p) - 1)),
    "nearest": lambda n, p: F.bround(p * (n - 1), 0).cast("long"),
}


def nearest_rank(df: DataFrame, value: str, keys: list[str], p: float, convention: str, name: str) -> DataFrame:
    """One row a group: the value at the convention's index."""
    return nearest_ranks(df, value, keys, {name: (p, convention)})


def nearest_ranks(df: DataFrame, value: str, keys: list[str], picks: dict[str, tuple[float, str]]) -> DataFrame:
    """One row a group: the values at several indexes, from one ranking."""
    t = ranked(df, value, keys)
    picked = [F.max(F.when(holds(CONVENTIONS[c](F.col("n"), F.lit(p))), F.col(value))).alias(name) for name, (p, c) in picks.items()]
    return t.groupBy(*keys).agg(*picked)


def interpolated(df: DataFrame, value: str, keys: list[str], picks: dict[str, float]) -> DataFrame:
    """(keys, n, and a column a pick): quantiles between the two values beside place p (n - 1), n without nulls. From ranks that
    are summed up over ranges of values, so that no group's values are held in one place."""
    t = ranked(df, value, keys)
    place = {name: F.lit(p) * (F.col("n") - 1) for name, p in picks.items()}
    ends = [F.max(F.when(holds(end(place[name]).cast("long")), F.col(value))).cast("double").alias(f"{name}_{k}") for name in picks for k, end in (("lo", F.floor), ("hi", F.ceil))]
    g = t.groupBy(*keys).agg(F.max("n").alias("n"), *ends)
    between = lambda name: F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (place[name] - F.floor(place[name]))
    return g.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), *[between(name).alias(name) for name in picks])


def band(x: Column, cuts: list[tuple[float, str]], low: str) -> Column:
    """The name of the first cut that x reaches, cuts from high to low."""
    out = None
    for cut, name in cuts:
        out = F.when(x >= cut, name) if out is None else out.when(x >= cut, name)
    return out.otherwise(low)


def ltv_band(x: Column) -> Column:
    return band(x, [(20000, "platinum"), (8000, "gold"), (2000, "silver")], "bronze")


def churn_band(x: Column) -> Column:
    return band(x, [(0.80, "critical"), (0.55, "high"), (0.25, "medium")], "low")


def cross_sell_band(x: Column) -> Column:
    return band(x, [(0.67, "high"), (0.34, "medium")], "low")


def hopping(ts: Column, length: int, hop: int) -> Column:
    """Start seconds of every window of ``length`` seconds, each ``hop`` seconds, that holds the time."""
    t = F.unix_timestamp(ts)
    last = t - t % hop
    return F.explode(F.sequence(last - (length - hop), last, F.lit(hop).cast("long")))


def ranking_quality(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: area under the curve and average precision of a score against labels 0 and 1, ties at their mean rank and as
    one threshold; null where a label is missing. Scores are ranked over ranges of values, whatever their number."""
    t = running(df, score, [], {"n": F.count("*"), "p": F.sum(F.col(label).cast("long"))})
    p, n = F.max("p_all").cast("double"), F.max("n_all").cast("double")
    ranks = F.sum(F.col("p") * (F.col("n_upto") - (F.col("n") - 1) / 2.0))
    hits, shown = F.col("p_all") - F.col("p_upto") + F.col("p"), F.col("n_all") - F.col("n_upto") + F.col("n")
    precise = F.sum(F.try_divide(F.col("p"), F.col("p_all")) * (hits / shown))
    return t.agg(F.try_divide(ranks - p * (p + 1) / 2, p * (n - p)).alias("auc"), F.when(p > 0, precise).alias("average_precision"))
