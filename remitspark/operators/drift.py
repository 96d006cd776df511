"""Two-sample drift of feature distributions, by sorting and counting only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remitspark.functions.stats import band, interpolated, running

SEVERITY = [(0.40, "alert"), (0.20, "warn"), (0.10, "watch")]


def ks_statistic(samples: DataFrame, feature: str = "feature", value: str = "value", current: str = "is_current", also: tuple[str, ...] = ()) -> DataFrame:
    """One row a feature (and ``also``, such as the tick): sizes of both samples and the largest gap between their distribution
    functions.

    Equal values are combined first, and distribution functions are summed up over ranges of values (``running``), so
    that a feature is not one task's work.
    """
    c, keys = F.col(current), [feature, *also]
    t = running(samples, value, keys, {"a": F.count_if(c), "b": F.count_if(~c)})
    gap = F.coalesce(F.abs(F.try_divide("a_upto", "a_all") - F.try_divide("b_upto", "b_all")), F.lit(0.0))
    g = t.groupBy(*keys).agg(F.max("a_all").alias("n_current"), F.max("b_all").alias("n_baseline"), F.max(gap).alias("d"))
    return g.withColumn("d", F.when((F.col("n_current") == 0) | (F.col("n_baseline") == 0), 0.0).otherwise(F.col("d")))


def at_ticks(rows: DataFrame, ticks: list[str], time: str, current_days: int, baseline_days: int) -> DataFrame:
    """Rows under each tick (a timestamp as text) whose samples they are in: the current one ends at the tick, the baseline
    lies before it. ``tick`` and ``is_current`` are added."""
    at = F.explode(F.array(*[F.lit(t).cast("timestamp_ntz") for t in ticks])).alias("tick")
    day = lambda n: F.make_dt_interval(F.lit(n))
    t = rows.select("*", at).where((F.col(time) < F.col("tick")) & (F.col(time) >= F.col("tick") - day(current_days + baseline_days)))
    return t.withColumn("is_current", F.col(time) >= F.col("tick") - day(current_days))


def drift_rows(samples: DataFrame) -> DataFrame:
    """A row for each feature and tick of samples(feature, tick, is_current, value): sizes, gap, severity, and mean, deviation,
    median and 95th percentile of both samples."""
    keys = ["feature", "tick"]
    rows = ks_statistic(samples, also=("tick",)).withColumn("severity", severity(F.col("d")))
    side = interpolated(samples, "value", [*keys, "is_current"], {"p50": 0.5, "p95": 0.95})
    side = side.drop("n").join(samples.groupBy(*keys, "is_current").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")), [*keys, "is_current"])
    pick = lambda c, current: F.max(F.when(F.col("is_current") == current, F.col(c)))
    both = side.groupBy(*keys).agg(*[pick(c, cur).alias(f"{c}_{n}") for c in ("mean", "std", "p50", "p95") for n, cur in (("current", True), ("baseline", False))])
    return rows.join(both, keys, "left")


def progression(history: DataFrame, rows: DataFrame) -> DataFrame:
    """What a run appends to history(feature, tick, severity, before): one entry for each tick whose severity is not that of the
    feature's tick before it, in this run or at the end of the history. The first severity of a feature has no ``before``."""
    last = history.groupBy("feature").agg(F.max_by("severity", "tick").alias("severity"), F.max("tick").alias("tick"))
    t = last.select("feature", "tick", "severity", F.lit(0).alias("new")).unionByName(rows.select("feature", "tick", "severity", F.lit(1).alias("new")))
    w = W.partitionBy("feature").orderBy("tick")  # a row a tick of this run
    t = t.withColumn("before", F.lag("severity").over(w)).where("new = 1")
    known = t.join(last.select("feature", F.col("tick").alias("known")), "feature", "left").where("known is null or tick > known")
    return known.where("before is null or before <> severity").select("feature", "tick", "severity", "before")


def ks_p_value(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic probability of a gap this large: 2 sum (-1)^(k-1) exp(-2 k^2 lambda^2), kept within 0 and 1."""
    root = F.sqrt(F.try_divide(n * m, n + m))
    lam = F.coalesce((root + 0.12 + F.try_divide(F.lit(0.11), root)) * d, F.lit(0.0))
    term = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam)
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(terms)), term), F.lit(0.0), lambda a, x: a + x)
    return F.when(d <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * total)))


def severity(d: Column) -> Column:
    return band(d, SEVERITY, "none")


def recommended_action(level: Column, consumers: Column) -> Column:
    """An alert that somebody reads is for whoever is on call; an alert nobody reads and a warning are to be investigated."""
    return F.when((level == "alert") & (consumers > 0), "alert_oncall").when(level.isin("alert", "warn"), "investigate").otherwise("monitor")


def latest(rows: DataFrame) -> DataFrame:
    """The row of each feature's last tick."""
    rest = [c for c in rows.columns if c not in ("feature", "tick")]
    return rows.groupBy("feature").agg(F.max(F.struct("tick", *rest)).alias("x")).select("feature", "x.*")


def top_drifting(rows: DataFrame, consumers: DataFrame, writers: DataFrame, top: int) -> DataFrame:
    """The features whose last tick of rows(feature, tick, d, severity) has the largest gaps (ties by name), each with how many it
    concerns: its consumers, or where none are registered, those that have written values of it.

    consumers(feature, consumers array<struct<name, type>>), writers(feature, n)."""
    first = latest(rows.select("feature", "tick", "d", "severity")).orderBy(F.desc_nulls_last("d"), "feature").limit(top)
    t = first.join(consumers, "feature", "left").join(writers, "feature", "left")
    named = F.when(F.size("consumers") > 0, F.size("consumers").cast("long"))
    return t.select("feature", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("severity", F.lit("none")).alias("severity"), F.coalesce(named, "n", F.lit(0)).alias("concerned"))


def impact(rows: DataFrame, consumers: DataFrame) -> DataFrame:
    """Each drifting feature's consumers by kind (one without a type is a model), their names, and what to do about its last tick."""
    none = F.array().cast("array<struct<name:string,type:string>>")
    t = latest(rows.select("feature", "tick", "severity")).join(consumers, "feature", "left").withColumn("who", F.coalesce("consumers", none))
    is_rule = lambda c: F.coalesce(c["type"] == "rule", F.lit(False))
    return t.select(
        "feature", F.size(F.filter("who", lambda c: ~is_rule(c))).cast("long").alias("models"), F.size(F.filter("who", is_rule)).cast("long").alias("rules"),
        F.array_sort(F.transform("who", lambda c: c["name"])).alias("names"), recommended_action(F.col("severity"), F.size("who")).alias("action"),
    )
