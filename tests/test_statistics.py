"""Quantiles, ranking quality, drift over ticks and rule sets against plain computations."""

import datetime as dt
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from remitspark.functions import stats as S
from remitspark.operators import drift as K
from remitspark.operators import rules as R

SF = "/root/testdata/sf0.001"


def test_interpolated(spark):
    rng = random.Random(3)
    rows = [(g, float(rng.choice([rng.randint(0, 30), rng.random()]))) for g, n in (("a", 1), ("b", 2), ("c", 501), (None, 40)) for _ in range(n)] + [("c", None)]
    got = {r.g: r for r in S.interpolated(spark.createDataFrame(rows, "g string, x double"), "x", ["g"], {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p1": 1.0}).collect()}
    for g in ("a", "b", "c", None):
        x = [v for k, v in rows if k == g and v is not None]
        assert got[g].n == len(x)
        assert [got[g].p0, got[g].p50, got[g].p95, got[g].p1] == pytest.approx(np.quantile(x, [0, 0.5, 0.95, 1]).tolist())
    none = S.interpolated(spark.createDataFrame([], "g string, x double"), "x", [], {"p50": 0.5}).first()
    assert (none.n, none.p50) == (0, None)


@pytest.mark.parametrize("tied", [True, False])
def test_ranking_quality(spark, tied):
    rng = random.Random(tied)
    rows = [(int(rng.random() < 0.3), float(rng.randint(0, 9)) if tied else rng.random()) for _ in range(300)]
    got = S.ranking_quality(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    ap, before = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        hit, shown = sum(p >= t for p in pos), sum(s >= t for _, s in rows)
        ap += (hit / len(pos) - before) * hit / shown
        before = hit / len(pos)
    assert (got.auc, got.average_precision) == pytest.approx((auc, ap))
    alone = S.ranking_quality(spark.createDataFrame([(0, 1.0)], "y int, s double"), "y", "s").first()
    assert tuple(alone) == (None, None)


def test_drift_at_ticks(spark):
    """Severities by sorting, day by day, and one entry a change, however the ticks are dealt over runs."""
    import datetime as dt

    rng = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f, t0 + dt.timedelta(hours=rng.randint(0, 20 * 24)), rng.gauss(0, 1)) for f in "ab" for _ in range(500)]
    rows = [(f, t, v + (1.5 if f == "a" and 10 <= (t - t0).days < 14 else 0)) for f, t, v in rows]
    ticks = [t0 + dt.timedelta(days=d) for d in range(8, 20)]
    df = spark.createDataFrame(rows, "feature string, ts timestamp_ntz, value double")
    got = K.drift_rows(K.at_ticks(df, [str(t) for t in ticks], "ts", 2, 6).select("feature", "tick", "is_current", "value")).collect()
    want = {}
    for f in "ab":
        for t in ticks:
            cur = sorted(v for g, x, v in rows if g == f and t - dt.timedelta(days=2) <= x < t)
            base = sorted(v for g, x, v in rows if g == f and t - dt.timedelta(days=8) <= x < t - dt.timedelta(days=2))
            d = max(abs(np.searchsorted(cur, v, "right") / len(cur) - np.searchsorted(base, v, "right") / len(base)) for v in cur + base)
            want[f, t] = (len(cur), len(base), d, np.median(cur), np.std(base, ddof=1))
    assert len(got) == len(want)
    for r in got:
        assert (r.n_current, r.n_baseline, r.d, r.p50_current, r.std_baseline) == pytest.approx(want[r.feature, r.tick])
    level = lambda d: "alert" if d >= 0.4 else "warn" if d >= 0.2 else "watch" if d >= 0.1 else "none"
    steps = []
    for f in "ab":
        before = None
        for t in ticks:
            if (now := level(want[f, t][2])) != before:
                steps.append((f, t, now, before))
            before = now
    rows = spark.createDataFrame([(r.feature, r.tick, r.severity) for r in got], "feature string, tick timestamp_ntz, severity string")
    for cuts in ([0, 12], [0, 1, 5, 12], [0, 6, 3, 12]):  # the last runs some ticks again
        history = spark.createDataFrame([], "feature string, tick timestamp_ntz, severity string, before string")
        for a, b in zip(cuts, cuts[1:]):
            lo, hi = min(a, b), max(a, b)
            new = K.progression(history, rows.where(F.col("tick").isin(ticks[lo:hi])))
            history = spark.createDataFrame(history.unionByName(new).collect(), history.schema)
        assert sorted((tuple(r) for r in history.collect()), key=str) == sorted(steps, key=str)
    assert K.progression(history, rows.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_rule_set_reads_lines_twice(spark):
    """Once for what all rules judge (saved), once for double charges."""
    from remitspark.plans import rules as P
    from remitspark.views import Views

    v = Views(spark, SF)
    put_together = P.billed(v)._jdf.queryExecution().executedPlan().toString()
    whole = P.hits(v)._jdf.queryExecution().executedPlan().toString()
    count = lambda plan: len(re.findall(r"FileScan parquet[^\n]*lineitem\.parquet", plan))
    assert (count(put_together), count(whole)) == (1, 1)


def test_rule_set_keeps_the_lookback(spark):
    """A rule in a set judges by the same span as the rule alone."""
    rng = random.Random(1)
    rows = [(k, rng.randint(1, 3), f"2024-{1 + rng.randint(0, 11):02d}-01 00:00:00", float(rng.choice([10, 11, 12, 13, 500]))) for k in range(300)]
    t = spark.createDataFrame(rows, "transaction_id long, customer_id long, ts string, amount double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    as_of = F.lit("2024-12-31 00:00:00").cast("timestamp_ntz")
    found = []
    for days in (60, 150, 400):
        params = {"multiplier": 2.0, "minimum_history": 3, "lookback_days": days, "as_of": as_of}
        alone = {r.transaction_id for r in R.amount_outlier(t, 2.0, days, 3, as_of).collect()}
        in_set = {r.transaction_id for r in R.run_rules(t, [R.Rule("amount_outlier", params)]).collect()}
        assert alone == in_set
        found.append(alone)
    both = R.run_rules(t, [R.Rule("amount_outlier", {"multiplier": 2.0, "minimum_history": 3, "lookback_days": d, "as_of": as_of}, mode=str(d)) for d in (60, 400)])
    assert [{r.transaction_id for r in both.where(F.col("mode") == m).collect()} for m in ("60", "400")] == [found[0], found[2]]
    assert found[0] != found[2]


def test_outliers_over_all_orders(spark, tmp_path):
    """rul_03 judges transactions of any age by all that came before them."""
    from remitspark import registry

    rows = [(k, 1, "F", 100.0 + k % 2, dt.datetime(1992, 1, 1 + k), "1-URGENT") for k in range(8)] + [(8, 1, "F", 9000.0, dt.datetime(1992, 2, 1), "1-URGENT"), (9, 1, "F", 90000.0, dt.datetime(2001, 7, 1), "1-URGENT")]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.queries()["rul_03_amount_outlier"](spark, str(tmp_path)).collect()
    assert sorted((r.transaction_id, r.n_before) for r in got) == [(8, 8), (9, 9)]
