"""Churn drivers and offers, buckets and burst runs, against plain rules."""

import datetime as dt
import random
from decimal import Decimal as D

from remitspark.operators import people
from remitspark.plans import cases as P

BASE = {"minutes_silent": 10.0, "ratio": 0.5, "quarantines": 0, "open_cases": 0, "idle_subs": 0, "discount_rate": 0.0, "recent": 3, "package_value": D("100.00"), "recent_ppv": 0, "live_subs": 1, "spend_24h": 0.0, "promotions": ["p"]}
SCHEMA = "minutes_silent double, ratio double, quarantines long, open_cases long, idle_subs long, discount_rate double, recent long, package_value decimal(18,2), recent_ppv long, live_subs long, spend_24h double, promotions array<string>"


def scored(spark, *changes):
    rows = [tuple((BASE | c).values()) for c in changes]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {SCHEMA}")
    return {r.k: r for r in people.with_offers(people.churn_score(df)).collect()}


def test_drivers(spark):
    silent = lambda days: {"minutes_silent": 1440.0 * days}
    every = silent(15) | {"ratio": 0.1, "quarantines": 3, "open_cases": 2, "idle_subs": 1, "discount_rate": 0.3}
    nothing = {"minutes_silent": None, "ratio": None, "quarantines": None, "discount_rate": None, "recent": 0}
    got = scored(spark, {}, silent(7), silent(7.1), silent(14), silent(14.1), {"ratio": 0.0}, {"ratio": 0.3}, every, nothing, nothing | {"recent": 1}, nothing | {"open_cases": 2})
    assert [(round(got[k].score, 4), got[k].drivers) for k in range(11)] == [
        (0, []), (0, []), (0.2, ["no_txn_in_7d"]), (0.2, ["no_txn_in_7d"]), (0.4, ["no_txn_in_14d"]), (0, []), (0, []),
        (0.95, ["no_txn_in_14d", "low_package_utilisation", "recent_quarantines", "multiple_open_cases", "inactive_subscription", "high_discount_dependency"]),
        (0.3, ["no_recent_activity"]), (0, []), (0.1, ["multiple_open_cases"]),
    ]


def test_offers(spark):
    high = {"minutes_silent": 1440.0 * 20, "quarantines": 3, "open_cases": 2}
    got = scored(spark, {}, high | {"ratio": 0.9, "recent_ppv": 3, "live_subs": 0}, {"ratio": 0.9, "recent_ppv": 3}, {"spend_24h": 101.0, "promotions": []}, {"spend_24h": 100.0, "promotions": []}, {"ratio": 0.86, "package_value": D("0.00")})
    shown = {k: [(o.priority, o.offer, o.uplift) for o in r.offers] for k, r in got.items()}
    assert shown[0] == shown[4] == shown[5] == []
    assert shown[1] == [(1, "retention_discount", D("255.00")), (3, "upgrade", D("30.00")), (3, "addon", D("15.00")), (4, "winback", D("0.00"))]
    assert shown[2] == [(2, "upgrade", D("30.00")), (3, "addon", D("15.00"))]
    assert shown[3] == [(5, "loyalty_perk", D("25.00"))]


def test_buckets(spark):
    """By going through the transactions and opening a bucket where the last one of the cycle is full."""
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, rng.randint(1, 2), t0 + dt.timedelta(hours=rng.randint(0, 60)), rng.choice("ab"), rng.choice(["ppv_charge", "refund"]), D(k)) for k in range(90)]
    df = spark.createDataFrame(rows, "transaction_id long, customer_id long, ts timestamp_ntz, cycle string, txn_type string, total decimal(18,2)")
    want = {}
    for k, c, _, cycle, kind, total in sorted(rows, key=lambda r: (r[2], r[0])):
        mine = want.setdefault((c, cycle), [])
        if not mine or mine[-1][0] == 10:
            mine.append([0, 0, D(0)])
        b = mine[-1]
        b[0], b[1], b[2] = b[0] + 1, b[1] + (kind == "ppv_charge"), b[2] + total
    got = {r.bucket_id: (r.n, r.ppv, r.total, r.near_cap) for r in P.buckets(df, cap=10, alarm=8).collect()}
    assert got == {f"bkt_{c}_{cycle}_{k + 1}": (n, ppv, total, n >= 8) for (c, cycle), mine in want.items() for k, (n, ppv, total) in enumerate(mine)}


def test_burst_runs(spark):
    t0 = dt.datetime(2024, 1, 1)
    modes = {0: (20, 10.0), 1: (30, 300.0), 2: (28, 250.0), 5: (18, 1.0), 9: (5, 500.0)}
    df = spark.createDataFrame([(t0 + dt.timedelta(hours=h), n, p, "burst" if n >= 18 else "idle") for h, (n, p) in modes.items()], "at timestamp_ntz, n long, p99 double, mode string")
    got = [(r.started_at, r.last_at, r.n_samples, r.peak, r.mean, r.p99_max, r.near_peak, r.breaches, r.duration_s) for r in P.burst_runs(df).orderBy("started_at").collect()]
    hour = lambda h: t0 + dt.timedelta(hours=h)
    assert got == [(hour(0), hour(2), 3, 30, 26.0, 300.0, 2 / 3, 2, 7200), (hour(5), hour(5), 1, 18, 18.0, 1.0, 1.0, 0, 0)]
    assert P.burst_runs(df.where("n < 9")).count() == 0
