"""The customer record against plain loops: trends, engagement, channels, refresh, nightly runs, CRM snapshots."""

import datetime as dt
import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from remitspark.operators import customer360 as R
from remitspark.streaming.tables import SnapshotTable

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 3, 10)
BILL = "customer_id long, ts timestamp_ntz, status string, txn_type string, total decimal(18,2), viewing_minutes decimal(18,2)"
TOUCH = "customer_id long, channel string, opened_at timestamp_ntz, clicked_at timestamp_ntz, converted_at timestamp_ntz"


def some_bills(n=400, seed=1):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [(pick(1, 2, 3, None), pick(T0 - DAY * rng.randint(-25, 500), None), pick("settled", "settled", "open", None), pick("ppv_charge", "ppv_purchase", "refund", None), pick(D(rng.randint(0, 9999)) / 100, None), pick(D(rng.randint(0, 500)), None)) for _ in range(n)]


def customers(spark, *ids):
    return spark.createDataFrame([(i, "commercial" if i and i % 2 else "residential") for i in ids], "customer_id long, customer_type string")


def test_trends(spark):
    rows = some_bills()
    rows += rows[:20]  # repeated rows are bills of their own
    months = [f"{2023 + (3 + k) // 12}-{(3 + k) % 12 + 1:02d}" for k in range(12)]
    want = {i: {m: [D(0), D(0), 0] for m in months} for i in (1, 2, 3, 9)}
    for c, ts, status, kind, total, minutes in rows:
        if c is None or ts is None or status != "settled" or ts.strftime("%Y-%m") not in months:
            continue
        x = want[c][ts.strftime("%Y-%m")]
        x[0] += total or 0
        x[1] += minutes or 0
        x[2] += kind in ("ppv_charge", "ppv_purchase")
    at = F.lit(T0).cast("timestamp_ntz")
    t = R.trends(customers(spark, 1, 2, 3, 9), spark.createDataFrame(rows, BILL).withColumn("spend", F.lit("clash")), at)
    got = R.by_month(t, at).collect()
    assert len(got) == 48 and {r.month for r in got} == set(months)
    for r in got:
        spend, minutes, ppv = want[r.customer_id][r.month]
        assert (r.spend, r.ppv, r.ltv) == (spend, ppv, sum(x[0] for x in want[r.customer_id].values()))
        assert abs(r.hours - float(minutes) / 60) <= 0.005 + 1e-9
    assert R.trends(customers(spark, 1), spark.createDataFrame([], BILL), at).first().spend == [D(0)] * 12
    assert R.trends(customers(spark), spark.createDataFrame(rows, BILL), at).count() == 0


def test_trends_shuffle_a_row_a_customer(spark):
    t = R.trends(customers(spark, 1), spark.createDataFrame(some_bills(), BILL), F.lit(T0).cast("timestamp_ntz"))
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1


def test_engagement(spark):
    tickets = spark.createDataFrame([(1, "resolved"), (1, "open"), (1, None), (2, "open"), (None, "resolved")], "customer_id long, status string")
    touches = spark.createDataFrame([(1, "sms", T0, T0, None), (1, "sms", T0, None, None), (1, "sms", None, None, None), (1, None, None, None, None), (None, "sms", T0, T0, T0)], TOUCH)
    got = {r.customer_id: tuple(round(r[c], 4) for c in R.RATES) for r in R.engagement(customers(spark, 1, 2, 3), tickets, touches).collect()}
    assert got == {1: (0.3333, 0.5, 0.25), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_channels(spark):
    touches = spark.createDataFrame([(1, "sms", T0, T0 + DAY, None), (1, "sms", T0, None, T0 + 2 * DAY), (1, "email", None, None, None), (1, None, T0, None, None)], TOUCH)
    got = {r.channel: tuple(r[2:]) for r in R.channel_rates(touches).collect()}
    assert got == {"sms": (2, 1.0, 0.5, 0.5, T0 + 2 * DAY), "email": (1, 0.0, 0.0, 0.0, None), None: (1, 1.0, 0.0, 0.0, T0)}


def test_refresh(spark):
    hour = dt.timedelta(hours=1)
    state = spark.createDataFrame([(1, T0 - 5 * hour), (2, T0 - 6 * hour), (3, T0 - 5 * hour), (1, T0 - 50 * hour)], "customer_id long, computed_at timestamp_ntz")
    asked = spark.createDataFrame([(1, False), (1, None), (2, False), (3, False), (3, True), (4, False), (5, True), (None, True)], "customer_id long, force boolean")
    got = {r.customer_id: (r.forced, r.outcome) for r in R.refresh_outcomes(asked, customers(spark, 1, 2, 3, 4), state, F.lit(T0).cast("timestamp_ntz")).collect()}
    assert got == {1: (False, "skipped"), 2: (False, "computed"), 3: (True, "computed"), 4: (False, "computed"), 5: (True, "not_found"), None: (True, "not_found")}


def test_nightly(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/record", R.RECORD, ["customer_id"])
    tickets = spark.createDataFrame([(1, "resolved")], "customer_id long, status string")
    none = spark.createDataFrame([], TOUCH)
    bills = lambda total: spark.createDataFrame([(i, T0, "settled", "refund", D(total), None) for i in (1, 2)], BILL)
    run = lambda who, total, at, batch: {r.customer_type: tuple(r[1:]) for r in R.nightly(table, who, bills(total), tickets, none, at, batch).collect()}
    kept = lambda: {r.customer_id: (r.ltv, r.computed_at.hour) for r in table.read().collect()}
    assert run(customers(spark, 1), 5, "2024-03-10 00:00:00", 0) == {"commercial": (1, 1, 0)}
    assert run(customers(spark, 1, 2, None), 7, "2024-03-10 05:00:00", 1) == {"commercial": (1, 0, 1), "residential": (2, 1, 1)}
    assert kept() == {1: (D(5), 0), 2: (D(7), 5)}
    run(customers(spark, 1, 2), 100, "2024-03-10 23:00:00", 1)  # a batch that was published before
    assert kept() == {1: (D(5), 0), 2: (D(7), 5)}
    assert run(customers(spark, 1, 2), 9, "2024-03-10 06:00:00", 2) == {"commercial": (1, 1, 0), "residential": (1, 0, 1)}
    assert kept() == {1: (D(9), 6), 2: (D(7), 5)}


def test_crm_diff(spark):
    rng = random.Random(3)
    pick = lambda: rng.choice([None, [], ["a"], ["a", "b"], ["b", "c"]])
    hours = lambda: T0 + dt.timedelta(hours=rng.randint(0, 200), minutes=rng.randint(0, 59))
    snaps = [(k % 3, k, hours(), rng.choice([None, 0, 3599, 3600, 21600, 86400]), pick(), pick(), rng.choice([None, "x"])) for k in range(40)]
    cases = [(k, k % 4, hours()) for k in range(60)]
    now = {0: (["a"], ["b"]), 1: (None, ["a", "c"]), 3: ([], [])}
    t = R.crm_diff(
        spark.createDataFrame(cases, "row_id long, customer_id long, at timestamp_ntz"),
        spark.createDataFrame(snaps, "customer_id long, snapshot_id long, snapshot_at timestamp_ntz, lag_seconds long, promotions array<string>, entitlements array<string>, segment string"),
        spark.createDataFrame([(k, *x) for k, x in now.items()], "customer_id long, promotions array<string>, entitlements array<string>"), ["segment", "promotions"],
    )
    got = {r.row_id: r for r in t.collect()}
    assert len(got) == 60
    for k, c, at in cases:
        r, before = got[k], [s for s in snaps if s[0] == c and s[2] <= at]
        if not before:
            assert (r.snapshot_id, r.delta_count, r.delta_severity, r.lag_band, r.completeness, r.added_promotions) == (None,) * 6
            continue
        s = max(before, key=lambda x: (x[2], x[1]))
        diff = lambda a, b: sorted(set(a or []) - set(b or []))
        promo, ent = now.get(c, (None, None))
        want = [diff(promo, s[4]), diff(s[4], promo), diff(ent, s[5]), diff(s[5], ent)]
        assert [r.added_promotions, r.removed_promotions, r.added_entitlements, r.removed_entitlements] == want and r.delta_count == sum(map(len, want))
        assert r.delta_severity == ("would_have_caused_quarantine" if want[0] or want[2] else "normal")
        assert r.staleness_hours == (at - s[2]).total_seconds() // 3600
        assert r.lag_band == {None: "low", 0: "low", 3599: "low", 3600: "medium", 21600: "high", 86400: "critical"}[s[3]]
        missing = [f for f, x in (("segment", s[6]), ("promotions", s[4])) if x is None]
        assert r.fields_missing == missing and r.completeness == 1 - len(missing) / 2


def test_monthly_value(spark):
    rows = [(1, 7, T0, 1, 1, D(5)), (1, 7, T0 + DAY, 2, 1, D(6)), (1, 7, T0 + DAY, 2, 1, D(4)), (1, 8, T0, 1, 2, D(1)), (2, 7, T0, 3, 1, None)]
    t = spark.createDataFrame(rows, "customer_id long, product_ref long, ts timestamp_ntz, transaction_id long, line_no int, fee decimal(18,2)")
    assert {tuple(r) for r in R.monthly_value(t).collect()} == {(1, 2, D(7)), (2, 1, None)}
