"""Signals of transactions and analysts' decisions against plain loops."""

import datetime as dt
import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from remitspark.operators import cases as C
from remitspark.operators import signals as G
from remitspark.streaming.tables import SnapshotTable

T0 = dt.datetime(2024, 1, 1)
BASE = {"total": D(50), "subtotal": D(100), "discount": D(25), "ts": T0, "txn_type": "ppv_charge", "txn_state": "x", "home_state": "x", "promotions": ["p"], "entitlements": ["e"], "subscriptions": [("active", T0 + dt.timedelta(1))], "termination_fee": D(200)}
SCHEMA = "total decimal(18,2), subtotal decimal(18,2), discount decimal(18,4), ts timestamp_ntz, txn_type string, txn_state string, home_state string, promotions array<string>, entitlements array<string>, subscriptions array<struct<status:string,lock_in_end:timestamp_ntz>>, termination_fee decimal(18,2)"
MADE = ("discount_pct", "promo_active", "lock_in", "first_ppv", "distance_km", "fee_pct")


def test_stateless(spark):
    cases = [
        ({}, (0.25, True, True, False, 0, None)),
        ({"subtotal": D(0), "promotions": [], "entitlements": [], "subscriptions": [("ended", T0 + dt.timedelta(1)), ("active", T0)]}, (0.0, False, False, True, 0, None)),
        ({k: None for k in BASE}, (0.0, False, False, False, 0, None)),
        ({"txn_type": "termination_fee", "txn_state": "y", "entitlements": None}, (0.25, True, True, False, 1500, 0.25)),
        ({"txn_type": "termination_fee", "termination_fee": D(0), "txn_state": None, "subscriptions": [("active", None)]}, (0.25, True, False, False, 0, None)),
        ({"txn_type": "termination_fee", "total": None, "home_state": None}, (0.25, True, True, False, 1500, 0.0)),
    ]
    rows = [tuple((BASE | c).values()) + (k,) for k, (c, _) in enumerate(cases)]
    got = G.stateless(spark.createDataFrame(rows, SCHEMA + ", k int")).orderBy("k").select(*MADE).collect()
    assert [tuple(r) for r in got] == [w for _, w in cases]


def test_stamped(spark):
    rng = random.Random(5)
    day = lambda: T0 + dt.timedelta(days=rng.randint(0, 60), seconds=rng.choice([0, 0, 1, 3600]))
    bills = [(rng.choice([1, 2, 3, None]), rng.choice([day(), None]) if rng.random() < 0.1 else day(), rng.choice([D(rng.randint(0, 500)), D(0), None])) for _ in range(150)]
    feats = [(rng.choice([1, 2]), day(), rng.randint(1, 9)) for _ in range(20)]
    feats = list({(c, t): (c, t, n) for c, t, n in feats}.values())
    rows = [(k, *b, rng.choice([None, 7]), rng.choice([None, 0.5]), None) for k, b in enumerate(bills)] + [(999, 8, T0, None, None, None, T0)]
    now = T0 + dt.timedelta(90)
    t = G.stamped(
        spark.createDataFrame(rows, "row_id long, customer_id long, ts timestamp_ntz, amount decimal(18,2), velocity_5m long, vs_mean_30d double, computed_at timestamp_ntz"),
        spark.createDataFrame(feats, "customer_id long, window_end timestamp_ntz, n long"), spark.createDataFrame(bills, "customer_id long, ts timestamp_ntz, amount decimal(18,2)"), F.lit(now).cast("timestamp_ntz"),
    )
    got = {r.row_id: r for r in t.collect()}
    assert len(got) == len(rows)
    put = 0
    for k, c, ts, amount, v0, r0, at in rows:
        v1, r1 = v0, r0
        if c is not None and ts is not None:
            seen = [f for f in feats if f[0] == c and f[1] <= ts]
            v1 = v0 if v0 is not None else (max(seen, key=lambda f: f[1])[2] if seen else None)
            before = [float(b[2]) for b in bills if b[0] == c and b[1] and b[2] is not None and ts - dt.timedelta(30) <= b[1] < ts]
            mean = sum(before) / len(before) if before else 0
            if r0 is None and len(before) >= 3 and mean > 0:
                r1 = (float(amount or 0) - mean) / mean
        r = got[k]
        assert r.velocity_5m == v1 and (r.vs_mean_30d is None) == (r1 is None)
        assert r1 is None or abs(r.vs_mean_30d - r1) <= 0.00005001
        new = (v0 is None and v1 is not None) or (r0 is None and r1 is not None)
        put += new
        assert r.computed_at == (now if new else at)
    assert put > 20


def test_drivers(spark):
    t = spark.createDataFrame([("high", D("999.99"), 1, False), ("low", D(1000), 2, True), (None, None, None, None)], "severity string, a decimal(18,2), p int, c boolean")
    got = [r.d for r in t.select(C.priority_drivers("severity", F.col("a"), F.col("p"), F.col("c")).alias("d")).collect()]
    assert got == [["severity:high"], ["severity:low", "amount_at_risk:1000.00", "repeat_offender:2", "commercial_account"], []]


def test_dispose(spark, tmp_path):
    cases = SnapshotTable(spark, f"file://{tmp_path}/cases", C.DECIDED, ["case_id"])
    archive = SnapshotTable(spark, f"file://{tmp_path}/archive", C.ARCHIVED, ["case_id"])
    cases.apply(lambda old: spark.createDataFrame([(k, "open", None, None, None, None) for k in range(5)], C.DECIDED), 0)
    texts = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "case_id long, text string")
    at = lambda h: T0 + dt.timedelta(hours=h)
    made = lambda *rows: spark.createDataFrame(rows, "case_id long, disposition string, analyst string, notes string, at timestamp_ntz")
    first = made((0, "true_positive", "a", None, at(1)), (1, "false_positive", "a", "n", at(1)), (1, "needs_more_info", "b", "n", at(0)), (2, "needs_more_info", "a", None, at(1)), (3, None, "a", None, at(1)), (77, "true_positive", "a", None, at(1)))
    C.dispose(cases, archive, first, texts, 1)
    kept = lambda: {r.case_id: (r.status, r.disposition, r.resolved_at) for r in cases.read().collect()}
    want = {0: ("resolved", "true_positive", at(1)), 1: ("resolved", "false_positive", at(1)), 2: ("under_review", "needs_more_info", None), 3: ("under_review", None, None), 4: ("open", None, None)}
    assert kept() == want
    told = lambda: {r.case_id: (r.disposition, r.text, r.schema_version) for r in archive.read().collect()}
    assert told() == {0: ("true_positive", None, 4), 1: ("false_positive", "one", 4)}
    C.dispose(cases, archive, made((4, "true_positive", "a", None, at(2))), texts, 1)  # the number of a batch that was applied
    assert kept() == want and len(told()) == 2
    C.dispose(cases, archive, made((1, "true_positive", "c", None, at(5)), (2, "false_positive", "c", None, at(5))), texts, 2)
    assert told()[1] == ("true_positive", "one", 4) and told()[2] == ("false_positive", "two", 4) and kept()[2] == ("resolved", "false_positive", at(5))


def test_archive_without_its_cases(spark, tmp_path):
    """A batch that got as far as the archive is completed by running it again."""
    cases = SnapshotTable(spark, f"file://{tmp_path}/cases", C.DECIDED, ["case_id"])
    archive = SnapshotTable(spark, f"file://{tmp_path}/archive", C.ARCHIVED, ["case_id"])
    cases.apply(lambda old: spark.createDataFrame([(1, "open", None, None, None, None)], C.DECIDED), 0)
    decided = spark.createDataFrame([(1, "true_positive", "a", None, T0)], "case_id long, disposition string, analyst string, notes string, at timestamp_ntz")
    texts = spark.createDataFrame([(1, "one")], "case_id long, text string")
    whole, cases.apply = cases.apply, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        C.dispose(cases, archive, decided, texts, 1)
    except RuntimeError:
        pass
    cases.apply = whole
    assert archive.read().count() == 1 and cases.read().first().status == "open"
    C.dispose(cases, archive, decided, texts, 1)
    assert archive.read().count() == 1 and cases.read().first().status == "resolved"
