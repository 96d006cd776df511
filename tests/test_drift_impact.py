"""Who is concerned by a drifting feature."""

import datetime as dt

from remitspark.operators import drift as K

DAY = dt.datetime(2024, 1, 1)
ROWS = "feature string, tick timestamp_ntz, d double, severity string"
CONSUMERS = "feature string, consumers array<struct<name:string,type:string>>"


def inputs(spark):
    at = lambda n: DAY + dt.timedelta(n)
    rows = [("a", at(0), 0.9, "alert"), ("a", at(1), 0.1, "watch"), ("b", at(1), 0.5, "alert"), ("c", at(0), 0.5, "alert"), ("d", at(0), 0.2, "warn"), ("e", at(0), None, None)]
    who = [("a", [("m", "model"), ("r", "rule")]), ("b", [("x", None), ("r", "rule"), ("r", "rule")]), ("c", []), ("other", [("m", "model")])]
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame(who, CONSUMERS)


def test_top(spark):
    rows, who = inputs(spark)
    wrote = spark.createDataFrame([("b", 99), ("c", 7)], "feature string, n long")
    got = [tuple(r) for r in K.top_drifting(rows, who, wrote, 9).collect()]
    assert sorted(got) == [("a", 0.1, "watch", 2), ("b", 0.5, "alert", 3), ("c", 0.5, "alert", 7), ("d", 0.2, "warn", 0), ("e", 0.0, "none", 0)]
    assert {r.feature for r in K.top_drifting(rows, who, wrote, 2).collect()} == {"b", "c"}
    assert K.top_drifting(rows.limit(0), who, wrote, 2).count() == 0


def test_impact(spark):
    got = {r.feature: (r.models, r.rules, r.names, r.action) for r in K.impact(*inputs(spark)).collect()}
    assert got == {
        "a": (1, 1, ["m", "r"], "monitor"), "b": (1, 2, ["r", "r", "x"], "alert_oncall"), "c": (0, 0, [], "investigate"), "d": (0, 0, [], "investigate"), "e": (0, 0, [], "monitor"),
    }
