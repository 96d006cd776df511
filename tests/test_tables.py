"""Upgrades of a stored table and splits of one input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from remitspark.operators import cases as C
from remitspark.sources.scratch import shared_folder
from remitspark.streaming.split import Split, split_by
from remitspark.streaming.tables import SnapshotTable

T0 = dt.datetime(2024, 1, 1)
OLD = "case_id long, customer_id long, severity string, amount decimal(18,2), status string, disposition string, created_at timestamp_ntz, resolved_at timestamp_ntz, rules array<string>, schema_version int"


def test_upgrade(spark):
    """Rows of both versions side by side; the second run upgrades none, and what was current stays as it was."""
    from decimal import Decimal as D

    rows = [
        (1, 10, "critical", D("1000.00"), "resolved", "true_positive", T0, T0 + dt.timedelta(hours=3), ["a", "b"], 2),
        (2, 10, "low", D("20.00"), "open", "left over", T0, T0, [], None),
        (3, 99, "high", D("5.00"), "open", None, T0, None, ["a"], 1),
        (4, 11, "medium", D("7.00"), "open", None, T0, None, ["a"], 3),
    ]
    table = SnapshotTable(spark, shared_folder(spark, "cases"), C.CURRENT, ["case_id"])
    df = spark.createDataFrame(rows, OLD)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.types.fields if f.name not in df.columns]
    table.apply(lambda old: df.select("*", *none).select(*old.columns), 0)
    customers = spark.createDataFrame([(10, "commercial", 5), (11, "residential", 0)], "customer_id long, customer_type string, prior int")
    counts = lambda t: {r.outcome: r.n for r in t.collect()}
    assert counts(C.upgrade_step(table, customers, 0)) == {"scanned": 3, "upgraded": 2, "skipped_unknown_customer": 1}
    after = {r.case_id: r for r in table.read().collect()}
    one, two = after[1], after[2]
    assert (one.schema_version, one.priority_score, one.priority_band, one.sla_target) == (3, 0.76, "P1", T0 + dt.timedelta(minutes=30))
    assert [(e.at, e.actor, e.from_status, e.to_status, e.note) for e in one.lifecycle] == [(T0, "backfill", None, "open", "a,b"), (T0 + dt.timedelta(hours=3), "analyst", "open", "resolved", "true_positive")]
    assert (one.at_stake, one.net) == (D("800.00"), D("788.00"))
    assert (two.disposition, two.resolved_at, len(two.lifecycle)) == (None, None, 1)
    assert (after[3].schema_version, after[3].lifecycle) == (1, None) and (after[4].schema_version, after[4].priority_score) == (3, None)
    assert counts(C.upgrade_step(table, customers, 1)) == {"scanned": 1, "upgraded": 0, "skipped_unknown_customer": 1}
    assert {r.case_id: r for r in table.read().collect()} == after


def test_split(spark):
    rows = [(1, "a", 5), (2, "b", 6), (3, "b", None), (4, "other", 7)]
    out = split_by(spark.createDataFrame(rows, "k long, kind string, x long"), "kind", ["a", "b"], "k", shared_folder(spark, "split"))
    told = lambda s: {r.side: (r.n, r.strays) for r in s.check("k", "kind").collect()}
    assert sorted((r.k, r.x) for r in out.table("b").collect()) == [(2, 6), (3, None)]
    assert told(out) == {"a": (1, 0), "b": (2, 0), "index": (4, 1)}  # the row of another kind is in the index alone
    stray = spark.createDataFrame([(9, "b", 1)], "k long, kind string, x long")
    stray.withColumn("part_", F.lit("b")).write.mode("append").partitionBy("part_").parquet(out.folder)
    assert told(out)["b"] == (3, 1)
    with pytest.raises(FileNotFoundError):
        Split(stray, ["b"], shared_folder(spark, "none")).table("b")


def test_dispositions_broadcast_no_table(spark):
    """Cases, decisions and texts take few bytes of disk for their rows and were built up on the driver: more than 2 MB of any
    of them as a broadcast is an error here."""
    n = 100_000
    cases, archive = (SnapshotTable(spark, shared_folder(spark, name), schema, ["case_id"]) for name, schema in (("cases", C.DECIDED), ("archive", C.ARCHIVED)))
    ids = spark.range(n).withColumnRenamed("id", "case_id")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in cases.types.fields[1:]]
    cases.apply(lambda old: ids.select("case_id", *none), 0)
    decided = ids.select("case_id", F.lit("true_positive").alias("disposition"), F.lit("a").alias("analyst"), F.lit(None).cast("string").alias("notes"), F.lit(T0).cast("timestamp_ntz").alias("at"))
    folder = shared_folder(spark, "decided")
    decided.write.parquet(folder)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")
    try:
        C.dispose(cases, archive, spark.read.parquet(folder), ids.withColumn("text", F.lit("t")), 1)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert archive.read().where("text = 't'").count() == cases.read().where("status = 'resolved'").count() == n
