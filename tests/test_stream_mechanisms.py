"""Streams against sequential replays: lookups that change, sinks that fail, cases in any order, counts by observation."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from remitspark.sources.scratch import shared_folder
from remitspark.streaming import consumer as C
from remitspark.streaming import fanout as O
from remitspark.streaming import lookups as L
from remitspark.streaming import mirror as M
from remitspark.streaming import tables as S

T0 = dt.datetime(2024, 1, 1)


def replay(changes):
    """Customers' cases by going through the changes one after the other."""
    live, lifetime = {}, {}
    for case, customer, _, kind, status, at in sorted(changes, key=lambda c: (c[0], c[2])):
        if kind == "insert":
            live[case] = [customer, at, status]
            lifetime[customer] = lifetime.get(customer, 0) + 1
        elif kind == "edit" and case in live:
            live[case][2] = status
        elif kind == "end":
            live.pop(case, None)
    out = {}
    for c in lifetime:
        mine = {k: v for k, v in live.items() if v[0] == c}
        newest = max(((v[1], k) for k, v in mine.items()), default=(None, None))[1]
        out[c] = (lifetime[c], len(mine), sum(v[2] == "under_review" for v in mine.values()), min(mine, default=None), newest)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mirror_is_a_replay(spark, seed):
    """Changes of a case shuffled over batches, one batch twice."""
    rng = random.Random(seed)
    changes = []
    for case in range(60):
        customer, first = rng.randint(1, 6), rng.choice([1, 1, 1, 3])
        changes.append((case, customer, first, "insert", "open", T0 + dt.timedelta(hours=rng.randint(0, 99))))
        for seq in range(1, rng.randint(2, 7)):
            if seq != first:
                kind = rng.choice(["edit", "edit", "end"])
                changes.append((case, customer, seq, kind, rng.choice(["open", "under_review"]) if kind == "edit" else "resolved", T0))
    rng.shuffle(changes)
    table = S.SnapshotTable(spark, shared_folder(spark, "mirror"), M.STATE, ["case_id"])
    each = M.mirrored(table)
    schema = "case_id long, customer_id long, seq long, kind string, status string, at timestamp_ntz"
    for k in range(4):
        df = spark.createDataFrame(changes[k::4], schema)
        each(df, k)
        each(df, k)
    got = {r.customer_id: (r.lifetime, r.open_cases, r.under_review, r.oldest, r.newest) for r in M.by_customer(table.read()).collect()}
    assert got == replay(changes)


def test_lookup_changes_between_batches(spark):
    table = S.SnapshotTable(spark, shared_folder(spark, "side"), "k long, v string", ["k"])
    got = {}
    each = L.enriched_by(L.Lookup(table), ["k"], ["v"], lambda df, b: got.__setitem__(b, sorted((r.k, r.v) for r in df.collect())))
    put = lambda rows, b: table.apply(S.replace_by_key(spark.createDataFrame(rows, "k long, v string"), ["k"]), b)
    events = spark.createDataFrame([(1,), (2,)], "k long")
    each(events, 0)
    put([(1, "old")], 0)
    each(events, 1)
    put([(1, "new"), (2, "two")], 1)
    each(events, 2)
    assert got == {0: [(1, None), (2, None)], 1: [(1, "old"), (2, None)], 2: [(1, "new"), (2, "two")]}
    got.clear()
    each(events, 1)  # replayed: sees what it saw
    assert got == {1: [(1, "old"), (2, None)]}


def test_one_sink_fails_and_all_go_on(spark):
    """Five sinks over three batches; one fails in its second batch, the rest stop, and a rerun loses and repeats nothing."""
    source = tempfile.mkdtemp()
    for k in range(3):
        spark.range(100 * k, 100 * k + 100).coalesce(1).write.mode("append").parquet(source)
    broken = {"yes": True}
    at = {n: (shared_folder(spark, "out"), shared_folder(spark, "check")) for n in "abcde"}

    def sink(name):
        out, check = at[name]

        def each(df, batch):
            if name == "c" and batch == 1 and broken["yes"]:
                raise RuntimeError("disk is full")
            df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

        w = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source).writeStream.queryName(name + out[-6:])
        w = w.option("checkpointLocation", check).trigger(availableNow=True)
        return (w.foreachBatch(each) if name in "abc" else w.format("parquet").option("path", out)).start

    with pytest.raises(O.SinkFailed) as e:
        O.run_together(spark, {n: sink(n) for n in at})
    assert list(e.value.failed) == ["c"] and "disk is full" in str(e.value)
    assert not [q for q in spark.streams.active if q.name and q.name[0] in "abcde"]
    broken["yes"] = False
    O.run_together(spark, {n: sink(n) for n in at})
    for out, _ in at.values():
        assert sorted(r.id for r in spark.read.schema("id long").parquet(out).collect()) == list(range(300))


def test_counts_survive_a_replay(spark):
    out = shared_folder(spark, "consumed")
    known = spark.createDataFrame([(1,), (2,)], "k long")
    each = C.consumed(spark, known, "k", F.col("v") >= 1, ["origin"], out)
    rows = [(1, 5.0, "f"), (1, 0.5, "f"), (2, None, "f"), (3, 9.0, "f"), (None, 2.0, None)]
    df = spark.createDataFrame(rows, "k long, v double, origin string")
    each(df, 0)
    each(df, 0)
    each(df.where("k = 3"), 1)
    each(df.limit(0), 2)
    assert tuple(C.totals(spark, out).first()) == (3, 2, 1, 5)
    assert C.ledger(spark, out).count() == 3
    assert spark.read.parquet(f"{out}/rows").count() == 6


def test_small_batches_rewrite_few_parts(spark):
    """A batch of 100 keys on a table of a million rows rewrites under a tenth of them."""
    table = S.SnapshotTable(spark, shared_folder(spark, "large"), "k long, v long", ["k"], part_rows=900)
    table.apply(lambda old: spark.range(1_000_000).select(F.col("id").alias("k"), F.lit(0).alias("v")), 0)
    few = spark.range(100).select((F.col("id") * 7919).alias("k"), F.lit(1).alias("v"))
    table.apply(S.upsert(few, ["k"]), 1)  # cuts the table anew
    before = set(table._state()[1]["parts"].values())
    table.apply(S.upsert(few.withColumn("v", F.lit(2)), ["k"]), 2)
    state = table._state()[1]
    moved = [p for p, f in state["parts"].items() if f not in before]
    assert len(state["parts"]) > 2000 and 0 < sum(state["rows"][p] for p in moved) < 100_000
    assert sum(state["rows"].values()) == 1_000_000 == table.read().count()
    assert [tuple(r) for r in table.read().groupBy("v").count().orderBy("v").collect()] == [(0, 999_900), (2, 100)]
