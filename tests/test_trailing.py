"""Trailing windows from stream state against counting by hand, with late rows and several batches."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from remitspark.sources.scratch import shared_folder
from remitspark.streaming import trailing as R

BEGAN = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "customer_id long, ts timestamp, amount decimal(18,2), discount decimal(18,5)"


def by_hand(batches, length, step, delay):
    """Closed windows and latest ones, batch by batch, by the rule: a row counts in windows not closed when it arrives."""
    held, closed, latest, mark, done = [], {}, [], 0, 0
    for rows in [*batches, []]:
        for c in {c for c, *_ in held}:
            own = [x for x in held if x[0] == c]
            for e in range(done // step * step + step, mark + 1, step):
                hit = [x for x in own if e - length <= x[1] < e]
                if hit:
                    closed[c, e] = (len(hit), sum(x[2] for x in hit))
        done = mark
        new = [x for x in rows if (x[1] // step) * step + length > mark // step * step]
        held += new
        for c in {x[0] for x in new}:
            e = (max(x[1] for x in held if x[0] == c) // step + 1) * step
            hit = [x for x in held if x[0] == c and e - length <= x[1] < e]
            latest.append((c, e, len(hit), sum(x[2] for x in hit)))
        if rows:
            mark = max(mark, max(x[1] for x in rows) - delay)
    return closed, sorted(latest)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_counting(spark, seed):
    rng = random.Random(seed)
    length, step, delay = 3600, 300, 600
    base = int(BEGAN.timestamp())
    batches, now = [], base
    for _ in range(4):
        rows = [(rng.randint(1, 4), now + rng.randint(0, 5000), rng.randint(1, 900)) for _ in range(rng.randint(5, 25))]
        rows += [(rng.randint(1, 5), now - rng.randint(0, 9000), 7) for _ in range(6)]  # late, some too late
        batches.append(rows)
        now += rng.choice([4000, 20_000])
    folder, at = tempfile.mkdtemp(), shared_folder(spark, "check")
    out = {}
    for k, rows in enumerate(batches):  # one run a batch: the state comes back from the checkpoint
        data = [(c, dt.datetime.fromtimestamp(t, dt.timezone.utc), a, 0) for c, t, a in rows]
        df = spark.createDataFrame([(c, t, a) for c, t, a, _ in data], "customer_id long, ts timestamp, cents long")
        df.select("customer_id", "ts", (F.col("cents") / 100).cast("decimal(18,2)").alias("amount"), F.lit(0).cast("decimal(18,5)").alias("discount")).coalesce(1).write.mode("append").parquet(folder)
        stream = R.trailing(spark.readStream.schema(SCHEMA).parquet(folder), length, step, f"{delay} seconds")
        with R.rocks(spark):
            q = stream.writeStream.outputMode("append").option("checkpointLocation", at).trigger(availableNow=True)
            q = q.foreachBatch(lambda d, b: out.setdefault(b, d.select("customer_id", "kind", F.unix_timestamp("window_end").alias("e"), "n", (F.col("amount") * 100).cast("long").alias("a")).collect())).start()
            q.awaitTermination()
    rows = [r for b in out.values() for r in b]
    closed, latest = by_hand(batches, length, step, delay)
    got = [(r.customer_id, r.e, r.n, r.a) for r in rows if r.kind == "closed"]
    assert len(got) == len({g[:2] for g in got})  # each window once
    assert {g[:2]: g[2:] for g in got} == closed
    assert sorted((r.customer_id, r.e, r.n, r.a) for r in rows if r.kind == "latest") == latest


def test_setting_comes_back(spark):
    before = spark.conf.get(R.STORE, None)
    with R.rocks(spark):
        assert "RocksDB" in spark.conf.get(R.STORE)
    assert spark.conf.get(R.STORE, None) == before
    with pytest.raises(ValueError):
        R.Trailing(100, 30)


@pytest.mark.parametrize("name, windows", [("str_04_sliding_24h", 288), ("str_05_sliding_7d", 336)])
def test_windows_still_open_at_the_end_count(spark, name, windows):
    """An event lies in every window over it, also where the input ends before the watermark closes them."""
    from remitspark import registry

    folder = tempfile.mkdtemp()
    at = lambda hours: (BEGAN + dt.timedelta(hours=hours)).replace(tzinfo=None)
    rows = [(1, at(0), 1, "click", 10.0, '{"k": 5}'), (2, at(700), 2, "click", 20.0, '{"k": 5}'), (3, at(719.9), 3, "click", 30.0, '{"k": 5}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    got = registry.queries()[name](spark, folder).groupBy("customer_id").agg(F.sum("windows"), F.sum("covered"), F.max("peak_n")).collect()
    assert sorted(map(tuple, got)) == [(c, windows, windows, 1) for c in (1, 2, 3)]


def test_closed_and_open_are_all_windows(spark):
    rng = random.Random(3)
    length, step, base = 3600, 300, int(BEGAN.timestamp())
    rows = [(rng.randint(1, 4), base + rng.randint(0, 20_000), rng.randint(1, 900)) for _ in range(80)]
    folder, at = tempfile.mkdtemp(), shared_folder(spark, "check")
    df = spark.createDataFrame([(c, dt.datetime.fromtimestamp(t, dt.timezone.utc), a) for c, t, a in rows], "customer_id long, ts timestamp, cents long")
    df.select("customer_id", "ts", (F.col("cents") / 100).cast("decimal(18,2)").alias("amount"), F.lit(0).cast("decimal(18,5)").alias("discount")).coalesce(1).write.mode("append").parquet(folder)
    found = []
    with R.rocks(spark):
        q = R.trailing(spark.readStream.schema(SCHEMA).parquet(folder), length, step, "600 seconds").writeStream.option("checkpointLocation", at).trigger(availableNow=True)
        q.foreachBatch(lambda d, b: found.extend(d.where("kind = 'closed'").collect())).start().awaitTermination()
        rest = R.still_open(spark, at, length, step).collect()
    assert found and rest and {r.kind for r in rest} == {"open"}
    got = [(r.customer_id, int(r.window_end.timestamp()), r.n, int(r.amount * 100)) for r in found + rest]
    want = []
    for c in range(1, 5):
        for e in range(base + step, base + 20_000 + length + step, step):
            hit = [x for x in rows if x[0] == c and e - length <= x[1] < e]
            want += [(c, e, len(hit), sum(x[2] for x in hit))] if hit else []
    assert sorted(got) == sorted(want)
