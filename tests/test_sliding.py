"""Sliding windows batch by batch against counting by hand, with late rows, a batch run twice and another start."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from remitspark.sources.scratch import shared_folder
from remitspark.streaming.sliding import RUNS, Sliding, number
from tests.test_trailing import BEGAN, by_hand


def events(spark, rows):
    df = spark.createDataFrame([(c, dt.datetime.fromtimestamp(t, dt.timezone.utc), a) for c, t, a in rows], "customer_id long, ts timestamp, cents long")
    return df.select("customer_id", "ts", (F.col("cents") / 100).cast("decimal(18,2)").alias("amount"), F.lit(0).cast("decimal(18,5)").alias("discount")).coalesce(1)


def told(w, runs):
    return sorted((r.customer_id, int(r.window_end.timestamp()), r.n, int(r.amount * 100)) for r in w.each_window(runs).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_counting(spark, seed):
    rng = random.Random(seed)
    length, step, delay = 3600, 300, 600
    batches, now = [], int(BEGAN.timestamp())
    for _ in range(3):
        rows = [(rng.randint(1, 4), now + rng.randint(0, 5000), rng.randint(1, 900)) for _ in range(rng.randint(5, 25))]
        rows += [(rng.randint(1, 5), now - rng.randint(0, 9000), 7) for _ in range(6)]  # late, some too late
        batches.append(rows)
        now += rng.choice([4000, 20_000])
    base, latest = shared_folder(spark, "check"), []
    for k, rows in enumerate(batches):
        w = Sliding(spark, base, length, step, delay)  # another start: all that is known is in its tables
        for _ in range(1 + (k == 1)):
            w.apply(events(spark, rows), k)
        latest += [(r.customer_id, int(r.last_end.timestamp()), r.n, int(r.amount * 100)) for r in w.latest().collect()]
    w.close()
    closed, want = by_hand(batches, length, step, delay)
    assert told(w, w.closed()) == sorted((*k, *x) for k, x in closed.items())
    assert sorted(latest) == want
    kept = {c: [] for c in range(1, 6)}
    mark = None
    for rows in batches:  # what is open at the end: windows over rows that were not too late
        for c, t, a in rows:
            kept[c] += [(t, a)] if mark is None or t // step * step + length > mark // step * step else []
        mark = max(mark or 0, max(t for _, t, _ in rows) - delay)
    rest = []
    for c, own in kept.items():
        for e in range(mark // step * step + step, mark + length + delay + step, step):
            hit = [a for t, a in own if e - length <= t < e]
            rest += [(c, e, len(hit), sum(hit))] if hit else []
    assert told(w, w.open()) == sorted(rest)


def test_windows_are_put_out_as_runs(spark):
    """An event of a day's windows each five minutes makes two rows at most, not 288, and they say the same as the windows."""
    base = int(BEGAN.timestamp())
    w = Sliding(spark, shared_folder(spark, "check"), 86400, 300, 600)
    w.apply(events(spark, [(1, base + 10, 5), (1, base + 40_000, 7), (None, base + 90_000, 9), (2, base + 400_000, 1)]), 0)
    w.close()
    runs = w.closed()
    assert spark.read.schema(RUNS).parquet(f"{w.base}/closed").count() <= 6
    assert {r.customer_id: r.c for r in runs.groupBy("customer_id").agg(F.sum(number(300)).alias("c")).collect()} == {1: 421, None: 288}
    each = w.each_window(runs).groupBy("customer_id", F.date_format("window_start", "yyyy-MM-dd").alias("day")).agg(F.count("*"), F.max("n"), F.sum("n"))
    cut = w.by_start_day(runs).groupBy("customer_id", "day").agg(F.sum("windows"), F.max("n"), F.sum(F.col("n") * F.col("windows")))
    assert sorted(map(str, map(tuple, cut.collect()))) == sorted(map(str, map(tuple, each.collect())))
    with pytest.raises(ValueError):
        Sliding(spark, w.base, 100, 30, 0)


def test_queries_keep_runs(spark, tmp_path, monkeypatch):
    """The queries go through runs: of three events none leaves more than two rows a table of windows."""
    from remitspark import registry

    rows = [(k, (BEGAN + dt.timedelta(hours=h)).replace(tzinfo=None), k, "click", 10.0, '{"k": 5}') for k, h in ((1, 0), (2, 700), (3, 719.9))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    made, whole = [], Sliding.__init__
    monkeypatch.setattr(Sliding, "__init__", lambda self, *a: made.append(self) or whole(self, *a))
    assert registry.queries()["str_01_hopping_5m"](spark, str(tmp_path)).count() == 30
    assert {(r.customer_id, r.txn_count_5m) for r in registry.queries()["fea_01_five_minute_features"](spark, str(tmp_path)).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert len(made) == 2
    for w in made:
        assert w.closed().count() + w.open().count() <= 6


def test_history_keeps_runs(spark, tmp_path, monkeypatch):
    """The history holds a closed window's run, its windows are counted whole."""
    from remitspark import registry

    at = lambda hours: (BEGAN + dt.timedelta(hours=hours)).replace(tzinfo=None)
    rows = [(k, at(h), k, "click", 10.0, '{"k": 5}') for k, h in ((1, 0), (2, 700))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    for t in ("customer", "nation", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    made, whole = [], Sliding.__init__
    monkeypatch.setattr(Sliding, "__init__", lambda self, *a: made.append(self) or whole(self, *a))
    got = {r.customer_id: (r.history_24h, r.history_7d, r.txn_count_24h, r.txn_count_7d) for r in registry.queries()["fea_02_window_history"](spark, str(tmp_path)).where("customer_id in (1, 2, 3)").collect()}
    assert got == {1: (288, 336, 1, 1), 2: (0, 0, 1, 1), 3: (0, 0, None, None)}
    assert len(made) == 2 and all(w.closed().count() == 1 for w in made)
