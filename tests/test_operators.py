"""Hand-valued cases of the operators: rules, drift, cases, as-of joins, sinks and late rows."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from remitspark.functions import stats as S
from remitspark.operators import cases as C
from remitspark.operators import drift as K
from remitspark.operators import forest, rules
from remitspark.operators.joins import as_of_join, cycle_join
from remitspark.operators.search import Search, SearchOrderError
from remitspark.streaming import tables as T
from remitspark.streaming import windows as N

T0 = dt.datetime(2026, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def txns(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "transaction_id long, customer_id long, merchant_id string, ts timestamp_ntz, amount double")


def test_velocity(spark):
    rows = [(1, "m", at(i * 50), 10.0) for i in range(6)]
    hits = rules.velocity_anomaly(txns(spark, rows), F.lit(at(300)).cast("timestamp_ntz"), 300, 5)
    assert [r.n for r in hits.collect()] == [6]
    assert rules.velocity_anomaly(txns(spark, rows[:5]), F.lit(at(300)).cast("timestamp_ntz"), 300, 5).count() == 0


def test_outlier(spark):
    same = [(1, "m", at(i), 100.0) for i in range(10)]
    assert [r.transaction_id for r in rules.amount_outlier(txns(spark, same + [(1, "m", at(11), 101.0)])).collect()] == [10]
    assert rules.amount_outlier(txns(spark, same[:9] + [(1, "m", at(11), 1000.0)])).count() == 0


def test_duplicate_and_geography(spark):
    def pair(gap):
        return txns(spark, [(1, "m", at(0), 5.0), (1, "m", at(gap), 5.0)])

    assert rules.duplicate_transaction(pair(60)).count() == 1
    assert rules.duplicate_transaction(pair(61)).count() == 0
    g = spark.createDataFrame([(1, "A", None), (2, "A", "A"), (3, None, "A"), (4, "B", "A")], "transaction_id long, txn_state string, home_state string")
    assert sorted(r.transaction_id for r in rules.geographic_anomaly(g).collect()) == [1, 4]
    with pytest.raises(KeyError):
        rules.run_rules(g, [rules.Rule("nonsense")])


def test_split_and_proration(spark):
    e = spark.createDataFrame([(1, "addon_charge", None, 5.0, 10.0), (2, "addon_charge", 5.0, 5.2, 10.0), (3, "addon_charge", 5.0, 6.0, 10.0), (4, "refund", None, None, 1.0)], "transaction_id long, txn_type string, earned double, unearned double, gross double")
    assert sorted(r.transaction_id for r in rules.unearned_earned_segregation(e).collect()) == [1, 3]
    p = spark.createDataFrame([(1, True, 106.0, 100.0), (2, True, 104.0, 100.0), (3, True, None, 100.0), (4, False, None, None)], "transaction_id long, mid_cycle boolean, proration double, expected_proration double")
    assert sorted(r.transaction_id for r in rules.proration_check(p).collect()) == [1, 3]


def test_ks(spark):
    rng = random.Random(1)
    a = [rng.gauss(50, 5) for _ in range(300)]
    rows = [("same", x, c) for x in a for c in (True, False)] + [("shift", x, False) for x in a] + [("shift", x + 20, True) for x in a] + [("alone", x, True) for x in a]
    got = {r.feature: r for r in K.ks_statistic(spark.createDataFrame(rows, "feature string, value double, is_current boolean")).withColumn("p", K.ks_p_value(F.col("d"), F.col("n_current").cast("double"), F.col("n_baseline").cast("double"))).collect()}
    assert got["same"].d == 0 and got["same"].p == 1
    assert got["shift"].d >= 0.4 and got["shift"].p < 1e-6
    assert got["alone"].d == 0


def test_priority_and_sla(spark):
    df = spark.createDataFrame([("critical", 10000.0, 5, True), ("low", 0.0, 0, False), ("medium", 2500.0, 3, False)], "severity string, amount double, prior int, com boolean")
    got = df.select(C.priority_score("severity", F.col("amount"), F.col("prior"), F.col("com")).alias("s")).withColumn("b", C.priority_band(F.col("s"))).collect()
    assert [(r.s, r.b) for r in got] == [(1.0, "P0"), (0.1375, "P3"), (0.485, "P2")]
    stake, net = C.revenue_impact(F.lit(1000.0), F.col("severity"))
    assert [(r.a, r.b) for r in df.select(stake.alias("a"), net.alias("b")).collect()] == [(800.0, 788.0), (500.0, 488.0), (500.0, 488.0)]
    late = spark.createDataFrame([(at(0), at(-5)), (at(0), None)], "target timestamp_ntz, breached timestamp_ntz").withColumns(C.sla_tick(F.lit(at(60)).cast("timestamp_ntz"), F.col("target"), F.col("breached")))
    assert [r.breached_at for r in late.collect()] == [at(-5), at(60)]


def test_quantiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)], "x double")
    pick = lambda p, c: S.nearest_rank(df, "x", [], p, c, "q").first().q
    assert pick(0.5, "truncated") == 3 and pick(0.95, "ceiling") == 100 and pick(0.5, "live") == 2 and pick(0.5, "nearest") == 3


def test_as_of_is_inclusive(spark):
    labels = spark.createDataFrame([(1, at(420), 0, "x"), (1, at(300), 1, "y"), (1, at(-60), 2, "z"), (2, at(0), 3, "w")], "customer_id long, label_at timestamp_ntz, row_id long, tag string")
    w = spark.createDataFrame([(1, at(0), 10), (1, at(300), 20), (1, at(600), 30)], "customer_id long, window_end timestamp_ntz, n long")
    got = as_of_join(labels, w, ["customer_id"], "label_at", "window_end", ["n"], "inner").collect()
    assert sorted((r.row_id, r.n) for r in got) == [(0, 20), (1, 20)]
    assert as_of_join(labels, w, ["customer_id"], "label_at", "window_end", ["n"]).count() == 4


def test_cycle_join(spark):
    t = spark.createDataFrame([(1, dt.datetime(2026, 1, 31, 23)), (1, dt.datetime(2026, 2, 1)), (2, dt.datetime(2026, 1, 5))], "customer_id long, ts timestamp_ntz")
    c = spark.createDataFrame([(1, dt.datetime(2026, 1, 15), dt.datetime(2026, 2, 1), "a"), (1, dt.datetime(2026, 2, 1), dt.datetime(2026, 3, 1), "b")], "customer_id long, cycle_start timestamp_ntz, cycle_end timestamp_ntz, cycle string")
    assert sorted(r.cycle for r in cycle_join(t, c).collect()) == ["a", "b"]


@pytest.mark.parametrize("keys", [None, ["k"]])
def test_sinks_apply_a_batch_once(spark, keys):
    table = T.SnapshotTable(spark, "file://" + tempfile.mkdtemp(prefix="spark-table-"), "k long, a string, n long", keys)
    row = lambda *r: spark.createDataFrame([r], "k long, a string, n long")
    assert table.apply(lambda old: row(1, "x", 1), 0)
    assert table.apply(T.upsert(row(1, None, 5), ["k"]), 1)
    assert not table.apply(T.upsert(row(1, "lost", 9), ["k"]), 1)  # a replay
    assert table.read().collect() == [(1, "x", 5)]
    table.apply(T.keep_first(row(1, "other", 7).union(row(2, "new", 8)), ["k"]), 2)
    assert sorted(map(tuple, table.read().collect())) == [(1, "x", 5), (2, "new", 8)]
    table.apply(T.update_latest(row(2, "late", 3).union(row(2, "later", 4)).union(row(9, "unknown", 1)), ["k"], "n"), 3)
    assert sorted(map(tuple, table.read().collect())) == [(1, "x", 5), (2, "later", 4)]
    table.apply(T.accumulate(row(1, "x", 2), ["k", "a"], ["n"], [], []), 4)
    assert sorted(map(tuple, table.read().collect())) == [(1, "x", 7), (2, "later", 4)]


def test_a_batch_rewrites_only_its_parts(spark):
    table = T.SnapshotTable(spark, "file://" + tempfile.mkdtemp(prefix="spark-table-"), "k long, n long", ["k"], parts=4)
    table.apply(lambda old: spark.range(100).selectExpr("id as k", "id as n"), 0)
    before = table._state()[1]["parts"]
    assert table.apply(T.upsert(spark.createDataFrame([(7, 700)], "k int, n long"), ["k"]), 1)
    after = table._state()[1]["parts"]
    assert len(before) == 4 and sum(before[p] != after[p] for p in before) == 1
    assert {r.k: r.n for r in table.read().collect()} == {k: 700 if k == 7 else k for k in range(100)}
    # writers have batches of their own
    assert table.apply(T.upsert(spark.createDataFrame([(8, 800)], "k long, n long"), ["k"]), 1, "other")
    assert not table.apply(T.upsert(spark.createDataFrame([(8, 801)], "k long, n long"), ["k"]), 1, "other")
    assert table.read().where("n >= 700").count() == 2


def test_versions_of_tables(spark):
    """A draft of a dead writer is not seen; of two writers of a version the second fails."""
    table = T.SnapshotTable(spark, "file://" + tempfile.mkdtemp(prefix="spark-table-"), "k long", ["k"])
    table.apply(lambda old: spark.range(3).selectExpr("id as k"), 0)
    table.fs.create(table.path(f"{table.base}/versions/draft-dead"), False).close()
    v, state = table._state()
    assert v == 1 and table.read().count() == 3
    with pytest.raises(T.Conflict):
        table._publish(1, state)
    assert table.read().count() == 3 and table.apply(T.keep_first(spark.range(5).selectExpr("id as k"), ["k"]), 1) and table.read().count() == 5


def test_retention_drops_whole_days(spark):
    day = lambda d, h: dt.datetime(2026, 1, d, h)
    table = T.SnapshotTable(spark, "file://" + tempfile.mkdtemp(prefix="spark-table-"), "k long, ts timestamp_ntz", day="ts")
    rows = [(k, day(d, h)) for k, (d, h) in enumerate([(1, 5), (2, 5), (3, 5), (3, 18), (4, 1), (9, 3)])] + [(99, None)]
    table.apply(lambda old: spark.createDataFrame(rows, "k long, ts timestamp_ntz"), 0)
    before = table._state()[1]["parts"]
    table.apply(T.retain("2026-01-10 12:00:00", "ts", 7), 1)
    after = table._state()[1]["parts"]
    assert sorted(r.k for r in table.read().collect()) == [3, 4, 5]
    assert sorted(after) == ["2026-01-03", "2026-01-04", "2026-01-09"]
    assert [after[d] == before[d] for d in sorted(after)] == [False, True, True]


def test_sinks_do_not_hinge_on_row_order(spark):
    rows = [(1, "b", 2), (1, "a", 2), (1, "c", 1), (2, None, 5), (2, "z", 5)]
    got = set()
    for order in (rows, rows[::-1]):
        new = spark.createDataFrame(order, "k long, a string, n long").repartition(1)
        old = spark.createDataFrame([(1, "x", 0), (2, "x", 0)], "k long, a string, n long")
        got.add(str(sorted(map(str, T.update_latest(new, ["k"], "n")(old).collect()))))
        got.add("first" + str(sorted(map(str, T.keep_first(new, ["k"])(old.limit(0)).collect()))))
    assert len(got) == 2


def test_replayed_stream_comes_in_order(spark):
    from remitspark.sources.streams import arrivals

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    seen = []
    from remitspark.sources.streams import raw_stream

    q = raw_stream(spark, sf).writeStream.foreachBatch(lambda df, b: seen.append(df.agg(F.min("ts"), F.max("ts"), F.count("*")).first())).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-ck-")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) > 1 and sum(r[2] for r in seen) == spark.read.parquet(f"{sf}/events.parquet").count()
    assert all(a[1] <= b[0] for a, b in zip(seen, seen[1:]))
    assert arrivals(spark, sf, "events", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", ["ts", "event_id"]).startswith("file:")


def test_rate_and_lag(spark):
    rows = [(i, at(i * 5), lag) for i, lag in enumerate([0, 3, -7, 61, 60, 12])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, lag long")
    w = {r.window_start: r for r in N.rate_and_lag(df, F.timestamp_seconds(F.unix_timestamp("ts") + F.col("lag")), "60 seconds", "60 seconds").collect()}
    r = w[at(0)]
    assert (r.n, r.rate, r.p50, r.p99) == (5, 5 / 60, 0, 12)  # lags 0 0 3 12 60: places 1 and 3


def test_hash_bucket_is_murmur3(spark):
    """Buckets by Spark's hash are those of 32-bit Murmur3 with seed 42 over the eight bytes of a long."""

    def murmur3(x):
        mask, h = 0xFFFFFFFF, 42
        rot = lambda v, r: ((v << r) | (v >> (32 - r))) & mask
        for word in (x & mask, x >> 32 & mask):
            k = rot(word * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
            h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & mask
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & mask
        h = (h ^ h >> 13) * 0xC2B2AE35 & mask
        h ^= h >> 16
        return h - (1 << 32) if h >> 31 else h

    ids = [0, 1, 2, 77, 10**12, -5, (1 << 62) + 3]
    got = spark.createDataFrame([(i,) for i in ids], "k long").select((F.abs(F.hash("k")) % 32).alias("b")).collect()
    assert [r.b for r in got] == [abs(murmur3(i & (1 << 64) - 1)) % 32 for i in ids]


def events(spark, rows, path):
    spark.createDataFrame(rows, "ts timestamp, customer_id long, merchant_id string, amount double, discount double").coalesce(1).write.mode("append").parquet(path)


def test_late_rows_and_equality_with_batch(spark):
    path, out = (tempfile.mkdtemp(prefix="spark-late-") for _ in range(2))
    schema = "ts timestamp, customer_id long, merchant_id string, amount double, discount double"
    events(spark, [(at(10), 1, "m", 1.0, 0.0), (at(4000), 1, "m", 2.0, 0.0)], path + "/in")
    ck = tempfile.mkdtemp(prefix="spark-ck-")

    def drain():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path + "/in").withWatermark("ts", "1 minute")
        q = N.windowed(s, "5 minutes", None, ["customer_id"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.n, r.amount) for r in spark.read.parquet(out).collect())

    assert drain() == [(1, 1.0)]
    events(spark, [(at(20), 1, "m", 50.0, 0.0), (at(9000), 1, "m", 4.0, 0.0)], path + "/in")  # the first is late
    assert drain() == [(1, 1.0), (1, 2.0)]
    assert drain() == [(1, 1.0), (1, 2.0)]  # nothing new, nothing again


def test_hopping_windows_share_one(spark):
    df = spark.createDataFrame([(at(10), 1, "m", 1.0, 0.0), (at(290), 1, "m", 1.0, 0.0)], "ts timestamp, customer_id long, merchant_id string, amount double, discount double")
    w = N.windowed(df, "5 minutes", "30 seconds", ["customer_id"]).collect()
    assert len(w) == 19 and [r.window_start for r in w if r.n == 2] == [at(0)]


def test_duplicate_minutes(spark):
    make = lambda s: spark.createDataFrame([(x, at(x), 1, "m", 5.0) for x in s], "event_id long, ts timestamp, customer_id long, merchant_id string, amount double")
    assert N.duplicate_cases(make([1, 20, 40])).count() == 1
    assert N.duplicate_cases(make([20, 40, 61])).count() == 0


def test_forest_finds_planted_outliers(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(600)] + [(900 + i, 9.0 + i, -9.0) for i in range(5)] + [(999, None, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    model = forest.fit(df, ["x", "y"], 60)
    top = forest.score(df, model, ["x", "y"]).orderBy(F.desc("model_score")).limit(5).collect()
    assert sorted(r.id for r in top) == [900, 901, 902, 903, 904]


def test_search_stages_have_an_order(spark):
    v = spark.createDataFrame([(1, [1.0], 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(SearchOrderError):
        Search(v).where(F.lit(True))
    with pytest.raises(SearchOrderError):
        Search(v).at_least(0.5)
    with pytest.raises(SearchOrderError):
        Search.merged(Search(v), Search(v))


def test_top_k_by_brute_force(spark, monkeypatch):
    import numpy as np

    from remitspark.operators import search

    monkeypatch.setattr(search, "SHARD", 16)
    monkeypatch.setattr(search, "BLOCK", 3)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 5))
    x[40] = x[41] = x[42]
    rows = [(i, [float(c) for c in r], i % 2) for i, r in enumerate(x)] + [(200, None, 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, side int")
    q = v.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for by in ((), ("side",)):
        got = {}
        for r in search.top_k(q, v, 4, by).orderBy("query_id", "place").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        for k in range(0, 90, 10):
            s = np.round(u @ u[k], 6)
            want = sorted(((-s[i], i) for i in range(90) if i != k and (not by or i % 2 == k % 2)))[:4]
            assert [i for i, _ in got[k]] == [i for _, i in want] and all(abs(a[1] + b[0]) < 1e-9 for a, b in zip(got[k], want))
        assert 200 not in got


def test_near_names_by_brute_force(spark):
    from remitspark.operators.search import completions, near_names

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    names = ["anna", "ann", "hanna", "anne", "nana", "aann", "", None, "anna", "b", "a", "xanna", "annx"]
    d = spark.createDataFrame(list(enumerate(names)), "customer_id long, name string")
    got = {(r.query_id, r.customer_id, r.distance) for r in near_names(d.withColumnRenamed("customer_id", "query_id"), d).collect()}
    want = {(i, j, apart(a, b)) for i, a in enumerate(names) for j, b in enumerate(names) if a and b and apart(a, b) <= 1}
    assert got == want
    typed = spark.createDataFrame([(1, "ann"), (2, "han"), (3, "zzz")], "query_id long, typed string")
    assert {(r.query_id, names[r.customer_id]) for r in completions(typed, d).collect()} == {(1, "anna"), (1, "ann"), (1, "anne"), (1, "annx"), (2, "hanna")}


def test_all_rule_types_dispatch(spark):
    """Ten types over one table: row rules name their transaction, grouped rules their group; shadow and disabled rules."""
    rows = [(i, 1, "m", at(i * 10), 10.0 if i < 12 else 900.0, 5.0, [], "termination_fee", "A", "B", [1, 2], [1], True, 9.0, None, 1.0, 1.0, True, None, 100.0, "CC_A" if i % 2 else "CC_B", 7) for i in range(13)]
    t = spark.createDataFrame(rows, "transaction_id long, customer_id long, merchant_id string, ts timestamp_ntz, amount double, discount double, promotions array<string>, txn_type string, txn_state string, home_state string, purchased array<bigint>, entitled array<bigint>, lock_in boolean, billed_delta double, earned double, unearned double, gross double, mid_cycle boolean, proration double, expected_proration double, charge_code string, product_ref long")
    t = t.withColumn("txn_type", F.when(F.col("transaction_id") == 3, "addon_charge").otherwise(F.col("txn_type")))
    now = F.lit(at(120)).cast("timestamp_ntz")
    params = {"velocity_anomaly": {"as_of": now}, "termination_fee_check": {"min_amount": 5}, "double_charge_multi_code": {"codes": ("CC_A", "CC_B")}, "duplicate_transaction": {"window_seconds": 200}}
    rule_set = [rules.Rule(k, params.get(k, {}), "shadow" if k == "proration_check" else "active") for k in rules.RULES] + [rules.Rule("geographic_anomaly", enabled=False)]
    got = {}
    for r in rules.run_rules(t, rule_set).collect():
        got.setdefault((r.rule_type, r.mode), []).append(r.transaction_id)
    assert {k for k, _ in got} == set(rules.RULES)
    assert got["velocity_anomaly", "active"] == got["double_charge_multi_code", "active"] == got["duplicate_transaction", "active"] == [None]
    assert got["amount_outlier", "active"] == [12] and got["unearned_earned_segregation", "active"] == [3]
    assert len(got["geographic_anomaly", "active"]) == 13 and len(got["proration_check", "shadow"]) == 13
    assert rules.run_rules(t, []).count() == 0
    back = rules.backtest(t, rules.Rule("amount_outlier"), 50).first()
    assert (back.hit_count, back.hit_rate, back.hits) == (1, 0.02, [12])


def test_lean_orders_read_no_lines(spark):
    from remitspark import registry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    for name in ("agg_01_group", "prj_01_rename_compute_drop", "top_02_most_recent", "rul_03_amount_outlier", "cyc_02_cycle_counters"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "lineitem" not in plan or name.startswith("prj"), name


def test_running_counts_in_ranges(spark):
    rng = random.Random(8)
    rows = [(g, float(rng.randint(0, 500)) if g != "one" else 4.0) for g in ("a", "b", "one") for _ in range(900)] + [("a", None), (None, 3.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    for r in S.ranked(df, "x", ["g"]).collect():
        mine = sorted(x for g, x in rows if g == r.g and x is not None)
        assert (r.first, r.last, r.n) == (mine.index(r.x) + 1, mine.index(r.x) + mine.count(r.x), len(mine))


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",), ("corpus_pipeline.py",), ()])
def test_entry_without_training_data_operators(gone):
    """The driver module imports, and lists the other queries, where the llm package, the pipeline file, or both are gone,
    or where a library that they need is."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tempfile.mkdtemp(prefix="spark-noop-") + "/r"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *gone))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200; e.oracle_sql(); " + ("" if gone == ("corpus_pipeline.py",) else "assert not any(k.startswith('op1_') for k in q); ") + "assert 'pipeline' not in q"
    if not gone:
        code = "import sys; sys.modules['remitspark.llm.seeds'] = None; " + code
    if not os.path.isdir(os.path.join(root, "remitspark", "llm")) and gone == ("corpus_pipeline.py",):
        return
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": copy}).returncode == 0
