"""Both vector operators against brute force."""

import os

import numpy as np
import pytest

from remitspark.llm.additive_ann import nearest
from remitspark.llm.epsgrid import linked_vectors

SF = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(900, None, 1, "x"), (901, [0.0, 0.0, 0.0, 0.0], 1, "x"), (902, [1.0, nan, 0.0, 0.0], 1, "x"), (903, [1.0, inf, 0.0, 0.0], 1, "x"), (904, [1.0, None, 0.0, 0.0], 1, "x"),
            (905, [1.0, 2.0, 3.0, 4.0], None, "x"), (906, [1.0, 2.0], 1, "x"), (907, [2.0, 4.0], 1, "x"), (950, [1.0, 2.0, 3.0, 4.0], 1, "x"), (950, [1.0, 2.0, 3.0, 4.0], 1, "x"), (951, [2.0, 4.0, 6.0, 8.0], 1, "x"),
            (952, [1.0, 2.0, 3.0, 4.0], 2, "x"), (None, [1.0, 2.0, 3.0, 4.1], 1, "x")]


def good(e):
    return e is not None and all(x is not None and np.isfinite(x) for x in e) and any(x != 0 for x in e)


def cos(a, b):
    a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def brute_links(rows, least=0.98):
    n, out = len(rows), []
    near = [[j for j in range(n) if j != i and rows[i][2] is not None and rows[i][2] == rows[j][2] and good(rows[i][1]) and good(rows[j][1]) and len(rows[i][1]) == len(rows[j][1]) and cos(rows[i][1], rows[j][1]) >= least] for i in range(n)]
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), c, rows[i][0] == c))
    return sorted(out, key=str)


def test_links_made_cases(spark, monkeypatch):
    import remitspark.llm.epsgrid as g

    monkeypatch.setattr(g, "BLOCK", 8)
    monkeypatch.setattr(g, "FAN", 2)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 4))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(size=4) * rng.choice([0.02, 0.2])], int(i % 3), "x") for i in range(240)]
    rows += odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted([tuple(r) for r in linked_vectors(df).collect()], key=str) == brute_links(rows)
    assert linked_vectors(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_links_given_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    t = df.toPandas()
    x = np.array(t.embedding.tolist(), float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    link = (x @ x.T >= 0.98) & (t.label.to_numpy()[:, None] == t.label.to_numpy()[None, :])
    np.fill_diagonal(link, False)
    got = linked_vectors(df).toPandas().set_index("vec_id").loc[t.vec_id]
    assert (got.n_links.to_numpy() == link.sum(1)).all()
    root = t.vec_id.to_numpy().copy()
    while True:
        new = np.array([min(root[i], root[link[i]].min(initial=root[i])) for i in range(len(root))])
        if (new == root).all():
            break
        root = new
    assert (got.component_id.to_numpy() == root).all()


def test_nearest_made_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)], 1, "x") for i in range(120)] + odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in nearest(df, df.where("vec_id % 50 = 0"), 5, rerank=200).orderBy("query_id", "rank").collect()]
    want = []
    part = [r for r in rows if good(r[1]) and len(r[1]) == 4]
    for q in sorted({r[0]: r for r in part if r[0] is not None and r[0] % 50 == 0}.items()):
        best = sorted(((-cos(q[1][1], r[1]), r[0] if r[0] is not None else -(1 << 63), r[0]) for r in part if r[0] != q[0]), key=lambda x: x[:2])[:5]
        want += [(q[0], i + 1, b[2], -b[0]) for i, b in enumerate(best)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and any(g[0] == 950 for g in got)
    assert max(abs(g[3] - w[3]) for g, w in zip(got, want)) < 1e-12
    assert nearest(df.limit(0), df, 5).count() == 0
    assert nearest(df.where("vec_id < 3"), df.where("vec_id = 0"), 5).count() == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    t = df.toPandas()
    x = np.array(t.embedding.tolist(), float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    got = nearest(df, df.where("vec_id % 50 = 0"), 5).toPandas().groupby("query_id").vec_id.apply(set)
    ids, hits = t.vec_id.to_numpy(), 0
    for q in got.index:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        hits += len(set(ids[np.lexsort((ids, -s))[:5]].tolist()) & got[q])
    assert hits / (5 * len(got)) >= 0.9


def test_nearest_double_vectors_and_two_vectors_of_a_query(spark):
    """Scores are those of the vectors as given, far beyond single precision; each vector of a query has its own ranks."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6)) * 10.0 ** rng.integers(-200, 200, size=(60, 1))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(50, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id % 50 = 0"), 5, rerank=100).collect()
    assert sorted((r.query_id, r.rank) for r in got) == sorted([(0, k) for k in range(1, 6)] + [(50, k) for k in range(1, 6)] * 2)
    u = x / np.abs(x).max(1, keepdims=True)
    u /= np.sqrt((u * u).sum(1))[:, None]
    s = u @ u[0]
    s[0] = -9
    best = np.argsort(-s)[:5]
    mine = sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)
    assert [r.vec_id for r in mine] == best.tolist() and np.allclose([r.score for r in mine], s[best], rtol=0, atol=1e-12)


def test_dense_cell(spark, monkeypatch):
    """More different vectors in one cell of the grid than a block holds."""
    import remitspark.llm.epsgrid as g

    monkeypatch.setattr(g, "BLOCK", 4)
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in np.array([1.0, 1.0, 1.0]) + rng.normal(size=3) * 1e-4], 1, "x") for i in range(90)]
    rows += [(100, [1.0, 0.0, 0.0], 1, "x"), (101, [0.98, (1 - 0.98**2) ** 0.5, 0.0], 1, "x"), (102, [0.97999, 0.2, 0.0], 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    t = {r.vec_id: r for r in linked_vectors(df).collect()}
    assert all(t[i].n_links == 89 and t[i].component_id == 0 for i in range(90))
    x = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in rows[90:]}
    near = {i: sum(j != i and x[i] @ x[j] >= 0.98 for j in x) for i in x}
    assert {i: t[i].n_links for i in x} == near


def test_more_copies_than_the_pool(spark):
    """Of more equal vectors than are reranked, those with the smallest ids are the nearest."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100, 140)] + [(i, [float(i), 1.0, -1.0]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = [(r.rank, r.vec_id) for r in nearest(df, df.where("vec_id = 100"), 5, rerank=10, pool=10).orderBy("rank").collect()]
    assert got == list(enumerate(range(101, 106), 1))


def all_nearest(x, k=5):
    """(query, rank, row) by brute force, ties to the smaller row."""
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    out = []
    for q in range(0, len(x), 50):
        s = u @ u[q]
        s[q] = -9
        out += [(q, r, int(j)) for r, j in enumerate(np.lexsort((np.arange(len(x)), -s))[:k], 1)]
    return out


@pytest.mark.parametrize("rows", ["no structure", "tight clusters", "one direction"])
def test_nearest_where_codes_tell_little(spark, rows, monkeypatch):
    """The true neighbours are found on rows that the codes approximate badly or cannot tell apart, over several shards."""
    import remitspark.llm.additive_ann as a

    monkeypatch.setattr(a, "SHARD", 700)
    rng = np.random.default_rng(17)
    x = rng.normal(size=(2000, 48))
    if rows == "tight clusters":
        x = rng.normal(size=(4, 48))[rng.integers(4, size=2000)] + 1e-3 * x
    elif rows == "one direction":
        x = 10 + 0.1 * x
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for pool in (a.POOL, 10_000):  # what the codes leave, by a matrix product or pair by pair
        got = [(r.query_id, r.rank, r.vec_id) for r in nearest(df, df.where("vec_id % 50 = 0"), 5, rerank=10, pool=pool).orderBy("query_id", "rank").collect()]
        assert got == all_nearest(x)


def test_nearest_vectors_without_an_id(spark):
    """A vector without vec_id takes nothing from the precision of other ids."""
    big = (1 << 53) + 1
    df = spark.createDataFrame([(50, [1.0, 0.0]), (None, [1.0, 0.1]), (big, [1.0, 0.2]), (big + 2, [1.0, 0.3])], "vec_id long, embedding array<double>").coalesce(1)
    assert [r.vec_id for r in nearest(df, df.where("vec_id = 50"), 5).orderBy("rank").collect()] == [None, big, big + 2]


def test_sample_is_picked_before_it_is_ordered(spark, monkeypatch, tmp_path):
    """The sample is the first by hash, and partitions hand on hardly more than it, however many there are."""
    from pyspark.sql import functions as F

    import remitspark.llm.additive_ann as a
    from remitspark.llm.common import Scratch

    monkeypatch.setattr(a, "SAMPLE", 50)
    t = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding")).repartition(16)
    want = sorted(r.vec_id for r in t.orderBy(F.xxhash64("vec_id")).limit(50).collect())
    scratch, kept = Scratch(spark, "ann"), []
    save = scratch.save
    monkeypatch.setattr(scratch, "save", lambda df: kept.append(save(df)) or kept[-1])
    got = a.sampled(t, 3000, scratch)
    assert sorted(int(r.embedding[0]) for r in got.collect()) == want
    assert kept[-2].count() <= 150  # 16 partitions' own first 50 would be 800
    same = t.select(F.lit(7).cast("long").alias("vec_id"), "embedding")  # one hash for all
    assert a.sampled(same, 3000, scratch).count() == 50 and a.sampled(t.limit(9), 9, scratch).count() == 9 and a.sampled(t.where("false"), 0, scratch).count() == 0


def test_queries_are_not_shuffled_once_a_shard(spark, monkeypatch):
    import remitspark.llm.additive_ann as a

    plans, whole = [], a.candidates
    monkeypatch.setattr(a, "SHARD", 100)
    monkeypatch.setattr(a, "candidates", lambda *x: plans.append(whole(*x)) or plans[-1])
    x = np.random.default_rng(5).normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in nearest(df, df.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()]
    assert got == all_nearest(x)
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
