"""Connected components: right roots, and rounds that grow with the logarithm."""

import random

import pytest

import remitspark.llm.common as C


def run(spark, edges):
    scratch = C.Scratch(spark, "components")
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in C.components(df, scratch).collect()}
    return got, scratch.n


def brute(edges):
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            root[a] = a = root[root[a]]
        return a

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    return {a: find(a) for a in root}


@pytest.mark.parametrize("kind", ["ascending", "shuffled", "star", "trees", "odd"])
def test_components(spark, kind):
    rng = random.Random(kind)
    ids = list(range(1000))
    if kind == "shuffled":
        rng.shuffle(ids)
    edges = {
        "ascending": list(zip(ids, ids[1:])), "shuffled": list(zip(ids, ids[1:])),
        "star": [(50_000, i) for i in range(100_000)],
        "trees": [(i, rng.randint(max(0, i - 20), i)) for i in range(1, 2000) if i % 13],
        "odd": [(1, 1), (2, 3), (3, 2), (2, 3), (-5, 3), (9, 8)],
    }[kind]
    got, saves = run(spark, edges)
    assert got == brute(edges)
    assert saves <= {"ascending": 16, "shuffled": 50, "star": 10, "trees": 40, "odd": 12}[kind]


def test_no_edges(spark):
    assert run(spark, [(4, 4)])[0] == {}
