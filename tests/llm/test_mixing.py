"""Targets against an iterative fill, taken words against the targets, edge cases."""

import re

import pytest

from remitspark.llm.mixing import mix, mixed_documents

COLS = "doc_id long, text string, source string, size string"


def brute_targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s] + 1e-9}
        if not over:
            out |= {s: level * w[s] for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def rows(n, seed=3):
    import random

    rng = random.Random(seed)
    names = ["b", "a", "Z", "é", None, "c", "zz"]
    out = [(i, " ".join(["w"] * rng.choice([1, 5, 40, 60, 200, 900])), rng.choice(names[:5] if i % 3 else ["a"]), "x") for i in range(n)]
    return out + [(None, None, "a", "x"), (7, "", None, None), (7, "", None, None), (8, "dup dup", "only", "s"), (8, "dup dup", "only", "s")]


@pytest.mark.parametrize("n", [60, 3000])
def test_targets_and_taken(spark, n):
    data = rows(n)
    df = spark.createDataFrame(data, COLS)
    got = mix(df).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, t, s, _ in data:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    biggest = 900
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.005 * want[s], biggest / 2), (s, taken[s], want[s])
    again = mix(df.repartition(5)).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again) == sorted((str(r.doc_id), r.size, r.taken) for r in got)


def test_copies_and_empty(spark):
    df = spark.createDataFrame(rows(50), COLS)
    m = mixed_documents(df)
    assert m.columns == df.columns
    words = sum(len((r.text or "").split()) for r in m.collect())
    assert words == sum(r.taken for r in mix(df.drop("size")).collect())
    assert mixed_documents(df.limit(0)).count() == 0


def test_inclusion_follows_probability(spark):
    """Over many seeds a document is taken as often as its class's expected copies."""
    df = spark.createDataFrame([(i, " ".join(["w"] * (10 if i % 2 else 100)), "s" if i < 40 else "t", "") for i in range(60)], COLS)
    total = {}
    for seed in range(12):
        for r in mix(df, weights=(1.0, 8.0), seed=seed).collect():
            if r.source == "s":
                total[r.size] = total.get(r.size, 0) + r.copies
    assert total[100] > 1.3 * total[10] > 0
