"""The dedup against a count of all byte windows, and what becomes of it where the suffix order is broken."""

import hashlib
import os
import random
from collections import Counter

import pytest

import remitspark.llm.suffix_array as SA
from remitspark.llm.suffix_array import cut_repeats, deduplicated

SF = "/root/testdata/sf0.001"


def masks(texts, length):
    seen = Counter(w[i : i + length] for w in texts for i in range(len(w) - length + 1))
    for w in texts:
        gone = [False] * len(w)
        end = 0
        for s in range(len(w) - length + 1):
            if seen[w[s : s + length]] > 1:
                for k in range(max(s, end), s + length):
                    gone[k] = True
                end = s + length
        yield gone


def brute(rows, length=400):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), w, gone in zip(rows, texts, masks(texts, length)):
        spans = sum(g and not p for g, p in zip(gone, [False] + gone))
        out.append((i, len(w), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted([tuple(r)[:5] for r in deduplicated(df).collect()], key=str)


def test_passages(spark):
    """Bytes in repeats of 200 bytes from an anchor on: every repeat of 300 bytes is seen, nothing outside repeats is."""
    rows = made_rows()
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.n_passage for r in deduplicated(df).collect()}
    texts = [(t or "").encode() for _, t in rows]
    for k, (short, long) in enumerate(zip(masks(texts, 200), masks(texts, 300))):
        spans = sum(g and not p for g, p in zip(long, [False] + long))
        assert sum(long) - 100 * spans <= got[k] <= sum(short)
        assert got[k] > 0 or not spans


def made_rows():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    cut = lambda s, n: s.encode()[:n].decode("utf-8", "ignore")
    a399, a400, a401, b900 = (text(n).replace("é", "e") for n in (399, 400, 401, 900))
    a239, a240, a300 = (text(n).replace("é", "e") for n in (239, 240, 300))
    rows = [(i, text(rng.randint(0, 300)) + p + text(rng.randint(0, 300))) for i, p in enumerate([a399, a399, a400, a400, a401, a401, b900, b900, b900 + "|" + b900, b900[50:700], b900[100:520], b900[:450] + "x" + b900[450:], a239, a240, a300] * 2)]
    rows += [(50, None), (51, ""), (52, text(20)), (53, "a" * 2000), (54, "ab" * 700), (55, "b" * 399), (55, "b" * 399), (None, b900), (56, a400), (56, a400), (57, a399), (57, a399), (58, text(30000)), (59, cut("é" * 900, 1200))]
    # one passage with many left and right ends
    rows += [(100 + i, text(rng.randint(0, 9)) + b900[rng.randint(0, 40) : rng.randint(440, 900)] + rng.choice("xy") * rng.randint(0, 5) + text(rng.randint(0, 60))) for i in range(60)]
    return rows


def test_made_cases(spark):
    rows = made_rows()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, t string")
    assert run(df) == brute(rows)
    assert deduplicated(df.limit(0)).count() == 0


def test_ranges_that_end_inside_a_name(spark, monkeypatch):
    """Every range of the order holds a few suffixes only: intervals go on from range to range."""
    rows = made_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(SA, "in_order", lambda s: s.repartitionByRange(61, "seed", "x0", "x1", "x2").sortWithinPartitions("seed", "x0", "x1", "x2"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(df) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_the_order_decides(spark, monkeypatch):
    """With the sampled suffixes in another order the result is another."""
    rows = made_rows()
    monkeypatch.setattr(SA, "in_order", lambda s: s.orderBy("c1"))
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) != brute(rows)


def test_cut_texts(spark):
    """Each text without the bytes of windows that occur twice, at another length."""
    rows = made_rows()
    texts = [(t or "").encode() for _, t in rows]
    want = [None if t is None else bytes(c for c, g in zip(w, gone) if not g).decode("utf-8", "ignore") for (_, t), w, gone in zip(rows, texts, masks(texts, 240))]
    df = spark.createDataFrame([(i, t, k, None if t is None else len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, runs int, n_chars long")
    got = cut_repeats(df, 240).orderBy("runs").collect()
    assert [r.text for r in got] == want
    assert [r.n_chars for r in got] == [None if w is None else len(w) for w in want]
    assert cut_repeats(df.limit(0), 240).columns == df.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_given_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert run(df) == brute([(r.doc_id, r.text) for r in df.collect()])
