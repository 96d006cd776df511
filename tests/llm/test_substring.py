"""Against a brute-force count of all windows."""

import hashlib
import os
import random
from collections import Counter

import pytest

from remitspark.llm.substring import deduplicated

SF = "/root/testdata/sf0.01"


def brute(rows, length=35):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in texts for i in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s : s + length])] > 1:
                gone[s : s + length] = [True] * length
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted([tuple(r) for r in deduplicated(df).collect()], key=str)


def test_made_cases(spark):
    rng = random.Random(1)
    text = lambda n, k=400: " ".join(f"w{rng.randint(0, k)}" for _ in range(n))
    p34, p35, p90 = text(34), text(35), text(90)
    rows = [(i, f"{text(rng.randint(0, 50))} {p} {text(rng.randint(0, 50))}") for i, p in enumerate([p34, p34, p35, p35, p90, p90, p90 + " " + p90, " ".join(p90.split()[10:60])])]
    rows += [(50, None), (51, ""), (52, text(20)), (53, "a " * 300), (54, "a b " * 200), (55, "a " * 34), (55, "a " * 34), (None, p90), (56, p90), (56, p90), (57, p90.replace(" ", "\n\t")), (58, "x" * 50000), (59, text(30000, 10**9))]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, starts string")
    assert run(df) == brute(rows)
    assert deduplicated(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_given_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert run(df) == brute([(r.doc_id, r.text) for r in df.collect()])
