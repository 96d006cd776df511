"""Fingerprints against the definition, components against all pairs, edge cases."""

import os
import random
import re

import numpy as np
import pytest
import xxhash

from remitspark.llm.simhash import drop_near_duplicates, near_duplicates, simhash


def brute_print(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w.decode() for w in low.encode().split()]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, bits=4):
    fp = [brute_print(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            k = find(i)
            least[k] = min(least.get(k, r[0]), r[0])
    return sorted(((r[0], f"{fp[i]:016x}", least.get(find(i))) for i, r in enumerate(rows)), key=str)


def test_components(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 30, 300]))] for _ in range(30)]
    rows = []
    for i in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = "edit"
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w), "x"))
    rows += [(None, "quite another text without an id " * 9, "x"), (900, None, "x"), (901, "", "x"), (901, "", "x"), (None, "Ä A b", "x"), (902, "one", "x"), (903, "ONE", "x"), (904, "a " * 60000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, f"{np.uint64(np.int64(r.fp)):016x}", r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    assert near_duplicates(df.limit(0)).count() == 0
    kept = drop_near_duplicates(df, shingle=4)
    assert kept.columns == df.columns
    named = sorted({c for _, _, c in brute(rows) if c is not None})
    got_ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got_ids if i is not None) == named
    assert got_ids.count(None) == 2  # two unlike texts without an id


def test_definition():
    for t in ["", " ", "a", "a b c", "a b c d", "A B c d e", "é É x y z", "a\x1cb c d e"]:
        assert simhash(t) == brute_print(t)


def test_trie_join_with_every_budget(spark):
    """Planted flips of up to five bits, in dense clusters: links exactly up to four."""
    from remitspark.llm.simhash import links

    rng = random.Random(9)
    centre = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centre for _ in range(60)})
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    for clean in (1, 2):
        got = [(int(np.int64(r.u).astype(np.uint64)), int(np.int64(r.v).astype(np.uint64))) for r in links(df, 4, clean).collect()]
        parent = {f: f for f in fps}

        def find(a):
            while parent[a] != a:
                a = parent[a]
            return a

        for a, b in got:
            parent[find(a)] = find(b)
        want = {f: f for f in fps}

        def wfind(a):
            while want[a] != a:
                a = want[a]
            return a

        for i, a in enumerate(fps):
            for b in fps[:i]:
                if (a ^ b).bit_count() <= 4:
                    want[wfind(a)] = wfind(b)
        groups = lambda f: sorted(map(sorted, {find_all(f, x) for x in fps}))

        def find_all(f, x):
            return tuple(y for y in fps if f(y) == f(x))

        assert groups(find) == groups(wfind)


def test_query_on_given_table(spark):
    """The registered query against fingerprints and components made anew, by all pairs."""
    from remitspark.llm.simhash import op3_simhash_neardup

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]

    def fingerprint(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {i: fingerprint(t) for i, t in rows}
    every = np.array(sorted(set(fp.values())), np.uint64)
    root = np.arange(len(every))
    for a in range(len(every)):
        for b in np.flatnonzero(np.bitwise_count(every[:a] ^ every[a]) <= 4).tolist():
            if root[a] != root[b]:
                root[root == root[a]] = root[b]
    at = {int(f): int(root[k]) for k, f in enumerate(every)}
    least = {}
    for i, _ in rows:
        least[at[fp[i]]] = min(i, least.get(at[fp[i]], i))
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in op3_simhash_neardup(spark, sf).collect())
    assert got == sorted((i, f"{fp[i]:016x}", least[at[fp[i]]]) for i, _ in rows)
