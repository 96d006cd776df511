"""The pipeline's near-duplicate stage against brute-force Jaccard of five-word shingles."""

import random

import corpus_pipeline as P


def brute(rows, n=5, least=0.8):
    """Kept (doc_id, text) by all pairs."""

    def shingles(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())

    s, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if s[i] == s[j] or 10 * len(s[i] & s[j]) >= 8 * len(s[i] | s[j]) > 0:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return sorted((min((i for i in g if i is not None), default=None) for g in groups.values()), key=str)


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 40, 120, 400]))] for _ in range(40)]
    rows = []
    for i in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 4, 8, 12])):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 9)}"
        rows.append((i, rng.choice([" ", "\n"]).join(w), None, "s", 0))
    rows += [(None, "a text without an id " * 9, None, "s", 0), (None, None, None, "s", 0), (900, "", None, "s", 0), (900, "", None, "s", 0)]
    # one id on two unlike rows: both stay
    rows += [(901, " ".join(f"p{k}" for k in range(60)), None, "s", 0), (901, " ".join(f"q{k}" for k in range(60)), None, "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = P.simhash(spark, df, "")
    assert out.columns == df.columns
    got = sorted((r.doc_id for r in out.collect()), key=str)
    assert got == brute(rows)
    assert P.simhash(spark, df.limit(0), "").count() == 0


def test_dense_group():
    """Chains inside one candidate group: components as by all pairs."""
    import numpy as np

    from remitspark.llm.jaccard import linked

    rng = np.random.default_rng(3)
    sets = {tuple(sorted(set(range(60)) - set(rng.integers(0, 60, rng.integers(0, 14)).tolist()) | set(rng.integers(100, 400, rng.integers(0, 10)).tolist()))) for _ in range(250)}
    sets = [np.array(s, np.uint64) for s in sorted(sets)]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 10 * both >= 8 * (len(a) + len(b) - both) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    got = linked(sets)
    assert len(set(root)) > 1
    assert len(set(zip(root, got.tolist()))) == len(set(root)) == len(set(got.tolist()))


def test_one_id_on_unlike_texts(spark):
    from remitspark.llm.simhash import drop_near_duplicates

    rows = [(1, " ".join(f"{c}{k}" for k in range(60))) for c in "pqr"]
    assert drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 3


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    """A large group with several cores, chains between them, and sets that no core links: components as by all pairs."""
    import remitspark.llm.jaccard as J

    monkeypatch.setattr(J, "LARGE", 20)
    monkeypatch.setattr(J, "BLOCK", 7)
    rng = random.Random(12)
    core = [[f"w{rng.randint(0, 10**6)}" for _ in range(120)] for _ in range(3)]
    middle = core[0][:60] + core[1][60:]
    rows = []
    for i in range(150):
        w = list(rng.choice([*core, core[0], core[0], middle]))
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w), None, "s", 0))
    # one after the other loses words at its end: neighbours are alike, the ends are not
    rows += [(200 + k, " ".join(core[2][: 120 - 2 * k]), None, "s", 0) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id for r in P.simhash(spark, df, "").collect()), key=str) == brute(rows)
