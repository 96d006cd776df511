"""The audit against counting by hand."""

import re
from collections import Counter, defaultdict

from remitspark.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, n int"


def brute(rows):
    docs = [(x or "", lang or "", source or "") for x, lang, source in rows]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in df[lang].items() if n >= 3]

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(f(p[s][t], whole[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, found, top in (("pair", pair, None), ("term", term, 200)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:top])]
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in D.audit(df).collect())


def made(spark, rows):
    return spark.createDataFrame([(k, *r, 0, "x", 1) for k, r in enumerate(rows)], SCHEMA)


ODD = [
    (None, None, None), ("", "", None), ("Foo, foo FOO. foo-bar", "en", "a"), ("foo bar baz Éa éa", "en", "a"), ("bar foo\x1cfoo\x85x", "en", "b"), ("BAR", "en", "b"), ("bar", "en", None),
    ("x y z", "de", "only"), ("x y", "de", "only"), ("x", "de", "only"), ("...", "fr", "p"), ("1 2 3", "fr", "q"), ("日本 語 日本", "en", "c"), ("日本 foo", "en", "c"), ("日本", "en", "a"), ("w " * 50_000 + "v" * 100_000, "en", "c"),
]


def test_odd_texts(spark):
    got = result(made(spark, ODD).repartition(3))
    assert got == brute(ODD)
    assert {r[2] for r in got} == {"pair", "term"}


def test_blocks(spark, monkeypatch):
    """Several blocks a task, repeated rows, more than 200 terms a group, ties."""
    import random

    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "abcdef" for c in "xyzuvw"]
    rows = [(" ".join(rng.choice(words[: 60 * (1 + s)]) + rng.choice(["", ".", ","]) for _ in range(rng.randint(0, 120))), rng.choice(["l", "m"]), f"s{s}") for s in range(5) for _ in range(25)]
    rows += [("same words here", "l", "s0")] * 40
    monkeypatch.setattr(D, "BLOCK_BYTES", 2000)
    assert result(made(spark, rows).repartition(3)) == brute(rows)


def test_empty(spark):
    assert result(made(spark, [])) == []


def test_large_counts(spark):
    """Shares of counts that 64 bits cannot multiply."""
    from pyspark.sql import functions as F

    n = spark.range(1).select(F.lit(10**13).alias("n"), F.lit(3 * 10**13).alias("t"), F.lit(10**6).alias("k"))
    assert n.select(D.share(F.col("n"), F.col("t"), F.col("k")).alias("p")).first().p == 1 + 10**9 * (10**13 + 1) // (3 * 10**13 + 10**6)


def test_each_chunk_once(spark):
    """A chunk of several blocks and tasks is one row when it is split into terms."""
    from remitspark.llm.common import Scratch

    texts, _ = D.named(made(spark, ODD * 3).repartition(4), Scratch(spark, "chunks"))
    rows = D.chunk_counts(texts).repartition("word").sortWithinPartitions("word").mapInArrow(D.whole_chunks, D.ROW)
    words = [bytes(r.word) for r in rows.collect()]
    assert len(words) == len(set(words)) == len({w for x, *_ in ODD for w in (x or "").encode().split()})


def test_sums_carry_over_batches(monkeypatch):
    """A word whose rows lie in many batches is one row, with all its counts and enough of its documents."""
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    rows, want = [], {}
    for w in (b"a", b"b", b"c" * 9):
        for _ in range(40 if w == b"b" else 3):
            counts = [(l, 10 * l + g, rng.randint(1, 9)) for l in range(2) for g in range(3) if rng.random() < 0.6]
            docs = [(l, rng.randint(0, 5)) for l in range(2) if rng.random() < 0.5]
            rows.append((w, np.array(counts, D.COUNT).tobytes(), np.array(docs, D.DOC).tobytes()))
            n, d = want.setdefault(w, (Counter(), defaultdict(set)))
            for l, g, k in counts:
                n[l, g] += k
            for l, x in docs:
                d[l].add(x)
    batches = [pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in zip(*rows[k : k + 2])], ["word", "counts", "docs"]) for k in range(0, len(rows), 2)]
    for held in (1, 300, 10**9):
        monkeypatch.setattr(D, "HELD", held)
        got = [r for b in D.whole_chunks(iter(batches)) for r in b.to_pylist()]
        assert [r["word"] for r in got] == list(want)
        for r in got:
            n, d = want[r["word"]]
            assert {(l, g): k for l, g, k in np.frombuffer(r["counts"], D.COUNT).tolist()} == n
            mine = defaultdict(set)
            for l, x in np.frombuffer(r["docs"], D.DOC).tolist():
                mine[l].add(x)
            assert {l: min(len(x), 3) for l, x in d.items()} == {l: len(x) for l, x in mine.items()} and all(mine[l] <= d[l] for l in mine)
