"""The manifest against a plain tree in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from remitspark.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, place int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(r, more=0):
    n = r["n_chars"]
    return H(*map(field, (r["doc_id"], r["source"], r["lang"], None if n is None else n + more, r["text"])))


def tree(nodes):
    """Root, and of each node the siblings with their side."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, a in enumerate(at):
            b = a ^ 1
            paths[k].append(None if b >= len(nodes) else (a % 2, nodes[b]))
        nodes, at = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [a // 2 for a in at]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in names}
    root, tops = tree([trees[g][0] for g in names]) if names else (None, [])
    out = []
    for g, top in zip(names, tops):
        for r, path in zip(groups[g], trees[g][1]):
            path = path + top
            h = leaf(r, int(r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0))
            for s in path:
                h = H(h) if s is None else H(s[1], h) if s[0] else H(h, s[1])
            out.append((r["doc_id"], leaf(r), trees[g][0], root, H(*[s[1] for s in path if s]), h, h == root))
    return sorted(out, key=str)


def result(df):
    docs = M.documents_manifest(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in docs.collect()), key=str)


def made(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 1) for r in rows], SCHEMA)


def row(i, lang, text="t", source="s", n=1):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": n}


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (2, 1, 3), (5, 8, 16, 1), (33, 0, 7)])
def test_small_trees(spark, monkeypatch, sizes):
    """Blocks of four, so that several rounds are needed."""
    monkeypatch.setattr(M, "LEVELS", 2)
    monkeypatch.setattr(M, "BLOCK", 4)
    rows = [row(10 * i + 1, f"l{k}", f"text {i}", n=i) for k, n in enumerate(sizes) for i in range(n)]
    got = result(made(spark, rows).repartition(3))
    assert got == brute(rows)
    assert any(not r[6] for r in got) == any(zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 for r in rows)


def test_odd_rows(spark):
    """Nulls in every column, repeated rows, empty and long texts, many rows of one doc_id, the largest n_chars."""
    rows = [row(None, None, None, None, None), row(None, "a", "", "", 0), row(7, None), row(7, ""), row(3, "a", "é" * 100_000), row(3, "a", "x", None, None), row(14, "ü", "y", "-", 2**63 - 1)]
    rows += [row(5, "a")] * 600 + [row(k, "b") for k in range(700)]
    assert result(made(spark, rows).repartition(5)) == brute(rows)


def test_empty(spark):
    assert result(made(spark, [])) == []


def test_general(spark):
    """Another key and order, and a path that folds to the root."""
    df = spark.range(50).select((F.col("id") % 3).alias("part"), (-F.col("id")).alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit("kept").alias("note"))
    t = M.manifest(df, "part", ["at"])
    assert t.columns == ["part", "at", "leaf", "note", "subroot", "root", "path"]
    assert t.where(M.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == 50
    for g in range(3):
        ids = sorted((-i for i in range(50) if i % 3 == g))
        assert t.where(f"part = {g}").first().subroot == tree([H(str(-i)) for i in ids])[0]
