"""Near-duplicates by the Jaccard similarity of word-shingle sets, with SimHash as the first search.

Two texts link when their sets of shingles (as in ``simhash``: lower-cased ASCII, XXH64) have similarity ``least`` or
more. Candidates are pairs whose SimHash fingerprints differ in at most ``BITS`` bits, found by the trie join of
``simhash``, and, since a similarity of 0.8 may mean 16 bits, which no trie of 64 bits prunes, pairs that share a MinHash
band (``BANDS`` bands of ``ROWS`` values): a pair of similarity 0.8 shares a band
but for about 5 in a million, a pair of 0.3 in 3 of 100. Texts with equal sets count once. Sets that share a band are
chained to candidate groups, and inside a group every pair that can reach ``least`` is compared exactly, shortest
sets first and rarest shingles first, unless its two sides are linked already. A group of more than ``LARGE`` sets is
many tasks' work: all its sets are compared with one pivot first, and those that the pivot does not link, a few where
copies of one text make the group, meet all others block by block.

Cases: null and empty texts have the empty set and link with each other; a text of at most ``shingle`` words is one
shingle; repeated rows, repeated ids and null ids take part row by row; an empty table gives an empty result; extra
columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitspark.llm.common import Scratch, components, give_back, text_key
from remitspark.llm.simhash import fingerprint_links, fingerprint_of, shingle_hashes

BANDS, ROWS, BITS = 40, 6, 4
#: Most sets of a group that one task compares, and sets of a block of larger groups, about.
LARGE, BLOCK = 512, 256
_RNG = np.random.default_rng(42)
_A = (_RNG.integers(0, 1 << 31, BANDS * ROWS) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS).astype(np.uint32)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, shingle))


def bands(s: np.ndarray) -> list[int]:
    """One signed 64-bit key a band; an empty set has none."""
    from xxhash import xxh64_intdigest

    if not len(s):
        return []
    h, least = (s >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(h), 1024):
        v = np.multiply.outer(_A, h[k : k + 1024])
        v += _B[:, None]
        np.minimum(least, v.min(1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64).tolist()


def linked(sets: list[np.ndarray], least: float = 0.8) -> np.ndarray:
    """Component of each of the distinct, non-empty sets under links of similarity ``least`` or more."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    _, token, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    token, at = rank[token], np.concatenate([[0], np.cumsum(size)])
    mine = [np.sort(token[at[i] : at[i + 1]]) for i in range(n)]
    # two sets of that similarity share one of these rarest shingles
    lead = [m[: len(m) - int(np.ceil(least * len(m) - 1e-9)) + 1] for m in mine]
    owner, key = np.repeat(np.arange(n), [len(x) for x in lead]), np.concatenate(lead)
    by = np.argsort(key, kind="stable")
    owner, key = owner[by], key[by]
    root, members, mark = np.arange(n), {i: [i] for i in range(n)}, np.zeros(len(count), bool)
    for i in range(n):
        first, low = np.searchsorted(key, lead[i]), np.searchsorted(size, least * size[i] - 1e-9)
        found = []
        for a in first.tolist():
            # owners of a shingle ascend
            b = a
            while owner[b] < i and root[owner[b]] == root[i]:
                b += 1
            end = np.searchsorted(key, key[a], "right") if owner[b] < i else b
            o = owner[b:end]
            o = o[: np.searchsorted(o, i)]
            found.append(o[(o >= low) & (root[o] != root[i])])
        near = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        mark[mine[i]] = True
        step = 1
        while len(near):
            part, near = near[:step], near[step:]
            cut = np.concatenate([[0], np.cumsum(size[part])])
            both = np.add.reduceat(mark[np.concatenate([mine[j] for j in part])].astype(np.int64), cut[:-1])
            for j in part[both >= least * (size[i] + size[part] - both) - 1e-9].tolist():
                a, b = root[i], root[j]
                if a != b:
                    if len(members[a]) < len(members[b]):
                        a, b = b, a
                    root[members[b]] = a
                    members[a] += members.pop(b)
            near, step = near[root[near] != root[i]], min(2 * step, 256)
        mark[mine[i]] = False
    out = np.empty(n, np.int64)
    out[order] = root
    return out


def similar(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Per row: doc_id, tk and tn (the text's key), component (smallest set digest of its group)."""
    scratch = Scratch(docs.sparkSession, "jaccard")

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        for b in batches:
            hashes = [shingle_hashes(t, shingle) for t in b["text"]]
            sets = [np.unique(h) for h in hashes]
            fp = np.array([fingerprint_of(h) for h in hashes], np.uint64).view(np.int64)
            digest = np.array([xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "tk": b["tk"], "tn": b["tn"], "sd": digest, "fp": fp, "bands": [bands(s) for s in sets]})
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", *text_key(), "text")
    rows = scratch.save(keyed.mapInPandas(sketch, f"doc_id {kind}, tk long, tn int, sd long, fp long, bands array<long>"))
    # SimHash: of equal fingerprints and of linked ones, sets are chained by their smallest digest
    at = scratch.save(rows.groupBy("fp").agg(F.min("sd").alias("lo")))
    ends = fingerprint_links(at, BITS, scratch).join(at.select(F.col("fp").alias("u"), F.col("lo").alias("a")), "u").join(at.select(F.col("fp").alias("v"), F.col("lo").alias("b")), "v")
    near = ends.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(rows.select("fp", "sd").distinct().join(at, "fp").select(F.col("sd").alias("u"), F.col("lo").alias("v")))
    band = rows.select("sd", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.min("sd").alias("lo"), F.max("sd").alias("hi")).where("lo < hi").select("band", "lo")
    alike = band.join(scratch.save(shared), "band").select(F.col("sd").alias("u"), F.col("lo").alias("v"))
    found = components(alike.unionByName(scratch.save(near)), scratch)
    found = scratch.save(found.select(F.col("node").alias("sd"), F.col("root").alias("g")))
    one = rows.join(found, "sd").groupBy("sd", "g").agg(F.min(F.struct("tk", "tn")).alias("t")).select("g", "sd", "t.tk", "t.tn")
    texts = keyed.groupBy("tk", "tn").agg(F.first("text").alias("text")).join(scratch.save(one), ["tk", "tn"])

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"g": b["g"], "sd": b["sd"], "s": [shingle_set(t, shingle).view(np.int64) for t in b["text"]]})
        give_back()

    sets = scratch.save(texts.select("g", "sd", "text").mapInPandas(shingles, "g long, sd long, s array<long>"))
    groups = scratch.save(confirmed(sets, least, scratch))
    return rows.join(groups, "sd", "left").select("doc_id", "tk", "tn", F.coalesce("component", "sd").alias("component"))


def forest(sd: np.ndarray, sets: list, least: float) -> pd.DataFrame:
    """(sd, component) of distinct sets: the smallest digest that a set is linked with."""
    c = linked([np.asarray(x).view(np.uint64) for x in sets], least)
    return pd.DataFrame({"sd": sd, "component": pd.Series(sd).groupby(c).transform("min").to_numpy()})


def held_sets(rows: pa.StructArray) -> list[tuple[int, np.ndarray]]:
    """(sd, s) of Arrow structs; the sets stay views of the batch, no Python number is made of a hash."""
    sd, s = rows.flatten()
    ends = np.cumsum(s.value_lengths().to_numpy())
    return list(zip(sd.to_pylist(), np.split(s.flatten().to_numpy(), ends[:-1])))


def confirmed(sets: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(sd, component) of sets(g, sd, s) under links of similarity ``least`` or more inside groups."""
    size = sets.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx(F.size("s"), 0.5).alias("mid"))
    size = scratch.save(size)
    few = sets.join(size.where(F.col("n") <= LARGE).select("g"), "g")
    out = few.groupBy("g").applyInPandas(lambda p: forest(p["sd"].to_numpy(), p["s"].tolist(), least), "sd long, component long")
    large = scratch.save(sets.join(size.where(F.col("n") > LARGE), "g"))
    if large.isEmpty():
        return out
    pivot = large.groupBy("g").agg(F.min_by(F.struct("sd", "s"), F.struct(F.abs(F.size("s") - F.col("mid")), "sd")).alias("p"))
    pivot = scratch.save(pivot.select("g", F.col("p.sd").alias("pivot"), F.col("p.s").alias("ps")))
    both = F.size(F.array_intersect("s", "ps"))
    t = scratch.save(large.join(pivot, "g").select("g", "sd", "s", "n", "pivot", (both >= least * (F.size("s") + F.size("ps") - both) - 1e-9).alias("near")))
    rest = t.where("not near")
    count = rest.groupBy("g").agg(F.count("*").alias("k"))
    pack = F.collect_list(F.struct("sd", "s"))
    chunks = rest.join(count, "g").groupBy("g", F.pmod(F.xxhash64("sd"), F.ceil(F.col("k") / BLOCK)).alias("chunk")).agg(pack.alias("a"))
    blocks = t.join(count.select("g"), "g", "left_semi").groupBy("g", F.pmod(F.xxhash64("sd", F.lit(1)), F.ceil(F.col("n") / BLOCK)).alias("block")).agg(pack.alias("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for k in range(x.num_rows):
                held = dict(held_sets(x.column("a")[k].values) + held_sets(x.column("b")[k].values))
                yield pa.RecordBatch.from_pandas(forest(np.array(list(held), np.int64), list(held.values()), least), preserve_index=False)
        give_back()

    met = scratch.save(chunks).join(scratch.save(blocks), "g").select("a", "b").mapInArrow(compare, "sd long, component long")
    edges = t.where("near").select(F.col("sd").alias("u"), F.col("pivot").alias("v")).unionByName(met.where("sd <> component").select(F.col("sd").alias("u"), F.col("component").alias("v")))
    found = components(scratch.save(edges), scratch).select(F.col("node").alias("sd"), F.col("root").alias("component"))
    return out.unionByName(found)


def drop_similar(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each component stays: one with the smallest doc_id (ids before null), then the smallest text key."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk", "tn"))
    keep = similar(docs, shingle, least).groupBy("component").agg(best.alias("k")).select(F.col("k.doc_id").alias("i_"), F.col("k.tk").alias("tk_"), F.col("k.tn").alias("tn_"))
    tk, tn = text_key()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d_"), F.col("doc_id").alias("id_"), tk.alias("a_"), tn.alias("b_"))
    same = F.col("id_").eqNullSafe(F.col("i_")) & (F.col("a_") == F.col("tk_")) & (F.col("b_") == F.col("tn_"))
    return whole.join(keep, same, "left_semi").dropDuplicates(["id_", "a_", "b_"]).select("d_.*")
