"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: 64 bits over word shingles (XXH64, seed 42). Two fingerprints link when they differ in at most
``bits`` bits. Only distinct fingerprints are joined, so that any number of equal texts costs one row.

The trie is distributed by rotation: 64 bits are cut into ``bits + clean`` blocks, of which at least ``clean``
are equal in any linked pair. For each choice of ``clean`` blocks the fingerprints are turned so that those
blocks lead; the subtries below equal leading blocks are then joined with themselves, each within one task.
In a subtrie, pairs of nodes descend together one bit at a time, adding the bits that differ, and a pair is
dropped as soon as the budget is exceeded. Pairs whose whole subtrees must link are chained without looking
at single fingerprints. Each task reduces its links to a spanning forest before anything is shuffled.

Cases: null and empty texts have fingerprint 0 and link with each other like any other; repeated rows and ties
take part row by row and share the component; a null doc_id is kept as a row and never names a component
unless all ids of the component are null; an empty table gives an empty result; extra columns are ignored by
``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitspark.llm.common import Scratch, components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """Unsigned hashes of a text's shingles in their order, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(flat, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    return np.array([xxh64_intdigest(flat[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)


def fingerprint_of(h: np.ndarray) -> int:
    """The unsigned fingerprint of a text's shingle hashes: bits set in over half of them (none: zero)."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[k : k + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of one text."""
    return fingerprint_of(shingle_hashes(text, shingle, seed))


def with_fingerprint(docs: DataFrame, shingle: int = 4, column: str = "fp") -> DataFrame:
    """docs with a signed 64-bit fingerprint column."""

    @F.pandas_udf("long")
    def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.array([simhash(t, shingle) for t in s], np.uint64).view(np.int64))

    return docs.withColumn(column, fingerprint(F.col("text")))


def block_masks(bits: int, clean: int) -> list[tuple[int, int]]:
    """For each choice of ``clean`` of the blocks: (mask of its bits, which choice it is)."""
    n = bits + clean
    cuts = [round(64 * i / n) for i in range(n + 1)]
    blocks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(n)]
    return [(sum(blocks[i] for i in c), k) for k, c in enumerate(combinations(range(n), clean))]


def gather(x: np.ndarray, mask: int) -> np.ndarray:
    """The bits of x under the mask, moved together (a rotation for the trie's order)."""
    out, at = np.zeros_like(x), 0
    for b in range(64):
        if mask >> b & 1:
            out |= ((x >> np.uint64(b)) & np.uint64(1)) << np.uint64(at)
            at += 1
    return out


def trie_join(group: np.ndarray, rest: np.ndarray, depth: int, bits: int, leaf: int = 64, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows sorted by (group, rest): index pairs whose ``rest`` differ in at most ``bits`` bits.

    Node = interval of rows with a common prefix. Node pairs descend together; a pair costs the bits in which
    its prefixes differ. Yields pairs of index arrays, at most about ``chunk`` candidates at a time.
    """
    n = len(rest)
    if n < 2:
        return
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.concatenate([starts[1:], [n]])
    keep = ends - starts > 1
    a0, a1 = starts[keep], ends[keep]
    b0, b1, err = a0, a1, np.zeros(len(a0), np.int8)
    stack = [(depth, a0, a1, b0, b1, err)]
    while stack:
        d, a0, a1, b0, b1, err = stack.pop()
        if not len(a0):
            continue
        near = err + d <= bits  # whatever is below, it links
        size = (a1 - a0) * (b1 - b0)
        small = (size <= leaf) & ~near
        if near.any():
            for x0, x1, y0, y1 in zip(a0[near].tolist(), a1[near].tolist(), b0[near].tolist(), b1[near].tolist()):
                every = np.unique(np.concatenate([np.arange(x0, x1), np.arange(y0, y1)]))
                yield np.full(len(every) - 1, every[0]), every[1:]
        if small.any():
            s0, s1, t0, t1 = a0[small], a1[small], b0[small], b1[small]
            sizes = (s1 - s0) * (t1 - t0)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes) // chunk)) + 1, [len(sizes)]])
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                z = sizes[i:j]
                k = np.repeat(np.arange(i, j), z)
                off = np.arange(len(k)) - np.repeat(np.cumsum(z) - z, z)
                w = (t1 - t0)[k]
                x, y = s0[k] + off // w, t0[k] + off % w
                ok = (x < y) & (np.bitwise_count(rest[x] ^ rest[y]) <= bits)
                yield x[ok], y[ok]
        go = ~near & ~small
        if not go.any():
            continue
        a0, a1, b0, b1, err = a0[go], a1[go], b0[go], b1[go], err[go]
        d -= 1
        ones = np.concatenate([[0], np.cumsum((rest >> np.uint64(d)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        parts = [(a0, am, b0, bm, err, None), (am, a1, bm, b1, err, None), (a0, am, bm, b1, err + 1, None), (am, a1, b0, bm, err + 1, ~same)]
        new = []
        for p0, p1, q0, q1, e, extra in parts:
            ok = (p1 > p0) & (q1 > q0) & (e <= bits) & ~((p0 == q0) & (p1 - p0 == 1))
            if extra is not None:
                ok &= extra
            new.append((p0[ok], p1[ok], q0[ok], q1[ok], e[ok].astype(np.int8)))
        p0, p1, q0, q1, e = (np.concatenate(x) for x in zip(*new))
        step = max(1, chunk)
        for i in range(0, len(p0), step):
            stack.append((d, p0[i : i + step], p1[i : i + step], q0[i : i + step], q1[i : i + step], e[i : i + step]))


class Forest:
    """Roots over 0..n-1, joined by arrays of links; the smallest index of a tree is its root."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            rx, ry = self.root[x], self.root[y]
            differ = rx != ry
            x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
            if not len(x):
                break
            np.minimum.at(self.root, np.maximum(rx, ry), np.minimum(rx, ry))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


#: Fingerprints, each turned once a choice of blocks, that a task joins, about.
PER_TASK = 1 << 18


def links(fps: DataFrame, bits: int = 4, clean: int = 1, n: int = 0) -> DataFrame:
    """Spanning links (u, v) of distinct fingerprints fps(fp) that differ in at most ``bits`` bits; n: how many there
    are, about, for the number of tasks.

    Rows of one key are in one task; a key is a value of the leading blocks, and finer keys (larger ``clean``)
    keep subtries small when there are more fingerprints. Equal fingerprints were merged before, so that a hot
    key can only hold different fingerprints that share those bits.
    """
    masks = block_masks(bits, clean)
    def signed(m: int) -> int:
        return m - (1 << 64) if m >> 63 else m

    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("lead")) for m, k in masks])
    turned = fps.select("fp", F.explode(keys).alias("g")).select("fp", "g.k", "g.lead")
    by_choice = {k: m for m, k in masks}

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        t = pd.concat(held, ignore_index=True)
        fp, k, lead = t["fp"].to_numpy().view(np.uint64), t["k"].to_numpy(), t["lead"].to_numpy().view(np.uint64)
        del t, held
        for choice in np.unique(k):
            rows = np.flatnonzero(k == choice)
            mask = by_choice[int(choice)]
            other = ((1 << 64) - 1) ^ mask
            f, g = fp[rows], lead[rows]
            rest = gather(f, other)
            order = np.lexsort((rest, g))
            f, g, rest = f[order], g[order], rest[order]
            forest = Forest(len(f))
            for x, y in trie_join(g, rest, other.bit_count(), bits):
                forest.link(x, y)
            child = np.flatnonzero(forest.root != np.arange(len(f)))
            if len(child):
                yield pd.DataFrame({"u": f[child].view(np.int64), "v": f[forest.root[child]].view(np.int64)})

    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(masks) // PER_TASK))
    return turned.repartition(tasks, "k", "lead").mapInPandas(join, "u long, v long")


def fingerprint_links(fps: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    """Spanning links (u, v) of different fingerprints fps(fp). A random subtrie shall hold about 64 of them at most:
    blocks are finer for more fingerprints."""
    reps = scratch.save(fps.select("fp").distinct())
    n, clean = reps.count(), 1
    while clean < 4 and n / 2.0 ** (64 * clean / (bits + clean)) > 64:
        clean += 1
    return links(reps, bits, clean, n)


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """Per document: doc_id, fp (signed fingerprint), component_id (smallest doc_id reachable over links), root (the
    component's smallest fingerprint)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fp = scratch.save(with_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"))
    reps = scratch.save(fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = components(fingerprint_links(reps, bits, scratch), scratch)
    named = reps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = scratch.save(named.join(least, "root").select("fp", "component_id", "root"))
    return fp.join(ids, "fp").select("doc_id", "fp", "component_id", "root")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, bits: int = 4) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id, then the smallest fingerprint (one of
    its rows, if repeated; where no document of a component has an id, one with its smallest fingerprint)."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp"))
    keep = near_duplicates(docs, shingle, bits).groupBy("root").agg(best.alias("k")).select(F.col("k.doc_id").alias("i_"), F.col("k.fp").alias("f_"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d_"), F.col("doc_id").alias("id_"), "text")
    rows = with_fingerprint(whole, shingle, "fp_").join(keep, F.col("id_").eqNullSafe(F.col("i_")) & (F.col("fp_") == F.col("f_")), "left_semi")
    return rows.dropDuplicates(["id_", "fp_"]).select("d_.*")


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs, shingle=4, bits=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
