"""Embedding near-duplicates by an epsilon grid order join.

Two vectors of one label link when their cosine is at least ``cosine``, that is, when their unit vectors are within
eps = sqrt(2 - 2 cosine). Different vectors are sorted by label and by the cells (side eps) of their leading
principal components (by hash inside a cell, so that a dense cell is split too), over all partitions, and cut into blocks of neighbours in that order. Intervals of blocks
are joined recursively from the whole sequence down: a pair of intervals whose labels or boxes are farther apart
than eps is skipped with all that is below it. The pairs of blocks that remain are compared in full, in double
precision; each task keeps a spanning forest of its links and sums of partners.

The principal axes are fitted on at most ``SAMPLE`` vectors; they decide how much is skipped, never a link.

Cases: vectors that are null, zero or hold null or non-finite components, and rows without a label, link with
nothing and stay; vectors of different widths never link; exact copies are joined once as a class and counted;
repeated rows are vectors of their own; a null vec_id takes part but names no component unless all ids are null;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitspark.llm.common import Scratch, components
from remitspark.llm.simhash import Forest
from remitspark.llm.vectors import main_width, unit, usable

#: Vectors for the principal axes; axes that make the grid; rows of a block; intervals below an interval.
SAMPLE, AXES, BLOCK, FAN = 4096, 6, 1024, 16


def principal_axes(sample: list, width: int, axes: int) -> np.ndarray:
    """Orthonormal leading directions of the sample's unit vectors (coordinate axes, if there are none)."""
    axes = min(axes, width)
    if len(sample) < 2:
        return np.eye(width)[:axes]
    x = unit(np.array(sample, np.float64))
    x = x - x.mean(axis=0)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :axes].T


def classes(vectors: DataFrame) -> DataFrame:
    """vectors with a key (label, e1, e2, width) of equal vectors; only those that can link."""
    v = vectors.where(usable() & F.col("label").isNotNull())
    e = F.col("embedding").cast("array<double>")
    return v.select("vec_id", "label", "embedding", F.xxhash64(e).alias("e1"), F.xxhash64(e, F.lit(1)).alias("e2"), F.size("embedding").alias("width"))


def grid_blocks(cls: DataFrame, eps: float, scratch: Scratch) -> DataFrame:
    """Classes in epsilon grid order with their block number, saved."""
    width = main_width(cls)
    sample = cls.where(F.col("width") == width).orderBy("e1", "e2").limit(SAMPLE).select("embedding").toPandas()["embedding"].tolist()
    basis = principal_axes(sample, max(width, 1), AXES)

    @F.pandas_udf("array<double>")
    def project(s: pd.Series) -> pd.Series:
        out = []
        for e in s:
            x = unit(np.asarray(e, np.float64)[None, :])[0]
            out.append(basis @ x if len(x) == basis.shape[1] else np.resize(x, min(len(x), AXES)))
        return pd.Series([list(p) + [0.0] * (AXES - len(p)) for p in out])

    t = cls.withColumn("at", project("embedding"))
    cells = [F.floor(F.col("at")[i] / eps) for i in range(AXES)]
    t = t.orderBy("label", "width", *cells, "e1", "e2").withColumn("seq", F.monotonically_increasing_id())
    t = scratch.save(t.withColumn("cid", F.col("seq")))
    return t.withColumn("block", F.floor(F.col("seq") / BLOCK))


def near_boxes(a: str, b: str, eps: float):
    """Labels overlap, and the boxes a and b are within eps."""
    gap = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"{a}lo{i}") - F.col(f"{b}hi{i}"), F.col(f"{b}lo{i}") - F.col(f"{a}hi{i}")), 2) for i in range(AXES))
    return (F.col(f"{a}lmin") <= F.col(f"{b}lmax")) & (F.col(f"{b}lmin") <= F.col(f"{a}lmax")) & (gap <= (eps + 1e-6) ** 2)


def block_pairs(t: DataFrame, eps: float, scratch: Scratch) -> DataFrame:
    """(a, b), a <= b: blocks that may hold a link, found from the whole sequence downwards."""
    box = [F.min("label").alias("lmin"), F.max("label").alias("lmax")]
    box += [f(F.col("at")[i]).alias(f"{n}{i}") for i in range(AXES) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    leaf = t.groupBy(F.col("block").alias("id")).agg(*box)
    # blocks of a partition follow each other; partitions leave gaps, so blocks are numbered by rank
    n = leaf.count()
    if n == 0:
        return t.sparkSession.createDataFrame([], "a long, b long")
    leaf = scratch.save(leaf.orderBy("id").withColumn("seq", F.monotonically_increasing_id()))
    per = leaf.groupBy(F.shiftright("seq", 33).alias("pid")).count()
    from pyspark.sql import Window as W

    per = per.select("pid", (F.sum("count").over(W.orderBy("pid")) - F.col("count")).alias("base"))  # one row a partition
    leaf = leaf.withColumn("pid", F.shiftright("seq", 33)).join(F.broadcast(per), "pid")
    leaf = scratch.save(leaf.withColumn("no", F.col("base") + F.col("seq") % (1 << 33)).drop("pid", "seq", "base"))
    names = ["lmin", "lmax"] + [f"{n}{i}" for i in range(AXES) for n in ("lo", "hi")]
    up = [(F.min if "min" in c or c.startswith("lo") else F.max)(c).alias(c) for c in names]
    levels = [leaf.drop("id")]
    while n > 1:
        levels.append(scratch.save(levels[-1].groupBy(F.floor(F.col("no") / FAN).alias("no")).agg(*up)))
        n = math.ceil(n / FAN)
    pairs = t.sparkSession.createDataFrame([(0, 0)], "a long, b long")
    for level in reversed(levels[:-1]):
        side = [level.select(F.col("no").alias(s), F.floor(F.col("no") / FAN).alias(f"{s}up"), *[F.col(c).alias(s + c) for c in names]) for s in "ab"]
        down = pairs.withColumnsRenamed({"a": "aup", "b": "bup"}).join(side[0], "aup").join(side[1], "bup")
        pairs = scratch.save(down.where((F.col("a") <= F.col("b")) & near_boxes("a", "b", eps)).select("a", "b"))
    ids = leaf.select("no", "id")
    return pairs.join(ids.select(F.col("no").alias("a"), F.col("id").alias("x")), "a").join(ids.select(F.col("no").alias("b"), F.col("id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))


def packed_blocks(t: DataFrame) -> DataFrame:
    """One row a block (at most BLOCK classes): ids, labels, copies and vectors side by side."""
    row = F.struct("cid", "label", "width", "n", "embedding")
    return t.groupBy("block").agg(F.collect_list(row).alias("rows"))


def compare(pairs: DataFrame, blocks: DataFrame, cosine: float) -> DataFrame:
    """(cid, partners, root): for each class with a link in a pair of blocks, the vectors it links with there and
    a class it is joined to."""
    a = blocks.select(F.col("block").alias("a"), F.col("rows").alias("left"))
    b = blocks.select(F.col("block").alias("b"), F.col("rows").alias("right"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "left", F.when(F.col("a") != F.col("b"), F.col("right")).alias("right"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for left, right in zip(batch["left"], batch["right"]):
                yield one(left, left if right is None else right, right is None)

    def one(left: list, right: list, own: bool) -> pd.DataFrame:
        cid = np.array([r["cid"] for r in left] + ([] if own else [r["cid"] for r in right]), np.int64)
        forest, partners = Forest(len(cid)), np.zeros(len(cid), np.int64)
        n, m = len(left), len(right)
        shift = 0 if own else n
        for w in {r["width"] for r in left} & {r["width"] for r in right}:
            i, j = ([k for k, r in enumerate(side) if r["width"] == w] for side in (left, right))
            x, y = (unit(np.array([side[k]["embedding"] for k in ks], np.float64)) for side, ks in ((left, i), (right, j)))
            lx, ly = (np.array([side[k]["label"] for k in ks]) for side, ks in ((left, i), (right, j)))
            nx, ny = (np.array([side[k]["n"] for k in ks], np.int64) for side, ks in ((left, i), (right, j)))
            i, j = np.array(i), np.array(j)
            link = (x @ y.T >= cosine) & (lx[:, None] == ly[None, :])
            if own:
                np.fill_diagonal(link, False)
            partners[i] += link @ ny
            if not own:
                partners[j + shift] += link.T @ nx
            p, q = np.nonzero(link)
            forest.link(i[p], j[q] + shift)
        hit = np.flatnonzero((partners > 0) | (forest.root != np.arange(len(cid))))
        return pd.DataFrame({"cid": cid[hit], "partners": partners[hit], "root": cid[forest.root[hit]]})

    return both.select("left", "right").mapInPandas(run, "cid long, partners long, root long")


def linked_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    scratch = Scratch(vectors.sparkSession, "epsgrid")
    eps = math.sqrt(2 - 2 * cosine)
    key = ["label", "e1", "e2", "width"]
    rows = classes(vectors.select("vec_id", "label", "embedding"))
    cls = scratch.save(rows.groupBy(*key).agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding")))
    t = grid_blocks(cls, eps, scratch)
    found = scratch.save(compare(block_pairs(t, eps, scratch), packed_blocks(t), cosine))
    comp = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")), scratch)
    named = t.select("cid", "least", "n", *key).join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    links = found.groupBy("cid").agg(F.sum("partners").alias("partners"))
    known = named.join(least, "root").join(links, "cid", "left").select(*key, (F.coalesce("partners", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    known = scratch.save(known)
    linked = rows.select("vec_id", *key).join(known, key).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~(usable() & F.col("label").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)
