"""Approximate nearest neighbours by additive quantisation.

A vector's direction is approximated by a sum of ``BOOKS`` full-dimensional codewords, one of each codebook. Codebooks
start as residual k-means and are refitted by least squares against beam-search codes, on a bounded sample
(``SAMPLE`` vectors, the first by a hash of vec_id). Every vector is then encoded by beam search and stored in shards as
codes, the norm of its approximation and the cosine of both, with the vector as given behind them. A block of queries
meets each shard's codes: lookup tables of query times codeword give the cosine to each approximation (sum of entries
over the stored norm). The best ``RERANK`` of a shard by it are scored exactly, and the k-th of them is the bar. The angle
of query and vector is at least the difference of the query's and the vector's angle to the approximation, so the codes
bound each cosine from above, and vectors whose bound is below the bar are passed over. What the codes leave is scored
exactly, and the best k of each shard are merged.

The neighbours are therefore the true ones on any rows: codes that fit the rows badly cost time, not neighbours. The index
covers every row, there is no cap on queries or on what the codes leave, and ties go to the smaller vec_id at each step.

Cases: vectors that are null, zero or hold null or non-finite components take no part, as queries or candidates;
nor do vectors whose width is not the table's most common one; rows with the query's vec_id are its own; other
repeated rows are candidates of their own; repeated rows of a query are one query, but where one vec_id has several
vectors, each is a query with ranks of its own; with fewer than k candidates all are returned; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remitspark.llm.common import Scratch
from remitspark.llm.vectors import main_width, unit, usable

BOOKS, WORDS, BEAM, SAMPLE = 8, 256, 8, 8192
#: Vectors of a shard (fewer, if they have more bytes than SHARD_BYTES) and queries of a block, about; candidates of a shard
#: that are scored first; how many that the codes leave to a query are scored pair by pair, more by one matrix product.
SHARD, SHARD_BYTES, QUERIES, RERANK, POOL = 8192, 8 << 20, 512, 64, 512
#: Queries held against a shard at once, and bytes of the pairs that are scored at once.
AT_ONCE, PAIR_BYTES = 128, 16 << 20
#: What rounding may take from a bound, and what the matrix product may differ by from the exact score.
SLACK, ROUND = 1e-5, 1e-9


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        of = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        n = np.bincount(of, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, of, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c, ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n, books) by beam search: the ``beam`` best partial sums of each vector are carried on."""
    m, k, d = books.shape
    flat = books.reshape(m * k, d)
    gram, norm = flat @ flat.T, (flat * flat).sum(1)
    out = np.zeros((len(x), m), np.uint8)
    for a in range(0, len(x), 512):
        v = x[a : a + 512]
        n = len(v)
        dots = v @ flat.T
        codes = np.zeros((n, 1, 0), np.int64)
        cost = np.zeros((n, 1))
        for s in range(m):
            own = slice(s * k, s * k + k)
            step = norm[own][None, None, :] - 2 * dots[:, None, own]
            cross = sum(gram[codes[:, :, j]][:, :, own] for j in range(s))
            total = cost[:, :, None] + step + 2 * cross if s else cost[:, :, None] + step
            width = total.shape[1]
            b = min(beam, width * k)
            best = np.argpartition(total.reshape(n, -1), b - 1, axis=1)[:, :b]
            cost = np.take_along_axis(total.reshape(n, -1), best, 1)
            came, word = best // k, best % k + s * k
            codes = np.concatenate([np.take_along_axis(codes, came[:, :, None], 1), word[:, :, None]], 2)
        pick = cost.argmin(1)
        out[a : a + n] = codes[np.arange(n), pick] - np.arange(m) * k
    return out


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 3) -> np.ndarray:
    """Codebooks (books, words, width) for unit vectors x."""
    rng = np.random.default_rng(seed)
    rest, cb = x.copy(), []
    for _ in range(books):
        c, of = kmeans(rest, words, rng)
        cb.append(c)
        rest = rest - c[of]
    b = np.stack(cb)
    for _ in range(rounds):
        codes = encode(x, b) + np.arange(books) * words
        normal, right = np.zeros((books * words,) * 2), np.zeros((books * words, x.shape[1]))
        for i in range(books):
            np.add.at(right, codes[:, i], x)
            for j in range(books):
                np.add.at(normal, (codes[:, i], codes[:, j]), 1.0)
        normal[np.diag_indices_from(normal)] += 1e-2
        # stay near the old codewords where the sample says little
        b = np.linalg.solve(normal, right + 1e-2 * b.reshape(books * words, -1)).reshape(b.shape)
    return b


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of the rows of q with the rows of v, pair by pair, in double precision; equal rows get equal scores."""
    q, v = (x / np.abs(x).max(axis=1, keepdims=True) for x in (q, v))  # no square overflows
    return (v * q).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((q * q).sum(1)))


def packing(books: int, width: int, element: str) -> np.dtype:
    """A vector of a shard as bytes."""
    return np.dtype([("known", "i1"), ("vec_id", "<i8"), ("codes", "u1", (books,)), ("norm", "<f8"), ("near", "<f8"), ("vector", element, (width,))])


def coded(vectors: DataFrame, books: np.ndarray, kind: np.dtype) -> DataFrame:
    """vectors(rid, vec_id, embedding) as (rid, packed): id, codes, norm of the approximation, its cosine to the vector, vector."""
    held = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = held.value
        for t in batches:
            if len(t):
                v = np.array(t["embedding"].tolist(), np.float64)
                u = unit(v)
                codes = encode(u, b)
                approx = sum(b[j][codes[:, j]] for j in range(len(b)))
                norm = np.sqrt((approx * approx).sum(1))
                norm[norm < 1e-3] = np.inf  # says nothing of its vector, whose bound is 1
                out = np.zeros(len(t), kind)
                out["known"], out["vec_id"], out["codes"], out["vector"] = t["known"], t["id"], codes, v
                out["norm"], out["near"] = norm, np.clip((u * approx).sum(1) / norm, -1, 1)
                yield pd.DataFrame({"rid": t["rid"], "packed": [x.tobytes() for x in out]})

    rows = vectors.select("rid", F.col("vec_id").isNotNull().cast("int").alias("known"), F.coalesce("vec_id", F.lit(0)).cast("long").alias("id"), "embedding")
    return rows.mapInPandas(run, "rid long, packed binary")


def best_of(rows: np.ndarray, own: np.ndarray, q: np.ndarray, books: np.ndarray, k: int, rerank: int, pool: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k nearest rows of a shard to each of the queries q, nearest first, ties to the earlier row;
    ``own`` marks rows that are the query's."""
    v, qu = rows["vector"].astype(np.float64), unit(q)

    def scores(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        step = max(1, PAIR_BYTES // (8 * v.shape[1]))
        return np.concatenate([np.zeros(0)] + [exact_scores(q[i[a : a + step]], v[j[a : a + step]]) for a in range(0, len(i), step)])

    table = np.einsum("qd,mkd->mqk", qu, books)
    c = np.zeros((len(q), len(rows)))
    for j in range(len(books)):
        c += np.take(table[j], rows["codes"][:, j], axis=1)
    c = np.clip(c / rows["norm"], -1, 1)
    bar = np.full(len(q), -np.inf)
    first = min(max(rerank, k), len(rows))
    pick = np.argpartition(np.where(own, -2, c), len(rows) - first, axis=1)[:, len(rows) - first :]
    if first >= k:
        s = scores(np.repeat(np.arange(len(q)), first), pick.ravel()).reshape(pick.shape)
        s[np.take_along_axis(own, pick, 1)] = -np.inf
        bar = np.partition(s, first - k, axis=1)[:, first - k]
    near = rows["near"]
    left = (c * near + np.sqrt((1 - c * c) * (1 - near * near)) + SLACK >= bar[:, None]) & ~own
    many = np.flatnonzero(left.sum(1) > max(pool, k))
    if len(many):
        s = np.where(left[many], qu[many] @ unit(v).T, -np.inf)
        left[many] &= s >= np.partition(s, len(rows) - k, axis=1)[:, len(rows) - k][:, None] - ROUND
    i, j = np.nonzero(left)
    s = scores(i, j)
    order = np.lexsort((j, -s, i))
    i, j, s = i[order], j[order], s[order]
    top = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[top], j[top], s[top]


def sampled(vectors: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """The first ``SAMPLE`` of n vectors by a hash of vec_id. Those with the smallest hashes are picked before they are ordered, so
    that no partition hands on its own first ``SAMPLE``, and what the driver reads does not grow with the partitions."""
    h, share = F.xxhash64("vec_id"), 1.25 * SAMPLE / max(1, n)
    while True:
        few = scratch.save(vectors.where(h <= -(1 << 63) + int(share * (1 << 64))) if share < 1 else vectors)
        if share >= 1 or few.count() >= SAMPLE:
            return scratch.save(few.orderBy(h, "vec_id", "embedding").limit(SAMPLE).select("embedding"))
        scratch.drop(few)
        share *= 2


def candidates(asked: DataFrame, codes: DataFrame, n: int, shards: int, books: np.ndarray, kind: np.dtype, k: int, rerank: int, pool: int, scratch: Scratch) -> DataFrame:
    """(qid, vec_id, score): of each query asked(qid, vec_id, embedding), the k nearest of every shard."""
    spark = asked.sparkSession
    held = spark.sparkContext.broadcast(books)
    shard = F.pmod(F.xxhash64("rid"), F.lit(shards)).alias("shard")
    rows = codes.groupBy(shard).agg(F.collect_list("packed").alias("rows"))
    blocks = max(1, round(n / QUERIES))
    packed = asked.groupBy(F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("qid", "vec_id", "embedding")).alias("queries"))
    # the stated queries meet every shard, block by block; both are read from their tables, and no block is shuffled once a shard
    met = scratch.save(packed.select("queries")).hint("shuffle_replicate_nl").crossJoin(scratch.save(rows.select("rows")))

    def one(asked: list, rows: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        known = rows["known"] == 1
        own = np.stack([known & (rows["vec_id"] == x["vec_id"]) if x["vec_id"] is not None else np.zeros(len(rows), bool) for x in asked])
        i, j, s = best_of(rows, own, np.array([x["embedding"] for x in asked], np.float64), b, k, rerank, pool)
        ids = pd.Series(pd.array(rows["vec_id"][j], "Int64")).mask(~known[j])
        return pd.DataFrame({"qid": np.array([x["qid"] for x in asked], np.int64)[i], "vec_id": ids, "score": s})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for queries, found in zip(t["queries"], t["rows"]):
                rows = np.frombuffer(b"".join(found), kind)
                rows = rows[np.lexsort((rows["vec_id"], rows["known"]))]  # null first, as Spark orders it
                for a in range(0, len(queries), AT_ONCE):
                    yield one(queries[a : a + AT_ONCE], rows, held.value)

    return met.mapInPandas(search, "qid long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, rerank: int = RERANK, pool: int = POOL) -> DataFrame:
    """(query_id, rank, vec_id, score) for each different row of queries(vec_id, embedding) against all rows of vectors."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    good = vectors.where(usable()).select("vec_id", "embedding")
    width = main_width(good)
    good = scratch.save(good.where(F.size("embedding") == width).withColumn("rid", F.monotonically_increasing_id()))
    size = good.count()
    sample = sampled(good, size, scratch).toPandas()["embedding"].tolist()  # bounded
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = fit(unit(np.array(sample, np.float64)))
    element = "<f4" if dict(good.dtypes)["embedding"] == "array<float>" else "<f8"
    kind = packing(len(books), width, element)
    shards = max(1, round(size / SHARD), -(-size * kind.itemsize // SHARD_BYTES))
    asked = queries.where(usable()).where(F.size("embedding") == width).select("vec_id", "embedding").distinct()
    asked = scratch.save(asked.withColumn("qid", F.monotonically_increasing_id()))
    found = candidates(asked, coded(good, books, kind), asked.count(), shards, books, kind, k, rerank, pool, scratch)
    order = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = best.join(asked.select("qid", F.col("vec_id").alias("query_id")).hint("merge"), "qid")
    return scratch.save(out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op5_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)
