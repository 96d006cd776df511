"""Composable vector search: first stage, filters, context, threshold, limit, in that order.

Queries in blocks meet vectors in shards; a task scores one block against one shard by a matrix product and keeps the
best of each query, so that only those are shuffled. Neither side is broadcast, and no pair leaves its task unless it is
among its query's best there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors of a shard and queries of a block, about.
SHARD, BLOCK = 4096, 512


class SearchOrderError(ValueError):
    """A stage was added where it cannot stand."""


def units(rows: list) -> np.ndarray:
    x = np.array([r["embedding"] for r in rows], np.float64)
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, by: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """(query_id, vec_id, score, place): the k nearest of each of queries(query_id, embedding, *by) among the rows of
    vectors(vec_id, embedding, *by) that agree with it in ``by`` and are not itself; cosine to ``digits`` places, ties to
    the smaller vec_id. Rows without a vector take no part."""
    queries, vectors = (d.select(name, "embedding", *by).where("embedding is not null") for d, name in ((queries, "query_id"), (vectors, "vec_id")))
    shards, blocks = (max(1, -(-d.count() // size)) for d, size in ((vectors, SHARD), (queries, BLOCK)))
    rows = vectors.groupBy(*by, F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("rows"))
    asked = queries.groupBy(*by, F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "embedding")).alias("asked"))
    met = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(rows, [*by, "shard"]).select("asked", "rows")

    def one(asked: list, rows: list) -> pd.DataFrame:
        rows = sorted(rows, key=lambda r: r["vec_id"])
        ids = np.array([r["vec_id"] for r in rows], np.int64)
        score = np.round(units(asked) @ units(rows).T, digits)
        out = []
        for q, s in zip(asked, score):
            s = np.where(ids == q["query_id"], -np.inf, s)
            best = np.argsort(-s, kind="stable")[:k]
            best = best[s[best] > -np.inf]
            out.append(pd.DataFrame({"query_id": q["query_id"], "vec_id": ids[best], "score": s[best]}))
        return pd.concat(out, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for asked, rows in zip(b["asked"], b["rows"]):
                yield one(list(asked), list(rows))

    found = met.mapInPandas(run, "query_id long, vec_id long, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


class Search:
    def __init__(self, vectors: DataFrame) -> None:
        self.df, self.stage = vectors, "start"

    def _to(self, stage: str, after: tuple[str, ...]) -> None:
        if self.stage not in after:
            raise SearchOrderError(f"{stage} cannot follow {self.stage}")
        self.stage = stage

    def prefilter(self, cond: Column) -> Search:
        self._to("start", ("start",))
        self.df = self.df.where(cond)
        return self

    def nearest(self, queries: DataFrame, candidates: int, by: tuple[str, ...] = ()) -> Search:
        """First stage: best candidates of each query (query_id, embedding), before any other filter."""
        self._to("ranked", ("start",))
        found = top_k(queries, self.df, candidates, by)
        self.df = found.join(self.df.drop("embedding"), "vec_id")
        return self

    @staticmethod
    def merged(*parts: Search) -> Search:
        """Hits of several indexes as one ranking."""
        if any(p.stage not in ("ranked", "filtered", "joined", "cut") for p in parts):
            raise SearchOrderError("only ranked searches can be merged")
        out = Search(parts[0].df)
        for p in parts[1:]:
            out.df = out.df.unionByName(p.df)
        out.stage = "ranked"
        return out

    def where(self, cond: Column) -> Search:
        self._to("filtered", ("ranked", "filtered"))
        self.df = self.df.where(cond)
        return self

    def context(self, other: DataFrame, key: str) -> Search:
        self._to("joined", ("ranked", "filtered"))
        self.df = self.df.join(other, key, "left")
        return self

    def at_least(self, score: float) -> Search:
        self._to("cut", ("ranked", "filtered", "joined"))
        self.df = self.df.where(F.col("score") >= score)
        return self

    def limit(self, k: int) -> DataFrame:
        self._to("done", ("ranked", "filtered", "joined", "cut"))
        w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return self.df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def near_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, customer_id, distance): names(customer_id, name) within one edit of queries(query_id, name). Names one
    edit apart are equal or equal after one letter less of one or both, so they are joined on those keys and then
    compared; no name meets all others."""

    def keyed(d: DataFrame) -> DataFrame:
        less = F.transform(F.sequence(F.lit(1), F.char_length("name")), lambda i: F.concat(F.substring(F.col("name"), F.lit(1), i - 1), F.substring(F.col("name"), i + 1, F.char_length("name"))))
        return d.where("name is not null and name <> ''").withColumn("key", F.explode(F.array_distinct(F.concat(F.array("name"), less))))

    q = keyed(queries.select("query_id", "name")).select("query_id", F.col("name").alias("asked"), "key")
    d = F.levenshtein("asked", "name")
    pairs = q.join(keyed(names.select("customer_id", "name")), "key").select("query_id", "customer_id", d.alias("distance"))
    return pairs.where("distance <= 1").distinct()


def completions(queries: DataFrame, names: DataFrame, least: int = 3, most: int = 20) -> DataFrame:
    """(query_id, customer_id) where queries(query_id, typed) is how a name begins, by its beginnings as tokens."""
    tokens = names.withColumn("typed", F.explode(F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.greatest(F.char_length("name"), F.lit(least)))), lambda i: F.substring(F.col("name"), F.lit(1), i))))
    return queries.select("query_id", "typed").join(tokens.select("customer_id", "typed").distinct(), "typed").select("query_id", "customer_id").distinct()
