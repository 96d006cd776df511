"""Isolation forest: each tree is grown on its own small sample by one task; rows are scored batch by batch.

The sample of a tree is fixed in size (``SAMPLE`` rows, as the method has it), so a tree's task and the whole model
stay small however large the table is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE = 256
#: Rows from which all trees draw their samples.
POOL = 20_000


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator) -> list[list[float]]:
    """Nodes (feature, cut, left, right, depth added at a leaf); feature -1 is a leaf."""
    limit, nodes = int(np.ceil(np.log2(max(len(x), 2)))), []

    def node(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1.0, 0.0, 0.0, 0.0, depth + average_path(len(rows))])
        spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
        if depth < limit and len(spread):
            f = int(rng.choice(spread))
            cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
            left = rows[:, f] < cut
            if left.any() and not left.all():
                nodes[me][:4] = [float(f), float(cut), float(node(rows[left], depth + 1)), float(node(rows[~left], depth + 1))]
        return me

    node(x, 0)
    return nodes


def fit(df: DataFrame, features: list[str], trees: int = 200, sample: int = SAMPLE, seed: int = 7, row_id: str | None = None) -> DataFrame:
    """(tree, nodes): one row a tree, each on a uniform sample of rows. The table is read once for a pool of
    ``POOL`` rows (the smallest hashes of ``row_id``, unique in df; without one, of their place in df); each tree then
    takes the smallest hashes of (row, tree) in the pool, so that nothing is multiplied by trees but the pool."""
    key = F.col(row_id) if row_id else F.monotonically_increasing_id()
    t = df.select(key.alias("_id"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    pool = t.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(POOL)
    n = F.count("*").over(W.partitionBy(F.lit(0)))  # the pool is bounded
    share = F.least(F.lit(1.0), F.lit(3.0 * sample) / F.col("n"))
    t = pool.withColumn("n", n).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("h", F.xxhash64("_id", "tree", F.lit(seed)))
    t = t.where((F.shiftrightunsigned("h", 11) / float(1 << 53)) < share)

    def one(p: pd.DataFrame) -> pd.DataFrame:
        tree = int(p["tree"].iloc[0])
        x = p.sort_values(["h", "_id"])[features].to_numpy(float)[:sample]
        return pd.DataFrame({"tree": [tree], "nodes": [grow(x, np.random.default_rng(seed + tree))]})

    return t.groupBy("tree").applyInPandas(one, "tree int, nodes array<array<double>>")


def score(df: DataFrame, model: DataFrame, features: list[str], sample: int = SAMPLE) -> DataFrame:
    """df with model_score: 2 ** (-mean depth / average path), higher is stranger; missing features count as 0."""
    trees = [np.array([list(r) for r in row.nodes]) for row in model.orderBy("tree").collect()]  # trees x ~2 sample nodes
    held = df.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def f(*cols: pd.Series) -> pd.Series:
        x = np.stack([c.fillna(0).to_numpy(float) for c in cols], 1)
        depth = np.zeros(len(x))
        for t in held.value:
            at = np.zeros(len(x), int)
            while True:
                feature = t[at, 0].astype(int)
                go = np.flatnonzero(feature >= 0)
                if not len(go):
                    break
                left = x[go, feature[go]] < t[at[go], 1]
                at[go] = np.where(left, t[at[go], 2], t[at[go], 3]).astype(int)
            depth += t[at, 4]
        return pd.Series(2.0 ** (-(depth / len(held.value)) / average_path(sample)))

    return df.withColumn("model_score", f(*[F.col(c).cast("double") for c in features]))
