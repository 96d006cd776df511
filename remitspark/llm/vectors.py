"""Which vectors take part, and unit vectors from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """Not null, no null or non-finite component, and not zero."""
    e = F.col(column)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(e.isNotNull() & fine & F.exists(e, lambda x: x != 0), F.lit(False))


def main_width(vectors: DataFrame, column: str = "embedding") -> int:
    """The most common number of components (0 for an empty table)."""
    row = vectors.groupBy(F.size(column).alias("w")).count().orderBy(F.desc("count"), "w").first()
    return int(row.w) if row else 0


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision (scaled first, so that squares neither overflow nor vanish)."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
