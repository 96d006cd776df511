"""One input into several tables and an index, published together, with a check that none misses a row of another.

All outputs of a split lie in one new folder, cut by ``part_``: a side of its own for each kind, and the index. They are one
write job, and a reader takes the folder only once the job has marked it as complete, so that no reader sees one table of a
split without the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Split:
    """The outputs of one split."""

    def __init__(self, rows: DataFrame, kinds: list[str], folder: str) -> None:
        self.spark, self.kinds, self.folder, self.schema = rows.sparkSession, kinds, folder, rows.schema

    def table(self, name: str) -> DataFrame:
        """One of the kinds, or ``index``."""
        sc = self.spark.sparkContext
        done = sc._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_SUCCESS")
        if not done.getFileSystem(sc._jsc.hadoopConfiguration()).exists(done):
            raise FileNotFoundError(f"{self.folder}: the split is not complete")
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        return self.spark.read.schema(f"{types}, part_ string").parquet(self.folder).where(F.col("part_") == name).drop("part_")

    def check(self, key: str, kind: str) -> DataFrame:
        """(side, n, strays): rows of each output, and those of it that lack their counterpart: a row in its own kind's table
        has to be in the index under that kind, and the other way round."""
        index = self.table("index").select(key, kind)
        out = []
        for name in self.kinds:
            side = self.table(name)
            stray = side.join(index.where(F.col(kind) == name), key, "left_anti")
            out.append(told(name, side, stray))
        sides = reduce(DataFrame.unionByName, [self.table(n).select(key, F.lit(n).alias(kind)) for n in self.kinds])
        out.append(told("index", index, index.join(sides, [key, kind], "left_anti")))
        return reduce(DataFrame.unionByName, out)


def told(name: str, rows: DataFrame, strays: DataFrame) -> DataFrame:
    """One row: how many there are and how many stray."""
    both = rows.select(F.lit(0).alias("s")).unionByName(strays.select(F.lit(1).alias("s")))
    return both.agg(F.lit(name).alias("side"), F.count_if(F.col("s") == 0).alias("n"), F.count_if(F.col("s") == 1).cast("int").alias("strays"))


def split_by(rows: DataFrame, kind: str, kinds: list[str], key: str, folder: str) -> Split:
    """Write rows to the table of their kind and (key, kind) to the index; rows of another kind only to the index."""
    index = rows.select(*[F.col(c) if c in (key, kind) else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    both = rows.where(F.col(kind).isin(*kinds)).withColumn("part_", F.col(kind)).unionByName(index.withColumn("part_", F.lit("index")))
    both.write.partitionBy("part_").parquet(folder)
    return Split(rows, kinds, folder)
