"""Feature history on disk, with a way on where there is none yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def history_or(spark: SparkSession, path: str, otherwise: Callable[[], DataFrame]) -> DataFrame:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.parquet(path) if there else otherwise()
