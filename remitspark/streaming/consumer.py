"""A micro-batch consumer that counts what it does while it writes: no second read of the output.

Each record is accepted, skipped for an unknown key, or an error that does not stop the batch. The counts are observed
metrics of the very job that writes the batch, and go to a ledger under the batch's number: a batch that is replayed after a
failure writes its rows and its counts over those of before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

OUTCOMES = ("skipped_unknown", "errors", "accepted")
LEDGER = ", ".join(f"{c} long" for c in (*OUTCOMES, "stamped"))


def consumed(spark: SparkSession, known: DataFrame, key: str, good: Column, stamp: list[str], out: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch's records with their outcome to ``out``/rows, its counts to ``out``/ledger. ``known`` has one
    row for each key that may pass, ``good`` says whether a record can be written, ``stamp`` are the columns of its origin."""

    def each(df: DataFrame, batch: int) -> None:
        there = known.select(key).withColumn("known_", F.lit(True))
        outcome = F.when(F.col("known_").isNull(), OUTCOMES[0]).when(~F.coalesce(good, F.lit(False)), OUTCOMES[1]).otherwise(OUTCOMES[2])
        counts = [F.count_if(F.col("outcome") == c).alias(c) for c in OUTCOMES]
        seen = Observation(f"consumed-{batch}")
        rows = df.join(there, key, "left").withColumn("outcome", outcome).drop("known_")
        stamped = F.count_if(F.expr(" and ".join(f"{c} is not null" for c in stamp)))
        rows.observe(seen, *counts, stamped.alias("stamped")).write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")
        got = seen.get
        spark.createDataFrame([tuple(got.get(c, 0) for c in (*OUTCOMES, "stamped"))], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{out}/ledger/batch={batch}")

    return each


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """batch and its counts."""
    return spark.read.schema(f"{LEDGER}, batch long").parquet(f"{out}/ledger")


def totals(spark: SparkSession, out: str) -> DataFrame:
    """The counts of all batches."""
    return ledger(spark, out).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*OUTCOMES, "stamped")])
