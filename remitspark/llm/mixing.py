"""Mixing sources to target weights by Pareto order sampling.

Sources get word targets by weight, capped at ``most`` times their own size, the excess reshared by weight.
Inside a source, documents of a class (here short and long ones) get expected copies in proportion to the
class's preference, again capped. The whole part of the expected copies is certain; the rest is an inclusion
probability p. Pareto order sampling ranks documents by (u / (1-u)) / (p / (1-p)), u a hash of doc_id, and takes
the smallest. The sample's size is fixed in words: the ranking is cut where the taken words meet what is left
of the target.

No source is sorted as a whole. Ranks fall into buckets of a few hundred documents; sums by (source, bucket) are
aggregated before the shuffle and give the bucket where the cut lies, and only that bucket's documents meet in
one task, where documents that no longer fit are passed over.

Cases: a null text has size 0 and is never taken; null sources are a source of their own, last in order; rows
without a doc_id draw by their text; repeated rows are documents of their own with equal numbers; an
empty table gives an empty mix; extra columns are kept by ``mix`` (columns starting with ``_mix_`` are its own).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remitspark.llm.common import WORD, Scratch

#: Documents of a bucket of ranks, on average.
PER_BUCKET = 512
#: Words from which a document counts as long, and the preference of the shorter ones.
LONG, SHORT_PREFERENCE = 50, 0.5


def word_count(column: str = "text"):
    return F.regexp_count(F.coalesce(column, F.lit("")), F.lit(WORD)).cast("long")


def capped_shares(rows: DataFrame, group: list[str], budget: str, weight: str, cap: str, out: str) -> DataFrame:
    """Share each group's budget by weight; none gets more than its cap, the excess goes on by weight.

    With rows in order of cap / weight those at the cap come first, so running sums give the level at once.
    """
    order = F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).otherwise(F.lit(0.0))
    by = W.partitionBy(*group).orderBy("_order", cap)
    upto, rest = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    t = rows.withColumn("_order", order)
    t = t.withColumn("_level", (F.col(budget) - F.coalesce(F.sum(cap).over(upto), F.lit(0.0))) / F.sum(weight).over(rest))
    # the first row whose cap is above the level of what is left: from there on all get the level
    level = F.min(F.when(F.col("_level") <= F.col("_order"), F.struct(F.col("_order").alias("o"), F.col("_level").alias("l")))).over(W.partitionBy(*group))
    t = t.withColumn("_cut", level)
    share = F.when(F.col("_cut").isNull() | (F.col("_order") < F.col("_cut.o")), F.col(cap)).otherwise(F.least(F.col(cap), F.col("_cut.l") * F.col(weight)))
    return t.withColumn(out, share.cast("double")).drop("_order", "_level", "_cut")


def plan(sized: DataFrame, scratch: Scratch, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """One row per (source, class): source_size, target, whole copies, inclusion probability, buckets, cut.

    One row per source is small beside its documents; the sums are aggregated before they are shuffled.
    """
    stats = scratch.save(sized.groupBy("_mix_source", "_mix_class").agg(F.sum("_mix_size").cast("double").alias("w"), F.count("*").alias("n")))
    src = stats.groupBy("_mix_source").agg(F.sum("w").alias("source_size"), F.sum("n").alias("_n"))
    nth = (F.row_number().over(W.orderBy(F.col("_mix_source").asc_nulls_last())) - 1) % len(weights)
    src = (
        src.withColumn("_weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (nth + 1).cast("int")))
        .withColumn("_budget", share * F.sum("source_size").over(W.partitionBy(F.lit(0))))
        .withColumn("_cap", most * F.col("source_size"))
    )
    src = capped_shares(src.withColumn("_g", F.lit(0)), ["_g"], "_budget", "_weight", "_cap", "target")
    src = src.select(F.col("_mix_source").alias("_s"), "source_size", "target", "_n")
    cls = stats.join(src, stats["_mix_source"].eqNullSafe(src["_s"])).withColumn("_cap", most * F.col("w"))
    cls = cls.withColumn("_weight", F.col("w") * F.when(F.col("_mix_class") == 0, SHORT_PREFERENCE).otherwise(1.0))
    cls = capped_shares(cls, ["_mix_source"], "target", "_weight", "_cap", "_t")
    copies = F.when(F.col("w") > 0, F.col("_t") / F.col("w")).otherwise(0.0)
    cls = cls.withColumn("_mix_whole", F.floor(copies + 1e-12).cast("long"))
    cls = cls.withColumn("_mix_p", F.when(copies - F.col("_mix_whole") > 1e-9, copies - F.col("_mix_whole")).otherwise(0.0))
    left = F.col("target") - F.sum(F.col("_mix_whole") * F.col("w")).over(W.partitionBy("_mix_source"))
    return scratch.save(
        cls.select(
            F.col("_mix_source").alias("_s"), F.col("_mix_class").alias("_c"), F.col("source_size").cast("long").alias("source_size"), "target",
            "_mix_whole", "_mix_p", F.greatest(F.lit(1), F.round(F.col("_n") / PER_BUCKET)).cast("long").alias("_mix_buckets"), left.alias("_mix_left"),
        )
    )


def ranked(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows with their class's plan, rank in (0, 1) and bucket; the plan is one row per source and class."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed), "_mix_key"), 11) + F.lit(0.5)) / float(1 << 53)
    t = sized.join(plan, F.col("_mix_source").eqNullSafe(F.col("_s")) & (F.col("_mix_class") == F.col("_c"))).drop("_s", "_c")
    odds = (u / (1 - u)) / (F.col("_mix_p") / (1 - F.col("_mix_p")))
    t = t.withColumn("_mix_rank", F.when((F.col("_mix_p") > 0) & (F.col("_mix_size") > 0), odds / (1 + odds)))
    return t.withColumn("_mix_bucket", F.floor(F.col("_mix_rank") * F.col("_mix_buckets")))


def fill_bucket(t: pd.DataFrame) -> pd.DataFrame:
    """The bucket where a source's cut lies: take in order of rank what still fits, and at the end the document
    that brings the words nearest to the target."""
    t = t.sort_values(["_mix_rank", "doc_id", "_mix_size"], kind="stable").reset_index(drop=True)
    gap = float(t["_mix_left"].iloc[0] - t["_mix_before"].iloc[0])
    size, take = t["_mix_size"].to_numpy(), [0] * len(t)
    for i, s in enumerate(size.tolist()):
        if s <= gap:
            take[i] = 1
            gap -= s
    spare = [(s, i) for i, s in enumerate(size.tolist()) if not take[i]]
    if spare and (best := min(spare))[0] - gap < gap:
        take[best[1]] = 1
    t["_mix_extra"] = take
    return t


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (5.0, 2.0, 1.0), seed: int = 20, sized: DataFrame | None = None) -> DataFrame:
    """docs with size, source_size, target, copies and taken (= copies x size); no row is repeated here.

    sized: the columns doc_id, _mix_source, _mix_size, _mix_class, _mix_key of docs, where they are at hand already.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    cols = docs.columns
    if sized is None:
        rows = with_sizes(docs)
        sized = scratch.save(rows.select("doc_id", "_mix_source", "_mix_size", "_mix_class", "_mix_key"))
    else:
        rows = docs
    p = plan(sized, scratch, share, most, weights)
    sums = ranked(sized, p, seed).where("_mix_rank is not null").groupBy("_mix_source", "_mix_bucket").agg(F.sum("_mix_size").alias("b"), F.first("_mix_left").alias("_mix_left"))
    run = F.sum("b").over(W.partitionBy("_mix_source").orderBy("_mix_bucket"))
    cut = sums.withColumn("upto", run).where("upto >= _mix_left").groupBy("_mix_source").agg(F.min(F.struct("_mix_bucket", (F.col("upto") - F.col("b")).alias("before"))).alias("c"))
    cut = scratch.save(cut.select(F.col("_mix_source").alias("_s"), F.col("c._mix_bucket").alias("_mix_cut"), F.col("c.before").cast("double").alias("_mix_before")))
    t = ranked(rows, p, seed).join(cut, F.col("_mix_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    at_cut = F.col("_mix_rank").isNotNull() & (F.col("_mix_bucket") == F.col("_mix_cut"))
    sure = t.where(~F.coalesce(at_cut, F.lit(False)))
    before = F.coalesce(F.col("_mix_rank").isNotNull() & (F.col("_mix_cut").isNull() | (F.col("_mix_bucket") < F.col("_mix_cut"))), F.lit(False))
    sure = sure.withColumn("_mix_extra", before.cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sure.schema.fields)
    edge = t.where(at_cut).groupBy("_mix_source").applyInPandas(fill_bucket, schema)
    out = sure.unionByName(edge).withColumn("copies", F.col("_mix_whole") + F.col("_mix_extra"))
    out = out.withColumn("taken", F.col("copies") * F.col("_mix_size")).withColumn("size", F.col("_mix_size"))
    new = ["size", "source_size", "target", "copies", "taken"]
    return out.select(*[F.col(f"`{c}`") for c in cols if c not in new and not c.startswith("_mix_")], *new)


def with_sizes(docs: DataFrame) -> DataFrame:
    d = docs.withColumn("_mix_source", F.col("source")).withColumn("_mix_size", word_count())
    d = d.withColumn("_mix_key", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    return d.withColumn("_mix_class", (F.col("_mix_size") >= LONG).cast("int"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    plain = docs.select([F.col(f"`{c}`").alias(f"d{i}_") if c in ("size", "source_size", "target", "copies", "taken") else F.col(f"`{c}`") for i, c in enumerate(docs.columns)])
    m = mix(plain, **how)
    m = m.where("copies > 0").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return m.select([F.col(f"`{a}`").alias(c) for a, c in zip(plain.columns, docs.columns)])


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    scratch = Scratch(spark, "mixing")
    sized = scratch.save(with_sizes(docs).select("doc_id", "_mix_source", "_mix_size", "_mix_class", "_mix_key"))
    return mix(sized, sized=sized).select("doc_id", "size", "source_size", "target", "taken", "copies")
