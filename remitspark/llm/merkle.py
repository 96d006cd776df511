"""Merkle manifest of a dataset: a hash tree a group, one over the groups, and a proof for each row.

Rows of a group get places in their order without a group meeting in one task: leaves are sorted by ranges over all
groups, each range counts its rows of a group, and counts before it are added up. ``BLOCK`` consecutive places are an
aligned block. A block keeps each level of its part of the tree as one hex string: parents are the digests of fixed-width
substrings of the level below, and a leaf's siblings are the substrings beside its ancestors. Block roots are the leaves
of the next round, with places of their own, until one is left a group; a leaf's path is its segment in its block followed
by the path of the block's root. Rounds grow with the logarithm of the rows to the base ``BLOCK``, and all but the first
handle one row a block. Subroots go through the same rounds as one group.

A level of more than one node becomes the next by pairs; the last node of an odd level becomes the digest of itself alone.

Cases: a null field is ``-``, an empty one ``0:``; null and repeated doc_ids have places too (null first, equal ones by
leaf, equal rows in any order, which gives the same rows); null groups are a group of their own, before the empty text; an
empty table gives an empty result, a single row is its own root with the proof of no sibling; extra columns are ignored,
and columns named like the result's are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remitspark.llm.common import Scratch

#: Leaves of a block, a power of two, and the levels above them that a block holds.
LEVELS = 9
BLOCK = 1 << LEVELS
#: Hex digits of a digest.
WIDE = 64


def field(c: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value as text."""
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Lowercase hex sha256 of the fields, one after the other."""
    return F.sha2(F.concat(*map(field, values)), 256)


def placed(nodes: DataFrame, group: str, order: list[str], scratch: Scratch) -> DataFrame:
    """The nodes with ``place``, from 0 in each group by ``order``, and ``of``, how many nodes their group has. A range of
    the sort is one task's rows; what comes before it in its group is a sum over ranges."""
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    ranged = scratch.save(nodes.repartitionByRange(*keys).withColumn("range_", F.spark_partition_id()))
    counts = scratch.save(ranged.groupBy(group, "range_").agg(F.count("*").alias("here_")))  # one row a range, and one more a group
    whole = W.partitionBy(group)
    before = whole.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col(group).alias("group_"), F.col("range_").alias("r_"), F.coalesce(F.sum("here_").over(before), F.lit(0)).alias("before_"), F.sum("here_").over(whole).alias("of"))
    inside = F.row_number().over(W.partitionBy(group, "range_").orderBy(*keys[1:])) - 1
    t = ranged.withColumn("inside_", inside)
    t = t.join(counts, (F.col("range_") == F.col("r_")) & F.col(group).eqNullSafe(F.col("group_")))
    return t.withColumn("place", F.col("before_") + F.col("inside_")).drop("range_", "r_", "group_", "before_", "here_", "inside_")


def part(level: Column, k: Column | int, width: int) -> Column:
    """Substring number k (from 0) of so many digits; shorter or empty at the end."""
    return level.cast("binary").substr((F.lit(k) if isinstance(k, int) else k) * width + 1, F.lit(width))


def size(level: Column) -> Column:
    return (F.length(level) / WIDE).cast("int")


def above(level: Column) -> Column:
    """The level of parents: digests of pairs of digits' runs, of the last alone if it has no partner."""
    pairs = F.sequence(F.lit(0), F.floor((size(level) - 1) / 2).cast("int"))
    return F.array_join(F.transform(pairs, lambda k: F.sha2(part(level, k, 2 * WIDE), 256)), "")


def levels(low: Column, more: Column) -> Column:
    """The strings of all levels of a block from its lowest: LEVELS further ones where the group has more blocks, else up to
    the level of one node."""
    grown = lambda acc, _: F.when(more | (size(F.element_at(acc, -1)) > 1), F.concat(acc, F.array(above(F.element_at(acc, -1))))).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(low), grown)


def segment(tree: Column, k: Column) -> Column:
    """Siblings of node k of the lowest level, level by level: side (``<`` before, ``>`` behind) and digest, ``-`` for none."""

    def sibling(h: Column) -> Column:
        at = F.floor(k / F.pow(F.lit(2), h)).cast("int")
        beside = part(F.get(tree, h), at + F.when(at % 2 == 0, 1).otherwise(-1), WIDE).cast("string")
        return F.when(beside == "", "-").when(at % 2 == 0, F.concat(F.lit(">"), beside)).otherwise(F.concat(F.lit("<"), beside))

    heights = F.filter(F.sequence(F.lit(0), F.size(tree) - 1), lambda h: h < F.size(tree) - 1)
    return F.transform(heights, sibling)


def climbed(nodes: DataFrame, group: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """One round over placed nodes (group, place, of, digest, and what else): each node with its block and segment, and the
    block roots as the next round's nodes (group, place, of, digest)."""
    rest = [c for c in nodes.columns if c not in (group, "of")]
    blocks = nodes.groupBy(group, F.floor(F.col("place") / BLOCK).alias("block_")).agg(F.max("of").alias("of"), F.array_sort(F.collect_list(F.struct("place", *[c for c in rest if c != "place"]))).alias("rows_"))  # BLOCK rows at most
    low = F.array_join(F.transform("rows_", lambda r: r["digest"]), "")
    blocks = scratch.save(blocks.withColumn("tree_", levels(low, F.col("of") > BLOCK)))
    of = F.ceil(F.col("of") / BLOCK).cast("long")
    roots = blocks.select(group, F.col("block_").alias("place"), of.alias("of"), F.element_at("tree_", -1).alias("digest"))
    each = F.explode(F.transform("rows_", lambda r, k: F.struct(r.alias("r"), segment(F.col("tree_"), k).alias("s"))))
    return blocks.select(group, "block_", each.alias("x")).select(group, "block_", *[F.col(f"x.r.{c}").alias(c) for c in rest], F.col("x.s").alias("segment_")), roots


def rooted(nodes: DataFrame, group: str, scratch: Scratch) -> DataFrame:
    """Placed nodes with ``top``, the root of their group, and ``path``, their siblings on the way to it."""
    largest = nodes.agg(F.max("of")).first()[0] or 0
    own, roots = climbed(nodes, group, scratch)
    if largest <= BLOCK:
        up = roots.select(F.col(group).alias("group_"), F.col("digest").alias("top"))
        return own.join(up, F.col(group).eqNullSafe(F.col("group_"))).withColumn("path", F.col("segment_")).drop("group_", "block_", "segment_")
    up = rooted(roots, group, scratch).select(F.col(group).alias("group_"), F.col("place").alias("place_"), "top", F.col("path").alias("path_"))
    joined = own.join(up, F.col(group).eqNullSafe(F.col("group_")) & (F.col("block_") == F.col("place_")))
    return joined.withColumn("path", F.concat("segment_", "path_")).drop("group_", "place_", "path_", "block_", "segment_")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.when(s.startswith("<"), F.concat(F.substring(s, 2, WIDE), h)).when(s.startswith(">"), F.concat(h, F.substring(s, 2, WIDE))).otherwise(h), 256))


def proof(path: Column) -> Column:
    """The digest of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substring(s, 2, WIDE)), ""), 256)


def manifest(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """leaves(group, order, leaf, and what else) with subroot, root, path: a tree of each group, and one over their roots."""
    scratch = Scratch(leaves.sparkSession, "merkle")
    own = scratch.save(leaves)
    rest = [c for c in own.columns if c != group]
    nodes = placed(own.select(group, *order, F.monotonically_increasing_id().alias("row_"), F.col("leaf").alias("digest"), F.struct(*rest).alias("own_")), group, [*order, "digest", "row_"], scratch)
    trees = scratch.save(rooted(nodes.select(group, "place", "of", "digest", "own_"), group, scratch))
    tops = trees.groupBy(group).agg(F.first("top").alias("digest")).withColumn("all_", F.lit(0))
    whole = rooted(placed(tops, "all_", [group], scratch), "all_", scratch)
    whole = whole.select(F.col(group).alias("group_"), F.col("top").alias("root"), F.col("path").alias("path_"))
    t = trees.join(whole, F.col(group).eqNullSafe(F.col("group_")))
    return t.select(group, *[F.col(f"own_.{c}").alias(c) for c in rest], F.col("top").alias("subroot"), "root", F.concat("path", "path_").alias("path"))


def documents_manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """Documents' manifest by language, and what of it holds where ``tampered`` says that n_chars was raised by one."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [(F.col("n_chars").cast("decimal(20,0)") + 1) if k == 3 else c for k, c in enumerate(fields)]
    held = docs.select("doc_id", "lang", leaf(*fields).alias("leaf"), F.when(tampered, leaf(*changed)).alias("found"))
    t = manifest(held, "lang", ["doc_id"])
    back = folded(F.coalesce("found", "leaf"), F.col("path")).alias("folded_root")
    t = t.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), back)
    return t.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents_manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
