"""Shared pieces of the training-data operators: scratch tables, words, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as all contracts of this subpackage have it.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; where that is unset, one of this machine if Spark
    runs on it alone, and an error otherwise."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows and bytes of an Arrow batch for operators that read whole texts: bounds what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS and BATCH_BYTES, where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Hand memory that this Python worker has freed back to the system: workers are used again by later tasks, and what one
    stage has needed at its peak would stay with them beside what the next one needs."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it decides by itself
        pass


class Scratch:
    """Tables written to the shared folder to cut lineage: what is written survives lost executors.

    ``save`` writes once and reads back; ``drop`` removes tables that later steps no longer read and
    lets the driver's JVM forget finished shuffles, whose files go with them.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        bounded_batches(spark)
        self.spark = spark
        self.base = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that ``save`` gave; another DataFrame is an error, as nothing of it is on disk."""
        if any("_scratch_path" not in vars(t) for t in tables):
            raise ValueError("only a table that save() gave can be dropped")
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            p.getFileSystem(conf).delete(p, True)

    def clear(self) -> None:
        """Remove all tables of this scratch, and the shuffles behind them."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self.forget()

    def forget(self) -> None:
        """Ask the driver's JVM to collect: shuffle files of finished, unreferenced plans are then removed."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def text_key() -> list:
    """Columns that stand for a text's content: its 64-bit hash and its length in bytes (null counts as empty)."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("tk"), F.octet_length(text).alias("tn")]


def to_roots(m: DataFrame, scratch: Scratch) -> DataFrame:
    """Pointers (u, to) doubled until each leads to a node that points to itself."""
    while True:
        up = m.select(F.col("u").alias("to"), F.col("to").alias("up"))
        new = scratch.save(m.select("u", "to").join(up, "to").select("u", F.col("up").alias("to"), (F.col("up") != F.col("to")).alias("moved")))
        if new.where("moved").isEmpty():
            scratch.drop(new)
            return m.select("u", "to")
        scratch.drop(m)
        m = new


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components by contraction to the smallest neighbour, with pointer jumping.

    edges(u long, v long), any direction, repeats and loops allowed. Returns (node, root) for every node on
    an edge, root the smallest node reachable. Each round every node points to the smallest of itself and its
    neighbours, pointers are doubled until they end at roots, and the edges are renamed to roots. A root alone in its
    tree has only smaller neighbours afterwards and moves in the next round, so two rounds halve the nodes at least:
    rounds grow with the logarithm of the nodes, doublings in a round with that of a chain. Minima are aggregated
    before the shuffle, so that a hub costs one row a task.
    """
    e = scratch.save(
        edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    )
    moves: list[DataFrame] = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = to_roots(scratch.save(both.groupBy("u").agg(F.least("u", F.min("v")).alias("to"))), scratch)
        moves.append(m)
        e2 = (
            e.join(m.select(F.col("u"), F.col("to").alias("mu")), "u")
            .join(m.select(F.col("u").alias("v"), F.col("to").alias("mv")), "v")
            .where("mu <> mv")
            .select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v"))
            .distinct()
        )
        old, e = e, scratch.save(e2)
        scratch.drop(old)
    if not moves:
        return e.select(F.col("u").alias("node"), F.col("u").alias("root"))
    out = moves[-1].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for m in reversed(moves[:-1]):
        nxt = out.select(F.col("node").alias("to"), F.col("root"))
        out = m.join(nxt, "to", "left").select(F.col("u").alias("node"), F.coalesce("root", "to").alias("root"))
    return out
