"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards, a run for each arrival. Runs of similar size (the same
power of ``fan``) are a tier; where a tier has ``fan`` runs they are merged into one run of files of about
``target`` bytes, which may complete the next tier. What a table consists of is said by a manifest: a table of
(run, file, rows, bytes, tier) and a version file that names it. A version file is written under another name and
renamed, which fails where the version is there already: readers see a whole version or the one before, a writer that
dies leaves no version, and of two writers one must try again on the newer version. Files are never changed; ``vacuum`` deletes those that only forgotten versions name.

Cases: an empty arrival adds no shard; null ids and texts and repeated rows are stored as they are; any columns are
kept; a merge reads and writes rows as they are, in no order.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitspark.llm.common import scratch_dir

MANIFEST = "run string, tier int, path string, rows long, bytes long"


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, base: str, target: int = 128 << 20, smallest: int = 1 << 20, fan: int = 4) -> None:
        self.spark, self.base, self.target, self.smallest, self.fan = spark, base.rstrip("/"), target, smallest, fan
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(f"{self.base}/versions"))

    # versions
    def version(self) -> int:
        return max(self._versions(), default=0)

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(f"{self.base}/versions"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _pointer(self, version: int) -> dict:
        text = self.spark.read.text(f"{self.base}/versions/v{version:010d}.json", wholetext=True).first()
        return json.loads(text.value)

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if v == 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(self._pointer(v)["manifest"])

    def commit(self, manifest: DataFrame, on: int) -> int:
        """Write the manifest of the version after ``on``, then its version file, which must not be there yet."""
        where = f"{self.base}/manifests/{uuid.uuid4().hex}"
        manifest.select("run", "tier", "path", "rows", "bytes").coalesce(1).write.parquet(where)
        body = json.dumps({"manifest": where, "parent": on}).encode()
        final = self.path(f"{self.base}/versions/v{on + 1:010d}.json")
        draft = self.path(f"{self.base}/versions/draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(body))
        out.close()
        self._publish(draft, final)
        return on + 1

    def _publish(self, draft, final) -> None:
        """Rename without overwriting: one atomic step of the file system."""
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(self.fs.getUri(), sc._jsc.hadoopConfiguration())
        no_options = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            context.rename(draft, final, no_options)
        except Py4JJavaError as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Conflict(str(final)) from e
            raise

    # writing
    def tier(self, size: int) -> int:
        t = 0
        while size >= self.smallest * self.fan ** (t + 1):
            t += 1
        return t

    def _files(self, folder: str) -> DataFrame:
        """path, rows, bytes of the Parquet files below a folder; sizes from the listing, rows from the footers."""
        name = F.substring_index("path", "/", -1)
        sizes = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
        sizes = sizes.select("path", F.col("length").alias("bytes"), name.alias("name"))
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(folder)
        rows = rows.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("rows"))
        return sizes.join(rows, "name").select("path", "rows", "bytes")

    def _run(self, folder: str) -> DataFrame:
        files = self._files(folder)
        size = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first().b
        return files.select(F.lit(uuid.uuid4().hex[:12]).alias("run"), F.lit(self.tier(size)).alias("tier"), "path", "rows", "bytes")

    def append(self, df: DataFrame) -> int:
        """Write one arrival as a run of small shards and commit it."""
        folder = f"{self.base}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        return self.adopt([folder])

    def adopt(self, folders: list[str]) -> int:
        """Commit arrivals whose files were written below the store by one job, a run each."""
        on = self.version()
        m = self.manifest(on)
        for f in folders:
            m = m.unionByName(self._run(f))
        return self.commit(m.where("rows > 0"), on)

    def runs(self) -> list:
        """One row a run: run, tier, bytes, files."""
        return self.manifest().groupBy("run", "tier").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files")).orderBy("tier", "run").collect()

    def compact(self) -> int:
        """Merge full tiers, smallest first, until none is full; each merge is a version."""
        while True:
            runs = self.runs()
            full = next((t for t in sorted({r.tier for r in runs}) if sum(r.tier == t for r in runs) >= self.fan), None)
            if full is None:
                return self.version()
            self.merge([r for r in runs if r.tier == full][: self.fan], full)

    def merge(self, runs: list, tier: int) -> int:
        on = self.version()
        m = self.manifest(on)
        names = [r.run for r in runs]
        paths = [r.path for r in m.where(F.col("run").isin(names)).select("path").collect()]  # files of a tier's runs
        size = sum(r.bytes for r in runs)
        files = max(1, round(size / self.target))
        folder = f"{self.base}/data/{uuid.uuid4().hex}"
        self.spark.read.parquet(*paths).coalesce(files).write.option("compression", "zstd").parquet(folder)
        new = self._run(folder).withColumn("tier", F.greatest(F.col("tier"), F.lit(tier + 1)))
        return self.commit(m.where(~F.col("run").isin(names)).unionByName(new), on)

    def vacuum(self, keep: int = 1) -> int:
        """Forget versions before the last ``keep`` and delete the data files that only they name; returns how many.
        Files that no version names yet (an arrival being written) are left alone."""
        v = self.version()
        there = [k for k in self._versions() if k <= v]
        old, new = there[:-keep], there[-keep:]
        if not old:
            return 0
        union = lambda ks: reduce(DataFrame.unionByName, [self.manifest(k).select("path") for k in ks])
        n = 0
        for r in union(old).distinct().join(union(new).distinct(), "path", "left_anti").toLocalIterator():
            n += bool(self.fs.delete(self.path(r.path), False))
        for k in old:
            manifest = self._pointer(k)["manifest"]
            self.fs.delete(self.path(f"{self.base}/versions/v{k:010d}.json"), False)
            self.fs.delete(self.path(manifest), True)
        return n

    # reading
    def read(self, version: int | None = None) -> DataFrame:
        paths = [r.path for r in self.manifest(version).select("path").toLocalIterator()]
        if not paths:
            raise ValueError("the store has no shard")
        return self.spark.read.parquet(*paths)


#: Shares of sixteenths that the query's arrivals bring: four small ones, then three as large as those together.
ARRIVALS = (1, 1, 1, 1, 4, 4, 4)


def op9_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, arriving in seven parts, compacted: doc_id, text_sha256, shard, shard_rows, version."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex[:12]}"
    total, part = sum(ARRIVALS), F.pmod(F.xxhash64("doc_id"), F.lit(sum(ARRIVALS)))
    size = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    store = ShardStore(spark, base, target=32 << 20, smallest=max(1, size // (total * 8)))
    which, upto = F.lit(len(ARRIVALS) - 1), 0
    for k, share in enumerate(ARRIVALS):
        upto += share
        which = F.when((part < upto) & (part >= upto - share), k).otherwise(which)
    feed = f"{base}/data/feed"
    arrival = next(c for c in (f"arrival{i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    docs.withColumn(arrival, which).write.option("compression", "zstd").partitionBy(arrival).parquet(feed)
    for k in range(len(ARRIVALS)):
        folder = f"{feed}/{arrival}={k}"
        if store.fs.exists(store.path(folder)):
            store.adopt([folder])
            store.compact()
            store.vacuum()
    if store.version() == 0:
        return spark.createDataFrame([], "doc_id long, text_sha256 string, shard string, shard_rows long, version int")
    shard = lambda c: F.substring_index(F.url_decode(c), "/", -2)
    m = store.manifest().select(shard(F.col("path")).alias("shard"), F.col("rows").alias("shard_rows"))
    rows = store.read().select("doc_id", F.sha2("text", 256).alias("text_sha256"), shard(F.col("_metadata.file_path")).alias("shard"))
    return rows.join(F.broadcast(m), "shard").select("doc_id", "text_sha256", "shard", "shard_rows", F.lit(store.version()).alias("version"))
