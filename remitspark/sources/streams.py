"""Event sources: files as a stream now, a broker later by another format; the schema is always given.

The test tables are single files. ``arrivals`` lays one down as several files in the order of its event time, so that
streams over it run in several micro-batches, oldest first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitspark.sources.scratch import shared_folder

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
ITEM_SCHEMA = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz"
#: Files that a table is laid down in, each a micro-batch.
FILES = 4
_laid: dict[tuple, str] = {}


def arrivals(spark: SparkSession, sf_dir: str, table: str, schema: str, order: list[str], files: int = FILES) -> str:
    """Folder of the table's rows in ``files`` files by ascending ``order``; laid down once an application."""
    sc = spark.sparkContext
    key = (sc.applicationId, sf_dir, table, files)
    fs_of = lambda p: p.getFileSystem(sc._jsc.hadoopConfiguration())
    path = sc._jvm.org.apache.hadoop.fs.Path
    if key in _laid and fs_of(path(_laid[key])).exists(path(_laid[key])):
        return _laid[key]
    out = shared_folder(spark, f"arrivals-{table}")
    names = [c.split()[0] for c in schema.split(", ")]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*names)
    rows.repartitionByRange(files, *order).write.parquet(out)
    # a file stream takes older files first
    fs = fs_of(path(out))
    found = sorted((s.getPath() for s in fs.listStatus(path(out)) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    for k, p in enumerate(found):
        fs.setTimes(p, 1_700_000_000_000 + 60_000 * k, -1)
    _laid[key] = out
    return out


def raw_stream(spark: SparkSession, sf_dir: str, table: str = "events", schema: str = EVENT_SCHEMA, order: tuple[str, ...] = ("ts", "event_id"), files_per_batch: int = 1) -> DataFrame:
    """Rows of a table as a stream, oldest first, some files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals(spark, sf_dir, table, schema, list(order)))


#: How late an event may be where a stream does not say otherwise; state of windows goes that long after their end.
DELAY = "10 minutes"


def event_stream(spark: SparkSession, sf_dir: str, delay: str | None = DELAY, files_per_batch: int = 1) -> DataFrame:
    """Events with event time ``ts`` (a timestamp, as watermarks need) and money as decimals; ``delay`` None: no watermark."""
    s = raw_stream(spark, sf_dir, files_per_batch=files_per_batch)
    k = F.get_json_object("props", "$.k").cast("decimal(6,0)")
    amount = F.col("value").cast("decimal(18,2)")
    t = s.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("customer_id"), F.col("event_type").alias("merchant_id"),
        amount.alias("amount"), (amount * k * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(18,5)").alias("discount"),
        (F.abs(F.hash("user_id")) % 32).alias("customer_bucket"),
    )
    return t.withWatermark("ts", delay) if delay else t


def replayed(events: DataFrame, start: str, speed: int, customers: int, delay: str = "1 minute") -> DataFrame:
    """Events at a multiple of their speed from ``start`` on, customers folded onto a few: a load that rules with short
    windows and high thresholds react to. The events' own watermark must be left out, as they get another time."""
    began = F.unix_timestamp(F.lit(start).cast("timestamp"))
    at = began + F.floor((F.unix_timestamp("ts") - began) / speed)
    return events.withColumn("ts", F.timestamp_seconds(at)).withColumn("customer_id", F.col("customer_id") % customers).withWatermark("ts", delay)
