"""Sliding windows of a key over a stream, batch by batch, with their state in a table.

A micro-batch is summed up in slots, one for each step of the windows. The state is the slots that windows not yet closed
cover, a row a key and slot: no more than events, however many windows cover one. Windows end at multiples of the step and
hold the events of ``length`` seconds before their end. Each batch closes, once and for good, the windows that the watermark
(the newest event of the batches before, less the delay) has passed; ``open`` gives the windows that are not closed yet, so
that closed and open ones together are all windows. A row counts in the windows that are not closed when it arrives.

Windows are put out as runs: those that end from ``first_end`` to ``last_end``, each step, all hold the same rows and so the
same sums. A slot begins one run as it enters and one as it leaves, where it lies in ``length / step`` windows;
``each_window`` lays windows out one by one. Runs are cumulative sums over slots that enter and leave, in whole numbers
(scaled amounts), so their order does not matter. What a batch reads and writes is named by its number, so a batch that is
run again gives the same tables; the work is Spark's, by shuffles and sorts, and nothing of a key passes through Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cents of an amount, and the scale of a discount.
CENTS, FINE = 100, 100_000
SUMS = ["n", "amount", "discount"]
SLOTS = "customer_id long, slot long, n long, amount long, discount long"
RUNS = "customer_id long, first long, last long, n long, amount long, discount long"
#: Before all windows: the watermark while there was no event.
NEVER = -(1 << 40)


class Sliding:
    def __init__(self, spark: SparkSession, base: str, length: int, step: int, delay: int) -> None:
        """Windows of ``length`` seconds each ``step`` seconds, closed ``delay`` seconds late, with their tables in ``base``."""
        if length % step:
            raise ValueError("a window is a whole number of steps")
        self.spark, self.base, self.length, self.step, self.delay, self.slots = spark, base, length, step, delay, length // step
        self.last, self.seen = -1, {}

    def _save(self, name: str, batch: int, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.base}/{name}/batch={batch}")
        return self._read(name, batch, df.schema)

    def _read(self, name: str, batch: int, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}/batch={batch}")

    def _newest(self, batch: int) -> int | None:
        """Time of the newest event up to a batch."""
        if batch < 0:
            return None
        if batch not in self.seen:  # of an earlier start
            self.seen[batch] = self._read("newest", batch, "newest long").first().newest
        return self.seen[batch]

    def mark(self, batch: int) -> int:
        """The last step that the watermark has passed after a batch."""
        newest = self._newest(batch)
        return NEVER if newest is None else (newest - self.delay) // self.step

    def _state(self, batch: int) -> DataFrame:
        return self._read("state", batch, SLOTS) if batch >= 0 else self.spark.createDataFrame([], SLOTS)

    def apply(self, events: DataFrame, batch: int) -> None:
        """Take in a micro-batch of events (customer_id, ts, amount, discount): close windows by the batches before, then add."""
        scaled = lambda c, by: F.coalesce(F.sum((F.col(c) * by).cast("long")), F.lit(0)).alias(c)
        at = F.unix_timestamp("ts")
        slots = events.where("ts is not null").groupBy("customer_id", F.floor(at / self.step).cast("long").alias("slot"))
        new = self._save("slots", batch, slots.agg(F.count("*").alias("n"), scaled("amount", CENTS), scaled("discount", FINE), F.max(at).alias("newest")))
        newest = max((x for x in (new.agg(F.max("newest")).first()[0], self._newest(batch - 1)) if x is not None), default=None)
        self._save("newest", batch, self.spark.createDataFrame([(newest,)], "newest long"))
        after, now = self.mark(batch - 2), self.mark(batch - 1)
        old = self._state(batch - 1)
        self._save("closed", batch, self.runs(old, after, now) if now > after else self.spark.createDataFrame([], RUNS))
        both = old.unionByName(new.drop("newest")).where(F.col("slot") + self.slots > now)
        self._save("state", batch, both.groupBy("customer_id", "slot").agg(*[F.sum(c).alias(c) for c in SUMS]))
        self.seen[batch], self.last = newest, batch

    def close(self) -> None:
        """At the end of the input, close what the watermark has passed."""
        self.apply(self.spark.createDataFrame([], "customer_id long, ts timestamp, amount decimal(18,2), discount decimal(18,5)"), self.last + 1)

    def runs(self, slots: DataFrame, after: int, to: int | None = None) -> DataFrame:
        """RUNS, in steps, of the windows over these slots that end in (after, to]."""
        enters = F.struct((F.col("slot") + 1).alias("first"), *SUMS)
        leaves = F.struct((F.col("slot") + self.slots + 1).alias("first"), *[(-F.col(c)).alias(c) for c in SUMS])
        w = W.partitionBy("customer_id").orderBy("first")
        t = slots.select("customer_id", F.explode(F.array(enters, leaves)).alias("x")).select("customer_id", "x.*")
        t = t.select("customer_id", "first", (F.lead("first").over(w) - 1).alias("last"), *[F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0)).alias(c) for c in SUMS])
        t = t.withColumn("first", F.greatest("first", F.lit(after + 1)))
        t = t.withColumn("last", F.least("last", F.lit(to))) if to is not None else t
        return t.where("n > 0 and first <= last")

    def closed(self, batch: int | None = None) -> DataFrame:
        """Runs of the windows that a batch has closed, or all batches have."""
        return self._timed(self._read("closed", batch, RUNS) if batch is not None else self.spark.read.schema(RUNS).parquet(f"{self.base}/closed"))

    def open(self) -> DataFrame:
        """Runs of the windows that hold events and are not closed."""
        return self._timed(self.runs(self._state(self.last), self.mark(self.last - 1)))

    def latest(self) -> DataFrame:
        """Of each customer with rows in the last batch the window that ends with the slot of the newest event: customer_id,
        last_end, n, amount, discount."""
        now = self.mark(self.last - 1)
        own = self._read("slots", self.last, SLOTS).where(F.col("slot") + self.slots > now).select("customer_id").distinct().hint("merge")
        t = self._state(self.last).join(own, "customer_id", "left_semi").withColumn("top", F.max("slot").over(W.partitionBy("customer_id")))
        g = t.where(F.col("slot") + self.slots > F.col("top")).groupBy("customer_id", "top").agg(*[F.sum(c).alias(c) for c in SUMS])
        rows = g.select("customer_id", (F.col("top") + 1).alias("first"), (F.col("top") + 1).alias("last"), *SUMS)
        return self._timed(self._save("latest", self.last, rows)).drop("first_end")

    def _timed(self, runs: DataFrame) -> DataFrame:
        """Times and decimals from whole numbers."""
        money = [(F.col(c) / F.lit(s).cast("decimal(6,0)")).cast(f"decimal(24,{d})").alias(c) for c, s, d in (("amount", CENTS, 2), ("discount", FINE, 5))]
        return runs.select("customer_id", *[F.timestamp_seconds(F.col(c) * self.step).alias(f"{c}_end") for c in ("first", "last")], "n", *money)

    def each_window(self, runs: DataFrame) -> DataFrame:
        """One row a window: window_start and window_end instead of the run's ends."""
        ends = F.sequence(F.unix_timestamp("first_end"), F.unix_timestamp("last_end"), F.lit(self.step).cast("long"))
        t = runs.withColumn("ends", F.explode(ends)).drop("first_end", "last_end")
        return t.withColumns({"window_start": F.timestamp_seconds(F.col("ends") - self.length), "window_end": F.timestamp_seconds("ends")}).drop("ends")

    def by_start_day(self, runs: DataFrame) -> DataFrame:
        """Runs cut by the days on which their windows start, with day and the number of windows; none is laid out one by one."""
        first, last = (F.unix_timestamp(c) - self.length for c in ("first_end", "last_end"))
        days = F.sequence(F.to_date(F.timestamp_seconds(first)), F.to_date(F.timestamp_seconds(last)), F.expr("INTERVAL 1 DAY"))
        t = runs.withColumn("date_", F.explode(days))
        begins, ends = (F.unix_timestamp(d.cast("timestamp")) for d in (F.col("date_"), F.date_add("date_", 1)))
        before = F.ceil((F.greatest(begins, first) - first) / self.step)
        windows = F.floor((F.least(ends - 1, last) - first) / self.step) + 1 - before
        return t.withColumns({"day": F.date_format("date_", "yyyy-MM-dd"), "windows": windows}).where("windows > 0").drop("date_")


def number(step: int):
    """How many windows a run is."""
    return F.floor((F.unix_timestamp("last_end") - F.unix_timestamp("first_end")) / step) + 1
