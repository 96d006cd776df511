"""Keyed tables for foreachBatch sinks: immutable parts, a version file, and the last batch applied.

A table is cut into parts by a hash of its keys or by the day of a time column. Parts by keys hold about ``part_rows``
rows: once they hold four times that on average, the next batch cuts the table anew, so that a batch of a few keys rewrites
a few parts of a large table, and a table is cut anew only as often as it has grown fourfold. A batch rewrites the parts
that its rows fall into, and then publishes one version file that names all parts and the last batch of each writer; a replayed
batch finds its number there and does nothing, so every merge below is applied once. A version file is written under
another name and renamed without overwriting: readers see a whole version or the one before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Change = Callable[[DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer published this version first."""


#: Rows of a part by keys, about.
PART_ROWS = 50_000


class SnapshotTable:
    def __init__(self, spark: SparkSession, base: str, schema: str, keys: list[str] | None = None, parts: int = 8, day: str | None = None, part_rows: int = PART_ROWS) -> None:
        self.spark, self.base, self.schema = spark, base.rstrip("/"), schema
        self.types = spark.createDataFrame([], schema).schema
        self.keys, self.parts, self.day, self.part_rows = keys, parts, day, part_rows
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(f"{self.base}/versions"))

    def part(self, parts: int) -> Column:
        """The part of a row, as text, of so many."""
        if self.day:
            return F.coalesce(F.date_format(self.day, "yyyy-MM-dd"), F.lit("none"))
        return F.pmod(F.xxhash64(*self.keys), F.lit(parts)).cast("string") if self.keys else F.lit("0")

    def _state(self) -> tuple[int, dict]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(f"{self.base}/versions"))]
        v = max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)
        return v, self._version(v)

    def _version(self, v: int) -> dict:
        if not v:
            return {"parts": {}, "batches": {}, "rows": {}, "cut": self.parts}
        return json.loads(self.spark.read.text(f"{self.base}/versions/v{v:010d}.json", wholetext=True).first().value)

    def _publish(self, version: int, state: dict) -> None:
        draft, final = self.path(f"{self.base}/versions/draft-{uuid.uuid4().hex}"), self.path(f"{self.base}/versions/v{version:010d}.json")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        try:
            hadoop.FileContext.getFileContext(self.fs.getUri(), sc._jsc.hadoopConfiguration()).rename(draft, final, sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except Py4JJavaError as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Conflict(str(final)) from e
            raise

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*sorted(folders)) if folders else self.spark.createDataFrame([], self.schema)

    def version(self) -> int:
        """The number of the current version; 0 before the first."""
        return self._state()[0]

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is, or as a version had it."""
        state = self._state()[1] if version is None else self._version(version)
        return self._rows(list(state["parts"].values()))

    def apply(self, change: Change, batch: int, writer: str = "") -> bool:
        """Publish change(table) unless this batch of the writer was applied before. A change that names its new rows (``change.new``)
        sees and rewrites only the parts those fall into; ``change.keep`` tells from a part's name whether it stays as
        it is (True), goes (False), or is rewritten (None)."""
        v, state = self._state()
        if batch <= state["batches"].get(writer, -1):
            return False
        parts, rows_of, cut = dict(state["parts"]), dict(state["rows"]), state["cut"]
        wanted = -(-sum(rows_of.values()) // self.part_rows) if self.keys and not self.day else 0
        anew = wanted > 4 * cut
        cut = max(cut, 1 << (wanted - 1).bit_length()) if anew else cut
        new, keep = getattr(change, "new", None), getattr(change, "keep", None)
        if anew:
            touched = set(parts) | {"*"}
        elif new is not None and (self.keys or self.day):
            own = [F.col(c).cast(self.types[c].dataType).alias(c) for c in (self.keys or [self.day])]
            touched = {r.p for r in new.select(*own).select(self.part(cut).alias("p")).distinct().collect()}  # at most one a part
        elif keep is not None and self.day:
            fate = {p: keep(p) for p in parts}
            parts = {p: f for p, f in parts.items() if fate[p] is not False}
            touched = {p for p, f in fate.items() if f is None}
        else:
            touched = set(parts) | {"*"}
        if touched:
            old = [parts.pop(p) for p in list(parts) if p in touched]
            data = f"{self.base}/data/{uuid.uuid4().hex}"
            rows_of = {p: n for p, n in rows_of.items() if p in parts}
            rows = change(self._rows(old)).select(*[F.col(f.name).cast(f.dataType) for f in self.types.fields])
            rows.withColumn("part_", self.part(cut)).hint("rebalance", "part_").write.partitionBy("part_").parquet(data)
            for s in self.fs.listStatus(self.path(data)):
                name = s.getPath().getName()
                if name.startswith("part_="):
                    parts[name.removeprefix("part_=")] = f"{data}/{name}"
            if self.keys and not self.day:
                got = self.spark.read.schema(f"{self.keys[0]} {self.types[self.keys[0]].dataType.simpleString()}, part_ string").parquet(data) if len(parts) > len(rows_of) else None
                rows_of |= {r.part_: r["count"] for r in got.groupBy("part_").count().collect()} if got is not None else {}  # one a part
        self._publish(v + 1, {"parts": parts, "rows": rows_of, "cut": cut, "batches": state["batches"] | {writer: batch}})
        return True


def merged(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the tables: joined by sort and merge. Rows of few columns, nulls or one value take few bytes
    in files and shuffles, and a broadcast chosen by these would be built up on the driver however many rows they are."""
    return side.hint("merge")


def on(new: DataFrame, change: Change) -> Change:
    """A change that concerns the parts of ``new`` only."""
    change.new = new
    return change


def upsert(new: DataFrame, keys: list[str]) -> Change:
    """New values that are not null win, other columns and rows survive."""

    def change(old: DataFrame) -> DataFrame:
        o, n = old.alias("o"), new.alias("n")
        joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
        return joined.select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in old.columns])

    return on(new, change)


def one_a_key(new: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: the smallest by its other columns, so that the order of rows does not matter."""
    rest = [c for c in new.columns if c not in keys]
    if not rest:
        return new.distinct()
    return new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("x")).select(*[F.col(c) if c in keys else F.col(f"x.{c}") for c in new.columns])


def keep_first(new: DataFrame, keys: list[str]) -> Change:
    """Insert rows with unknown keys; what is there stays."""
    return on(new, lambda old: old.unionByName(one_a_key(new, keys).join(old, keys, "left_anti").select(*old.columns)))


def insert_outcomes(table: SnapshotTable, new: DataFrame, keys: list[str]) -> DataFrame:
    """(outcome, n): how many rows an insert-if-absent would seed and skip on the table as it is."""
    known = table.read().select(*keys).distinct().withColumn("known", F.lit(True))
    return one_a_key(new, keys).join(known, keys, "left").groupBy(F.when(F.col("known"), "skipped").otherwise("seeded").alias("outcome")).agg(F.count("*").alias("n"))


def update_latest(new: DataFrame, keys: list[str], order: str) -> Change:
    """Within the batch the latest row of a key (ties: the largest by all columns); only keys already there change."""
    rest = [c for c in new.columns if c not in keys]
    latest = new.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("order_"), *rest)).alias("x"))

    def change(old: DataFrame) -> DataFrame:
        n = latest.select(*keys, *[F.col(f"x.{c}").alias(f"{c}__new") for c in rest])
        j = old.join(merged(n), keys, "left")
        return j.select(*[F.coalesce(f"{c}__new", c).alias(c) if f"{c}__new" in j.columns else F.col(c) for c in old.columns])

    return on(new, change)


def replace_by_key(new: DataFrame, keys: list[str]) -> Change:
    """Rows of the batch take the place of rows with their keys."""
    return on(new, lambda old: old.join(merged(new), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns)))


def upsert_stamped(new: DataFrame, keys: list[str], at: Column, created: str = "created_at", updated: str = "updated_at") -> Change:
    """Rows of the batch take the place of rows with their keys and get the time of the update; the time of creation is
    set once, when a key is new."""

    def change(old: DataFrame) -> DataFrame:
        first = old.select(*keys, F.col(created).alias("first_"))
        rows = new.join(first, keys, "left").withColumn(created, F.coalesce("first_", at)).withColumn(updated, at)
        return old.join(new, keys, "left_anti").select(*old.columns).unionByName(rows.select(*old.columns))

    return on(new, change)


def accumulate(new: DataFrame, keys: list[str], sums: list[str], lows: list[str], highs: list[str]) -> Change:
    """Counters add up, first and last times move outwards."""

    def change(old: DataFrame) -> DataFrame:
        both = old.unionByName(new.select(*old.columns))
        return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs]).select(*old.columns)

    return on(new, change)


def retain(as_of: str, time: str, days: int) -> Change:
    """Drop rows older than so many days before ``as_of`` (a timestamp as text). A table cut by day loses whole parts
    and rewrites only the day in which the limit lies."""
    limit = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")

    def keep(day: str) -> bool | None:
        import datetime as dt

        if day == "none":
            return False
        first = dt.datetime.fromisoformat(as_of) - dt.timedelta(days=days)
        d = dt.date.fromisoformat(day)
        return None if d == first.date() else d > first.date()

    change = lambda old: old.where(F.col(time) >= limit)
    change.keep = keep
    return change
