"""Lookup sides that change while a stream runs: read again by each micro-batch, at the version that the table has then.

A static side in the plan of a stream is fixed when the query starts. Here the join is made inside ``foreachBatch``, with
the snapshot table's current version, so that an event that comes after a change sees what the change left, and one that
came before it has seen what was there. The version that a batch saw is written beside its rows: a batch that is replayed
after a failure reads that version again, not a newer one, and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from remitspark.sources.scratch import shared_folder
from remitspark.streaming.tables import SnapshotTable


class Lookup:
    """The versions of a table that the batches of one consumer saw."""

    def __init__(self, table: SnapshotTable, seen: str | None = None) -> None:
        self.table, self.spark = table, table.spark
        self.seen = (seen or shared_folder(table.spark, "seen")).rstrip("/")

    def version_of(self, batch: int) -> int:
        """The version that a batch reads: the current one, or the one that it read before."""
        fs, path = self.table.fs, self.table.path
        named = path(f"{self.seen}/{batch}")
        if not fs.exists(named):
            current = self.table.version()
            draft = path(f"{self.seen}/{batch}.draft")
            out = fs.create(draft, True)
            out.write(bytearray(str(current).encode()))
            out.close()
            fs.rename(draft, named)
            return current
        return int(self.spark.read.text(f"{self.seen}/{batch}").first().value)

    def side(self, batch: int) -> DataFrame:
        return self.table.read(self.version_of(batch))


def enriched_by(lookup: Lookup, keys: list[str], columns: list[str], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch with the lookup side's columns as they are now, null where it has no such key."""

    def each(df: DataFrame, batch: int) -> None:
        side = lookup.side(batch).select(*keys, *columns)
        write(df.join(side, keys, "left"), batch)

    return each
