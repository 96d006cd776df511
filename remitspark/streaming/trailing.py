"""Trailing windows of a key kept in stream state.

A key's state is a ring of slots, one for each step of the windows that holds an event: no longer than a window, however
many windows cover it. Windows end at multiples of the step and hold the events of ``length`` seconds before their end. A
timer of event time closes them: as the watermark passes their end, windows that hold events are put out once, final, and
slots that no open window covers go; a key without slots loses its state. Each batch that changes a key also puts out its
latest window, the one that ends with the slot of its newest event. ``still_open`` reads the windows that the watermark has
not closed out of the state of a stream's checkpoint, so that closed and open ones together are all windows.

A row counts in the windows that the watermark has not closed when it arrives: one behind the watermark still counts in
windows that are open, and is ignored once all its windows are closed. Sums are of whole numbers (scaled amounts), so that
their order does not matter. State is kept in RocksDB, on the executors' disks and in the checkpoint, not in their memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Cents of an amount, and the scale of a discount.
CENTS, FINE = 100, 100_000
ROWS = "customer_id long, kind string, ends long, n long, amount long, discount long"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's setting is put back."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


class Trailing(StatefulProcessor):
    """State and output of one key; times are numbers of steps since 1970, but the watermark's milliseconds."""

    def __init__(self, length: int, step: int) -> None:
        if length % step:
            raise ValueError("a window is a whole number of steps")
        self.slots, self.ms = length // step, step * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "slot array<bigint>, n array<bigint>, amount array<bigint>, discount array<bigint>, closed bigint")

    def close(self) -> None:
        pass

    def load(self, now: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Slots in order, their sums, and the last closed end; a new key starts at the watermark."""
        if not self.ring.exists():
            return np.zeros(0, np.int64), np.zeros((0, 3), np.int64), now
        slot, n, amount, discount, closed = self.ring.get()
        return np.array(slot, np.int64), np.array([n, amount, discount], np.int64).T.reshape(-1, 3), closed

    def keep(self, slot: np.ndarray, sums: np.ndarray, closed: int) -> None:
        """Save what open windows need and ask to be called at the next end that closes one."""
        live = slot + self.slots > closed
        slot, sums = slot[live], sums[live]
        if not len(slot):
            self.ring.clear()
            return
        self.ring.update((slot.tolist(), *[c.tolist() for c in sums.T], closed))
        self.handle.registerTimer(int(max(slot[0], closed) + 1) * self.ms)

    def windows(self, key: tuple, slot: np.ndarray, sums: np.ndarray, ends: np.ndarray, kind: str) -> pd.DataFrame:
        total = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(sums, axis=0)])
        v = total[np.searchsorted(slot, ends - 1, "right")] - total[np.searchsorted(slot, ends - self.slots)]
        return pd.DataFrame({"customer_id": key[0], "kind": kind, "ends": ends * (self.ms // 1000), "n": v[:, 0], "amount": v[:, 1], "discount": v[:, 2]})

    def closing(self, slot: np.ndarray, after: int, to: int) -> np.ndarray:
        """Ends in (after, to] whose windows hold a slot."""
        found = []
        for s in slot.tolist():
            first, last = max(s, after) + 1, min(s + self.slots, to)
            if first <= last:
                found.append(np.arange(first, last + 1))
                after = last
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // self.ms
        slot, sums, closed = self.load(now)
        ends = self.closing(slot, closed, now)
        if len(ends):
            yield self.windows(key, slot, sums, ends, "closed")
        changed = False
        for part in rows:
            part = part[part["slot"] + self.slots > now]
            if len(part):
                g = part.groupby("slot")[["one", "amount", "discount"]].sum()
                all_slots, at = np.unique(np.concatenate([slot, g.index.to_numpy(np.int64)]), return_inverse=True)
                both = np.zeros((len(all_slots), 3), np.int64)
                np.add.at(both, at, np.concatenate([sums, g.to_numpy(np.int64)]))
                slot, sums, changed = all_slots, both, True
        if changed:
            yield self.windows(key, slot, sums, slot[-1:] + 1, "latest")
        self.keep(slot, sums, max(closed, now))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // self.ms
        slot, sums, closed = self.load(now)
        ends = self.closing(slot, closed, now)
        if len(ends):
            yield self.windows(key, slot, sums, ends, "closed")
        self.keep(slot, sums, max(closed, now))


def trailing(events: DataFrame, length: int, step: int, delay: str) -> DataFrame:
    """customer_id, kind (closed: final; latest: as of a customer's newest event), window_end, n, amount, discount of windows
    of ``length`` seconds each ``step`` seconds over a stream of events (customer_id, ts, amount, discount)."""
    scaled = lambda c, by: F.coalesce((F.col(c) * by).cast("long"), F.lit(0))
    slot = F.floor(F.unix_timestamp("ts") / step).cast("long")
    t = events.where("ts is not null and customer_id is not null").withWatermark("ts", delay).select("customer_id", slot.alias("slot"), F.lit(1).cast("long").alias("one"), scaled("amount", CENTS).alias("amount"), scaled("discount", FINE).alias("discount"))
    return scaled_back(t.groupBy("customer_id").transformWithStateInPandas(Trailing(length, step), ROWS, "append", "eventTime"))


def scaled_back(out: DataFrame) -> DataFrame:
    """Times and decimals from the whole numbers of ROWS."""
    return out.select("customer_id", "kind", F.timestamp_seconds("ends").alias("window_end"), "n", *[(F.col(c) / F.lit(s).cast("decimal(6,0)")).cast(f"decimal(24,{d})").alias(c) for c, s, d in (("amount", CENTS, 2), ("discount", FINE, 5))])


def still_open(spark: SparkSession, checkpoint: str, length: int, step: int) -> DataFrame:
    """The windows that hold events and were not closed when the stream of ``trailing`` over that checkpoint stopped, with its
    columns (kind: open). To be read inside ``rocks``."""
    of = Trailing(length, step)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for r in t.itertuples():
                slot, sums = np.array(r.slot, np.int64), np.array([r.n, r.amount, r.discount], np.int64).T
                yield of.windows((r.customer_id,), slot, sums, of.closing(slot, r.closed, slot[-1] + of.slots), "open")

    ring = spark.read.format("statestore").option("stateVarName", "ring").load(checkpoint)
    return scaled_back(ring.select("key.customer_id", "value.*").mapInPandas(run, ROWS))
