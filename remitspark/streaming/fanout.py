"""Several sinks of one source, watched together: if one fails the others stop, and all go on from their checkpoints.

Each sink is a query of its own with its own checkpoint, so a run after a failure reads what each has not written yet: a
file sink commits a batch's files once, and a sink by ``foreachBatch`` is called with the same batch number again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class SinkFailed(RuntimeError):
    """One sink or more failed; the others were stopped."""

    def __init__(self, failed: dict[str, str]) -> None:
        super().__init__("; ".join(f"{n}: {why}" for n, why in failed.items()))
        self.failed = failed


class Watch(StreamingQueryListener):
    """What the queries of a fan-out report: input rows by sink, and how each ended (None: in order)."""

    def __init__(self) -> None:
        self.name_of: dict[str, str] = {}
        self.rows: dict[str, int] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        if event.name:
            self.name_of[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:
        name = event.progress.name
        if name:
            self.rows[name] = self.rows.get(name, 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.name_of.get(str(event.runId))
        if name:
            self.ended[name] = event.exception


def run_together(spark: SparkSession, sinks: dict[str, Callable[[], StreamingQuery]], poll: float = 1.0) -> Watch:
    """Start every sink and wait until all have ended; at the first failure stop the rest and raise ``SinkFailed``."""
    watch, running = Watch(), {}
    spark.streams.addListener(watch)
    try:
        for name, start in sinks.items():
            running[name] = start()
        while any(q.isActive for q in running.values()):
            try:
                if spark.streams.awaitAnyTermination(poll):
                    spark.streams.resetTerminated()  # one that ended in order: wait for the others
            except StreamingQueryException:
                spark.streams.resetTerminated()
            if any(q.exception() for q in running.values()):
                break
        failed = {n: str(q.exception()) for n, q in running.items() if q.exception()}
        if failed:
            raise SinkFailed(failed)
        return watch
    finally:
        for q in running.values():
            if q.isActive:
                q.stop()
        spark.streams.removeListener(watch)
