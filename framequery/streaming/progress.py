"""A run's totals from the progress that Spark reports, flushed when the stream ends, however it ends."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class Totals:
    """Input rows, batches with data, milliseconds by what they were spent on, and the error that ended the run, if one did."""

    rows: int = 0
    batches: int = 0
    milliseconds: dict[str, int] = field(default_factory=dict)
    error: str | None = None


class RunListener(StreamingQueryListener):
    """Totals of the queries called ``name``; ``flush`` gets them once, at the end, also after an error.

    A batch that is reported again after a restart counts once: its number is kept.
    """

    def __init__(self, name: str, flush: Callable[[Totals], None]):
        self.name, self.flush, self.totals = name, flush, Totals()
        self.ids: set[str] = set()
        self.seen: set[int] = set()
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.ids.add(str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name or p.batchId in self.seen or not p.numInputRows:
            return
        self.seen.add(p.batchId)
        self.totals.rows += p.numInputRows
        self.totals.batches += 1
        for what, spent in dict(p.durationMs).items():
            self.totals.milliseconds[what] = self.totals.milliseconds.get(what, 0) + int(spent)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) in self.ids and not self.ended.is_set():
            self.totals.error = str(event.exception) if event.exception else None
            try:
                self.flush(self.totals)
            finally:
                self.ended.set()


def watch(spark: SparkSession, name: str, flush: Callable[[Totals], None]) -> RunListener:
    """Listens to the query that will be started under ``name``."""
    listener = RunListener(name, flush)
    spark.streams.addListener(listener)
    return listener


def settle(spark: SparkSession, listener: RunListener, seconds: float = 60) -> Totals:
    """The totals, once the end has been reported and flushed."""
    if not listener.ended.wait(seconds):
        raise TimeoutError(f"the end of {listener.name} was not reported")
    spark.streams.removeListener(listener)
    return listener.totals
