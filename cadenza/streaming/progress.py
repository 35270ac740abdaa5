"""Progress of streaming queries as rows, from the engine's own events."""

from __future__ import annotations

import threading
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from cadenza.operators.rate import progress

SCHEMA = "query string, event string, batch long, samples long, frames long, played double, frames_per_second double, speed double"


class ProgressRows(StreamingQueryListener):
    """Keeps the last `most` events of all queries of a session; one row for a start, each micro-batch and an end."""

    def __init__(self, rate: int, frame: int = 1024, channels: int = 1, most: int = 10_000) -> None:
        self.rate, self.frame, self.channels = rate, frame, channels
        self.events: deque = deque(maxlen=most)
        self.lock = threading.Lock()

    def _add(self, *row) -> None:
        with self.lock:
            self.events.append(row)

    def onQueryStarted(self, event) -> None:
        self._add(str(event.id), "started", None, 0, 0, 0.0, 0.0, 0.0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = progress({"numInputRows": p.numInputRows, "durationMs": dict(p.durationMs)}, self.rate, self.frame, self.channels)
        self._add(str(p.id), "progress", p.batchId, p.numInputRows, int(found["frames"]), found["played"], found["frames_per_second"], found["speed"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add(str(event.id), "failed" if event.exception else "ended", None, 0, 0, 0.0, 0.0, 0.0)

    def table(self, spark: SparkSession) -> DataFrame:
        """The events so far."""
        with self.lock:
            return spark.createDataFrame(list(self.events), SCHEMA)


def watch(spark: SparkSession, rate: int, frame: int = 1024, channels: int = 1) -> ProgressRows:
    """A listener of all queries that start from now on; spark.streams.removeListener ends it."""
    listener = ProgressRows(rate, frame, channels)
    spark.streams.addListener(listener)
    return listener
