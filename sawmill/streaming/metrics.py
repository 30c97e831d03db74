"""Counts of what streams do: observed on the frames that are written, and told by Spark's progress events."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class Metrics:
    """Counters of a process. ``lag`` is the time from an entry's own timestamp until it could be queried, of the latest
    entry of each batch: for logs that are being written, the time from append to query."""

    batches: int = 0
    entries: int = 0
    rejects: int = 0
    input_rows: int = 0
    seconds: float = 0.0
    lag: float = 0.0
    most_lag: float = 0.0
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def add(self, **counts: float) -> None:
        with self.lock:
            for name, n in counts.items():
                setattr(self, name, getattr(self, name) + n)

    def render(self, prefix: str = "sawmill") -> str:
        """All values in the text form that monitoring systems scrape."""
        kinds = {"lag": "gauge", "most_lag": "gauge"}
        names = [n for n in self.__dataclass_fields__ if n != "lock"]
        return "".join(f"# TYPE {prefix}_{n} {kinds.get(n, 'counter')}\n{prefix}_{n} {getattr(self, n)}\n" for n in names)


class Observed:
    """A batch's frames with their rows counted as they are written: no pass of its own."""

    def __init__(self, entries: DataFrame, rejects: DataFrame):
        self.of_entries, self.of_rejects = Observation(), Observation()
        self.entries = entries.observe(self.of_entries, F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("Timestamp")).alias("latest"))
        self.rejects = rejects.observe(self.of_rejects, F.count(F.lit(1)).alias("n"))

    def told(self, metrics: Metrics) -> None:
        """Add what was written; only after both frames were."""
        found, rejected = _seen(self.of_entries), _seen(self.of_rejects)
        metrics.add(batches=1, entries=found.get("n", 0), rejects=rejected.get("n", 0))
        if found.get("latest") is not None:
            metrics.lag = time.time() - found["latest"] / 1e6
            metrics.most_lag = max(metrics.most_lag, metrics.lag)


def _seen(of: Observation) -> dict:
    """What was observed; nothing of a frame that was found to be empty before it ran, whose observation has no row."""
    try:
        return of.get
    except Py4JJavaError:
        return {}


class ProgressListener(StreamingQueryListener):
    """Adds each batch's input rows and duration: ``spark.streams.addListener(ProgressListener(metrics))``."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.metrics.add(input_rows=event.progress.numInputRows, seconds=event.progress.batchDuration / 1000)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
