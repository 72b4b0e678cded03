"""Counters and histograms of one table object, and of streaming queries."""

from __future__ import annotations

import time
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql.streaming import StreamingQueryListener

#: Upper bounds of a histogram's buckets in milliseconds; the last one is open.
BOUNDS = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10_000, 60_000)


class Metrics:
    def __init__(self):
        self.counters: dict[str, int] = {}
        self.histograms: dict[str, list[int]] = {}

    def add(self, name: str, n: int = 1) -> None:
        self.counters[name] = self.counters.get(name, 0) + n

    def observe(self, name: str, ms: float) -> None:
        self.histograms.setdefault(name, [0] * (len(BOUNDS) + 1))[bisect_left(BOUNDS, ms)] += 1

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        """Counts the call, its failure if it has one, and its time."""
        began = time.perf_counter()
        self.add(name)
        try:
            yield
        except Exception:
            self.add(f"{name}_failed")
            raise
        finally:
            self.observe(f"{name}_ms", (time.perf_counter() - began) * 1000)

    def snapshot(self) -> dict:
        out: dict = dict(sorted(self.counters.items()))
        for name, counts in sorted(self.histograms.items()):
            out[name] = {("inf" if i == len(BOUNDS) else str(BOUNDS[i])): n for i, n in enumerate(counts) if n}
        return out


class StreamMetrics(StreamingQueryListener):
    """Batches, rows and times of the streaming queries of a session: ``spark.streams.addListener(StreamMetrics(metrics))``."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:
        self.metrics.add("queries_started")

    def onQueryProgress(self, event) -> None:
        self.metrics.add("batches")
        self.metrics.add("rows_in", event.progress.numInputRows)
        self.metrics.observe("batch_ms", event.progress.durationMs.get("triggerExecution", 0))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.metrics.add("queries_failed" if event.exception else "queries_ended")
