"""Figures of runs as counters and a histogram of a meter: any object with create_counter and create_histogram, as tracing and
metrics libraries have them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from millrace.streaming.metrics import LATENCY

#: Figure, instrument and what it counts.
COUNTERS = (
    ("items_processed", "millrace.items.processed", "rows that a run has seen"),
    ("items_failed", "millrace.items.failed", "rows that failed"),
    ("items_filtered", "millrace.items.filtered", "rows that a filter turned away"),
    ("retries", "millrace.retries", "attempts after the first"),
    ("duplicates_filtered", "millrace.duplicates", "rows left out as duplicates"),
)


class Meters:
    """Adds each run's or micro-batch's figures to instruments, under the pipeline's name.

    Latencies are recorded as counted: the middle of a bucket, once for each call in it, at most `most` times a bucket and
    batch (a meter takes single values; buckets beyond that are thinned evenly with the counter of calls kept whole).
    """

    def __init__(self, meter: Any, pipeline: str | None = None, most: int = 1000) -> None:
        self._about = {"pipeline": pipeline or "millrace"}
        self._counters = {figure: meter.create_counter(name, unit="1", description=text) for figure, name, text in COUNTERS}
        self._calls = meter.create_counter("millrace.calls", unit="1", description="calls with a latency")
        self._latency = meter.create_histogram("millrace.latency", unit="ms", description="time of a row's calls")
        self._most = most

    def publish(self, figures: dict[str, Any], latencies: Sequence[int] = ()) -> None:
        """figures of one run or batch alone, not sums over batches; latencies: calls per bucket."""
        for figure, counter in self._counters.items():
            if figures.get(figure):
                counter.add(figures[figure], self._about)
        for i, n in enumerate(latencies):
            if n:
                self._calls.add(n, self._about)
                for _ in range(min(n, self._most)):
                    self._latency.record(LATENCY.low * LATENCY.base ** (i + 0.5), self._about)
