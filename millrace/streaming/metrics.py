"""Counts, exports and health of a run, batch or streaming."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from millrace.operators.sketches import LogHistogram
from millrace.plans.envelope import ERROR, FILTERED, ok

#: Names of exported figures, in order.
KEYS = ("items_processed", "items_succeeded", "items_failed", "items_filtered", "duplicates_filtered", "retries", "avg_latency_ms", "queue_size", "elapsed_ms")
PREFIX = "millrace_"
#: Buckets of the latencies that a run counts: a percentile is right to half a bucket, a seventh of its value.
LATENCY, _LATENCY = LogHistogram(0.1, 100_000.0, 50), "latency_"


def counters(df: DataFrame | None = None) -> list[Column]:
    """Aggregates over enveloped rows; with df, also retries, refusals by a breaker and latencies if it has `attempts` and
    `elapsed_ms`.

    Latencies are counted by buckets, so that figures of tasks, batches and runs add up and percentiles come from the sums.
    """
    filtered = F.col(ERROR)["category"].eqNullSafe(F.lit(FILTERED))
    have = set(df.columns) if df is not None else set()
    refused = F.count_if(F.col(ERROR)["category"].eqNullSafe(F.lit("CircuitBreaker"))).alias("items_refused")
    more = [F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"), refused] if "attempts" in have else []
    if {"attempts", "elapsed_ms"} <= have:
        bucket = F.when((F.col("attempts") > 0) & (F.col("elapsed_ms") > 0), LATENCY.bucket(F.col("elapsed_ms") / F.lit(LATENCY.low)))
        more += [F.count_if(bucket == i).alias(f"{_LATENCY}{i}") for i in range(LATENCY.buckets)]
    more += [F.avg(F.when(F.col("attempts") > 0, F.col("elapsed_ms"))).alias("avg_latency_ms")] if {"attempts", "elapsed_ms"} <= have else []
    return [
        F.count(F.lit(1)).alias("items_processed"),
        F.count_if(ok()).alias("items_succeeded"),
        F.count_if(~ok() & ~filtered).alias("items_failed"),
        F.count_if(filtered).alias("items_filtered"),
        *more,
    ]


def observed(df: DataFrame, name: str = "millrace") -> tuple[DataFrame, Observation]:
    """df that counts itself while an action runs; no second pass."""
    seen = Observation(name)
    return df.observe(seen, *counters(df)), seen


def summary(df: DataFrame) -> DataFrame:
    """The counters as one row."""
    return df.agg(*counters())


class RunningLatency:
    """Latency counts that add up over batches and runs, and their percentiles."""

    def __init__(self) -> None:
        self.counts = [0] * LATENCY.buckets

    def add(self, figures: dict[str, Any]) -> dict[str, Any]:
        """Take the bucket counts out of figures; the rest with p50_latency_ms to p99_latency_ms, if any call was counted."""
        for i in range(LATENCY.buckets):
            self.counts[i] += figures.get(f"{_LATENCY}{i}") or 0
        rest = {k: v for k, v in figures.items() if not (k.startswith(_LATENCY) and k.removeprefix(_LATENCY).isdigit())}
        return rest | ({f"p{round(100 * p)}_latency_ms": self.percentile(p) for p in (0.5, 0.95, 0.99)} if any(self.counts) else {})

    def percentile(self, p: float) -> float:
        """The middle of the first bucket whose running count reaches p of all."""
        rank, run = math.ceil(p * sum(self.counts)), 0
        for i, n in enumerate(self.counts):
            run += n
            if n and run >= rank:
                return LATENCY.low * LATENCY.base ** (i + 0.5)
        return 0.0


def complete(figures: dict[str, Any]) -> dict[str, Any]:
    return {k: figures.get(k, 0) for k in KEYS}


def to_json(figures: dict[str, Any]) -> str:
    return json.dumps(complete(figures))


def to_prometheus(figures: dict[str, Any]) -> str:
    return "".join(f"{PREFIX}{k} {v}\n" for k, v in complete(figures).items())


def readiness(queue_size: Column, failures: Column) -> Column:
    """Degraded with more than 1000 rows waiting or any failure, else Healthy."""
    return F.when(queue_size > 1000, "Degraded").when(failures > 0, "Degraded").otherwise("Healthy")


def liveness(paused: bool) -> str:
    return "Unhealthy" if paused else "Healthy"


def dashboard(state: str, figures: dict[str, Any], p99_ms: float | None = None, breaker: str | None = None) -> dict[str, Any]:
    """What a dashboard shows of a run; p99 and the breaker's state come from the figures unless they are given.

    The breaker counts as open in figures that tell of refused calls.
    """
    p99_ms = figures.get("p99_latency_ms") if p99_ms is None else p99_ms
    if breaker is None and "items_refused" in figures:
        breaker = "Open" if figures["items_refused"] else "Closed"
    return {"state": state, "current": figures.get("items_processed", 0), "elapsed_ms": figures.get("elapsed_ms", 0), "p99_latency_ms": p99_ms, "circuit_breaker": breaker or "N/A", "metrics": complete(figures)}


class ProgressListener(StreamingQueryListener):
    """Gives each micro-batch's figures to a callback; percentiles of latency are those of all batches so far."""

    def __init__(self, on_metrics: Callable[[dict], None] | None, publish: Callable[[dict, list[int]], None] | None = None, starting: Callable[[], bool] | None = None) -> None:
        """publish: gets each batch's figures and latency counts; starting: whether a query that starts now is one to listen
        to (all are, without it). Spark tells of a start while the start is being made."""
        self.on_metrics, self.publish, self.starting, self.latency = on_metrics, publish, starting, RunningLatency()
        self.ids: set[str] = set()

    def onQueryStarted(self, event: Any) -> None:
        if self.starting and self.starting():
            self.ids.add(str(event.id))

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        if self.starting and str(p.id) not in self.ids:
            return
        seen = p.observedMetrics.get("millrace") if p.observedMetrics else None
        figures = {k: v or 0 for k, v in seen.asDict().items()} if seen else {"items_processed": p.numInputRows}
        waiting = [s.metrics.get("numFilesOutstanding") for s in p.sources if s.metrics]  # of file sources
        before = list(self.latency.counts)
        figures = self.latency.add(figures)
        if self.publish:
            self.publish(figures, [b - a for a, b in zip(before, self.latency.counts)])
        if self.on_metrics is None:
            return
        figures |= {"queue_size": sum(int(w) for w in waiting if w)} if any(waiting) else {}
        self.on_metrics(figures | {"elapsed_ms": p.batchDuration, "batch": p.batchId})

    def onQueryIdle(self, event: Any) -> None: ...

    def onQueryTerminated(self, event: Any) -> None: ...
