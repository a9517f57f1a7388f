"""Ordered recurrences: level and velocity averages, prediction, parallelism and back-pressure controllers.

The folds run per key over rows in an explicit order with a tie-breaker; a task keeps the state of one key and no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import fold

TINY = 0.001


def level(old: float, x: float) -> float:
    """Level average: starts at the first value, follows spikes over three times the level fast."""
    if old < TINY:
        return x
    alpha = 0.8 if old > TINY and x > 3 * old else 0.2
    return alpha * x + (1 - alpha) * old


def velocity(old: float, change: float) -> float:
    return change if old < TINY else 0.1 * change + 0.9 * old


def ema(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """(key, n, level, velocity, prediction) after each key's last row; prediction is max(0, level + velocity).

    Rows without a value are left out.
    """

    def step(state: tuple, x: float) -> tuple:
        n, old, speed = state
        new = level(old, x)
        return n + 1, new, velocity(speed, new - old)

    rows = df.where(F.col(value).isNotNull())
    last = lambda s: (*s, max(0.0, s[1] + s[2]))
    return fold(rows, key, order, [F.col(value).cast("double")], lambda: (0, 0.0, 0.0), step, "n int, level double, velocity double, prediction double", last)


def throughput(df: DataFrame, key: str, order: Sequence[str], ts: str) -> DataFrame:
    """(key, throughput): average of 1 / seconds between neighbours (0.2 new, 0.8 old); equal times are skipped.

    Rows without a time are left out.
    """

    def step(state: tuple, t: float) -> tuple:
        before, rate = state
        if before is None or t <= before:
            return t, rate
        now = 1.0 / (t - before)
        return t, now if rate < TINY else 0.2 * now + 0.8 * rate

    rows = df.where(F.col(ts).isNotNull())
    return fold(rows, key, order, [F.col(ts).cast("timestamp").cast("double")], lambda: (None, 0.0), step, "throughput double", lambda s: (s[1],))


def parallelism(df: DataFrame, key: str, order: Sequence[str], latency_ms: str, cpu: int, low: int = 2, high: int = 32, target_ms: float = 10.0) -> DataFrame:
    """(key, n, parallelism) after each key's last row of a proportional controller that starts at `cpu`.

    An error (target less latency) within 5 ms changes nothing; else 1 to 3 steps, one per 20 ms, within the limits. Rows
    without a latency are left out.
    """
    low, high = max(1, min(low, high)), min(4 * cpu, max(low, high))

    def step(state: tuple, latency: float) -> tuple:
        n, now = state
        error = target_ms - latency
        if abs(error) < 5 or (now >= high and error > 0) or (now <= low and error < 0):
            return n + 1, now
        size = max(1, min(3, int(abs(error) / 20)))
        return n + 1, max(low, min(high, now + (size if error > 0 else -size)))

    rows = df.where(F.col(latency_ms).isNotNull())
    return fold(rows, key, order, [F.col(latency_ms).cast("double")], lambda: (0, min(max(cpu, low), high)), step, "n int, parallelism int", lambda s: s)


def target_fill(throughput: Column, predicted_ms: Column) -> Column:
    """Fill that back-pressure aims at: less for fast flows, less again if latency is about to rise."""
    base = F.when(throughput > 1000, 0.50).when(throughput < 100, 0.85).otherwise(0.70)
    return F.when(predicted_ms > 50, F.greatest(F.lit(0.30), base - 0.10)).otherwise(base)


def backpressure_delay(fill: Column, throughput: Column, predicted_ms: Column) -> Column:
    """Milliseconds to wait: 100 per unit of fill over the target, at most 200; waits of 1 or less are none."""
    delay = F.least(F.greatest(F.lit(100.0) * (fill - target_fill(throughput, predicted_ms)), F.lit(0.0)), F.lit(200.0))
    return F.when(delay > 1, delay).otherwise(0.0)
