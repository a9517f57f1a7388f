"""Streams: dedup inside a watermark, windows, stateful folds, fan-out per micro-batch, and the life of a query."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.resilience import CircuitBreaker
from millrace.sources.sinks import Sink, fan_out
from millrace.streaming.keytable import KeyTable

STATES = ("NotStarted", "Running", "Paused", "Completed", "Faulted", "Cancelled")


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """df with `ts` as a timestamp under a watermark (a timestamp without zone can't have one)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_dedup(df: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return event_time(df, ts, delay).dropDuplicatesWithinWatermark(list(keys))


def tumbling(df: DataFrame, ts: str, delay: str, width: str, by: Sequence[str], *aggs: Column, slide: str | None = None) -> DataFrame:
    """Aggregates of tumbling or sliding windows; rows later than the watermark are left out."""
    return event_time(df, ts, delay).groupBy(F.window(ts, width, slide), *by).agg(*aggs)


def sessions(df: DataFrame, ts: str, delay: str, gap: str, by: Sequence[str], *aggs: Column) -> DataFrame:
    return event_time(df, ts, delay).groupBy(F.session_window(ts, gap), *by).agg(*aggs)


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, right_ts: str, delay: str, before: str, after: str = "0 seconds", how: str = "inner") -> DataFrame:
    """Rows of both streams (or tables) with equal keys, the right one from `before` earlier to `after` later than the left.

    Watermarks on both sides bound the state. Columns of the right side are prefixed by right_; null keys match nothing.
    """
    right = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns])
    a, b = event_time(left, ts, delay), event_time(right, f"right_{right_ts}", delay)
    when = F.col(f"right_{right_ts}").between(F.col(ts) - F.expr(f"interval {before}"), F.col(ts) + F.expr(f"interval {after}"))
    same = [F.col(k) == F.col(f"right_{k}") for k in keys]
    return a.join(b, reduce(lambda x, y: x & y, [*same, when]), how)


def _expired(state: GroupState) -> bool:
    """Whether the key's time is over: then its state is forgotten."""
    if state.hasTimedOut:
        state.remove()
    return not state.exists and state.hasTimedOut


def _expire_after(state: GroupState, newest_s: float, expire_s: float | None) -> None:
    if expire_s is not None:
        state.setTimeoutTimestamp(max(math.ceil((newest_s + expire_s) * 1000), state.getCurrentWatermarkMs() + 1))


def _timed(df: DataFrame, ts: str, expire_s: float | None, delay: str) -> tuple[DataFrame, str]:
    """The rows and the kind of timeout: by event time, so that a stream without news settles."""
    return (df, GroupStateTimeout.NoTimeout) if expire_s is None else (event_time(df, ts, delay), GroupStateTimeout.EventTimeTimeout)


def stream_ema(df: DataFrame, key: str, ts: str, value: str, order: Sequence[str] = (), expire_s: float | None = None, delay: str = "0 seconds") -> DataFrame:
    """(key, n, level, velocity, prediction) per key and micro-batch; the state is three numbers a key.

    Rows of a micro-batch go by ts, then by the columns `order`, then by value, so ties are settled; rows without a value
    are left out. With expire_s, a key whose next row is more than so many seconds of event time after its last starts anew,
    and is forgotten when the watermark, `delay` behind the newest row, has passed that time; rows behind the watermark are
    dropped. ordered_fold() of streaming.state gives results that don't depend on batches.
    """
    df, wait = _timed(df, ts, expire_s, delay)
    kind = df.schema[key].dataType.simpleString()
    out = f"{key} {kind}, n long, level double, velocity double, prediction double"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _expired(state):
            return
        n, level, velocity, last = state.get if state.exists else (0, 0.0, 0.0, None)
        rows = pd.concat(list(frames)).sort_values([ts, *order, value]).dropna(subset=[value])
        for x, t in zip(rows[value].astype(float), rows[ts].astype("datetime64[us]").astype("int64") / 1e6):
            if expire_s is not None and last is not None and t - last > expire_s:
                n, level, velocity = 0, 0.0, 0.0
            last = t if last is None else max(last, t)
            old = level
            level = x if old < 0.001 else (0.8 if x > 3 * old else 0.2) * x + (0.2 if x > 3 * old else 0.8) * old
            change = level - old
            velocity = change if velocity < 0.001 else 0.1 * change + 0.9 * velocity
            n += 1
        if last is None:
            return
        state.update((n, level, velocity, last))
        _expire_after(state, last, expire_s)
        yield pd.DataFrame([[k[0], n, level, velocity, max(0.0, level + velocity)]], columns=[key, "n", "level", "velocity", "prediction"])

    return df.select(key, ts, value, *order).groupBy(key).applyInPandasWithState(step, out, "n long, level double, velocity double, last double", "update", wait)


def stream_breaker(df: DataFrame, key: str, ts: str, ok_col: str, order: Sequence[str] = (), expire_s: float | None = None, delay: str = "0 seconds", **settings: Any) -> DataFrame:
    """(key, seen, refused, cb_state, cb_ewma_failure_rate) per key and micro-batch, by a breaker whose state outlives batches.

    Rows of a micro-batch go by ts, then by the columns `order`, failures last among equals. expire_s and delay: as of
    stream_ema().
    """
    df, wait = _timed(df, ts, expire_s, delay)
    kind = df.schema[key].dataType.simpleString()
    out = f"{key} {kind}, seen long, refused long, cb_state string, cb_ewma_failure_rate double"
    kept = "seen long, refused long, state string, ewma double, opened double, probes long, wins long, times array<double>, goods array<boolean>, last double"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _expired(state):
            return
        breaker, seen, refused = CircuitBreaker(**settings), 0, 0
        if state.exists:
            seen, refused, breaker.state, breaker.ewma, breaker.opened, breaker.probes, breaker.probe_successes, times, goods, _ = state.get
            for t, g in zip(times, goods):
                breaker.window.append((t, g))
                breaker.failures += not g
        rows = pd.concat(list(frames)).sort_values(["_t", *order, "_good"], ascending=[True, *[True] * len(order), False])
        last = None
        for t, good in rows[["_t", "_good"]].itertuples(index=False):
            before = last if last is not None else (state.get[-1] if state.exists else None)
            if expire_s is not None and before is not None and t - before > expire_s:
                breaker, seen, refused = CircuitBreaker(**settings), 0, 0
            last = t if before is None else max(before, t)
            seen += 1
            if breaker.allow(t):
                breaker.record(t, bool(good))
            else:
                refused += 1
        state.update((seen, refused, breaker.state, breaker.ewma, breaker.opened, breaker.probes, breaker.probe_successes, [t for t, _ in breaker.window], [g for _, g in breaker.window], last))
        _expire_after(state, last, expire_s)
        yield pd.DataFrame([[k[0], seen, refused, breaker.state, breaker.ewma]], columns=[key, "seen", "refused", "cb_state", "cb_ewma_failure_rate"])

    rows = df.select(key, *order, *([ts] if expire_s is not None else []), F.col(ts).cast("timestamp").cast("double").alias("_t"), F.col(ok_col).alias("_good"))
    return rows.groupBy(key).applyInPandasWithState(step, out, kept, "update", wait)


class DedupSet:
    """A dedup set that outlives batches and gives keys back, kept in a KeyTable.

    admit(batch, n) gives the batch's rows whose key is new, one per key, and remembers the keys; remove(keys, n) forgets
    keys, so that they are new again. A batch that runs again sees the table as it was before it. Exact: no new key is taken
    for an old one; a null is a key like others. A batch reads the buckets that its keys fall into and writes its keys alone.
    """

    def __init__(self, path: str, keys: Sequence[str], buckets: int = 64) -> None:
        self.path, self.keys = path.rstrip("/"), list(keys)
        self._table = KeyTable(f"{self.path}/keys", keys, buckets)

    def admit(self, batch: DataFrame, n: int) -> DataFrame:
        spark = batch.sparkSession
        # The rows admitted are written first: what comes back is exactly those.
        rows = f"{self.path}/admitted"
        self._table.without(batch.dropDuplicates(self.keys), n).write.mode("overwrite").parquet(rows)
        new = spark.read.schema(batch.schema).parquet(rows)
        self._table.put(new, n)
        return new

    def remove(self, keys: DataFrame, n: int) -> None:
        """As a step of its own number: forget the keys."""
        self._table.put(keys.select(*self.keys).distinct(), n, alive=False)


class StreamRun:
    """A streaming pipeline: every micro-batch goes to every sink; pause and resume restart from the checkpoint.

    Delivery: a batch that runs again after a failure replaces what it wrote in sinks that write by batch number (files,
    JSON, dead letters), once in effect; other sinks get it at least once. prepare(batch, n) runs before the sinks.
    """

    def __init__(self, df: DataFrame, sinks: Sequence[Sink], checkpoint: str, on_state: Callable[[str, str], None] | None = None, prepare: Callable[[DataFrame, int], DataFrame] | None = None, mode: str = "append", **trigger: Any) -> None:
        self._prepare, self._mode = prepare, mode
        self._df, self._sinks, self._checkpoint, self._trigger = df, list(sinks), checkpoint, trigger or {"availableNow": True}
        self._on_state, self._query, self.state, self.starting = on_state, None, "NotStarted", False

    def _to(self, state: str) -> None:
        old, self.state = self.state, state
        if old != state and self._on_state:
            self._on_state(old, state)

    def start(self) -> StreamRun:
        if self.state == "Running":
            raise RuntimeError("already running")
        sinks = self._sinks
        prepare = self._prepare
        writer = self._df.writeStream.foreachBatch(lambda batch, n: fan_out(prepare(batch, n) if prepare else batch, sinks, batch=n))
        self.starting = True
        try:
            self._query = writer.outputMode(self._mode).option("checkpointLocation", self._checkpoint).trigger(**self._trigger).start()
        finally:
            self.starting = False
        self._to("Running")
        return self

    @property
    def query(self) -> StreamingQuery:
        if self._query is None:
            raise RuntimeError("not started")
        return self._query

    def pause(self) -> None:
        if self.state == "Running":
            self.query.stop()
            self._to("Paused")

    def resume(self) -> None:
        if self.state == "Paused":
            self.start()

    def cancel(self) -> None:
        if self._query is not None:
            self._query.stop()
        self._to("Cancelled")

    def drain(self) -> None:
        """Work off what has arrived, then stop."""
        self.query.processAllAvailable()
        self.query.stop()
        self._to("Completed")

    def stop(self, grace_s: float = 30.0) -> None:
        """As a host does when it shuts down: work off what has arrived for at most grace_s seconds, then stop anyway.

        Completed if all was worked off, else Cancelled; the checkpoint keeps what is left for the next start.
        """
        end = time.monotonic() + grace_s
        while self.query.isActive and time.monotonic() < end:
            status = self.query.status
            if self.query.lastProgress and not status["isDataAvailable"] and not status["isTriggerActive"]:
                break
            time.sleep(0.05)
        idle = self.query.isActive and time.monotonic() < end
        done = idle or not self.query.isActive and self.query.exception() is None
        self.query.stop()
        self._to("Completed" if done else "Cancelled")

    def wait(self, timeout_s: float | None = None) -> bool:
        """Wait for the end; True if it came. On a timeout the stream stops as Faulted, without raising."""
        try:
            done = self.query.awaitTermination(timeout_s) if timeout_s is not None else (self.query.awaitTermination() or True)
        except Exception:
            self._to("Faulted")
            raise
        if not done:
            self.query.stop()
            self._to("Faulted")
            return False
        self._to("Completed")
        return True
