"""Retry, classification, dead letters and the circuit breaker."""

from __future__ import annotations

import concurrent.futures
import multiprocessing
import os
import queue
import random
import signal
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.intervals import interval_sums
from millrace.operators.ordered import fold
from millrace.plans.envelope import ERROR, ERROR_DDL, PERMANENT, TRANSIENT, failed, ok, payload_of

TICK_MS = 1e-4


@dataclass(frozen=True)
class RetryPolicy:
    """Delays between attempts, in milliseconds: fixed d, linear d * n, exponential d * 2^(n - 1), at most max_delay_ms."""

    max_retries: int = 3
    delay_ms: float = 1000.0
    max_delay_ms: float = 30000.0
    backoff: str = "exponential"
    retry_on: Callable[[dict], bool] | None = None
    on_retry: Callable[[int, dict], None] | None = None

    def __post_init__(self) -> None:
        if self.max_retries <= 0:
            raise ValueError("max_retries must be positive")
        if self.backoff not in ("fixed", "linear", "exponential"):
            raise ValueError(f"unknown backoff {self.backoff!r}")

    def delay(self, attempt: int) -> float:
        """Before retry number `attempt` (from 1); 0 before that."""
        if attempt < 1:
            return 0.0
        factor = {"fixed": 1.0, "linear": float(attempt), "exponential": 2.0 ** min(attempt - 1, 62)}[self.backoff]
        return min(max(self.delay_ms * factor, TICK_MS), self.max_delay_ms)

    def delay_column(self, attempt: Column) -> Column:
        n = attempt.cast("double")
        factor = {"fixed": F.lit(1.0), "linear": n, "exponential": F.pow(F.lit(2.0), F.least(n - 1, F.lit(62.0)))}[self.backoff]
        return F.when(attempt < 1, 0.0).otherwise(F.least(F.greatest(F.lit(self.delay_ms) * factor, F.lit(TICK_MS)), F.lit(float(self.max_delay_ms))))

    def wants(self, failure: dict) -> bool:
        return self.retry_on(failure) if self.retry_on else failure["type"] == TRANSIENT


def jittered(delay: Column, seed: int) -> Column:
    """A delay cut to between 75 and 100 per cent of itself."""
    return delay * (F.lit(0.75) + F.floor(F.rand(seed) * 101) / 100 * 0.25)


def budget(budget_col: Column, policy: RetryPolicy) -> Column:
    """Retries that a row may have: its own budget, or the policy's if that is -1 or null."""
    return F.coalesce(F.nullif(budget_col, F.lit(-1)), F.lit(policy.max_retries))


def schedule(df: DataFrame, attempt: str, policy: RetryPolicy, budget_col: str | None = None) -> DataFrame:
    """df with delay_ms before the attempt and whether the budget still allows it."""
    most = budget(F.col(budget_col), policy) if budget_col else F.lit(policy.max_retries)
    return df.withColumns({"delay_ms": policy.delay_column(F.col(attempt)), "allowed": F.col(attempt) <= most})


def classify(exc: BaseException) -> tuple[str, str]:
    """(type, category) of an exception that user code raised."""
    if isinstance(exc, (TimeoutError, concurrent.futures.TimeoutError)):
        return TRANSIENT, "Timeout"
    if isinstance(exc, (ConnectionError, OSError)):
        return TRANSIENT, "IO"
    return PERMANENT, "TransformError"


class _Late(BaseException):
    """The time limit of a call; no `except Exception` of the call's own code catches it."""


def _ring(*_: Any) -> None:
    raise _Late


class _Helper:
    """One thread that makes calls for another, which may leave it behind."""

    def __init__(self) -> None:
        self.asked: queue.SimpleQueue = queue.SimpleQueue()
        self.done: queue.SimpleQueue = queue.SimpleQueue()
        threading.Thread(target=self._work, daemon=True).start()

    def _work(self) -> None:
        while (job := self.asked.get()) is not None:
            fn, args = job
            try:
                self.done.put((fn(*args), None))
            except BaseException as exc:  # raised in the caller's thread
                self.done.put((None, exc))


_helpers = threading.local()


def within(fn: Callable[..., Any], timeout_s: float | None, *args: Any) -> Any:
    """fn(*args), or a TimeoutError after timeout_s of its own time.

    In a process's main thread, as in Spark's Python workers, an alarm ends the call where it stands: no thread is made and
    none is left. Code inside an extension module sees the alarm when it comes back; Attempted(isolate=True) kills that too. In other
    threads a helper thread makes the calls; one that hangs is left to its call and replaced.
    """
    if not timeout_s:
        return fn(*args)
    if threading.current_thread() is threading.main_thread():
        before = signal.signal(signal.SIGALRM, _ring)
        try:
            signal.setitimer(signal.ITIMER_REAL, timeout_s)
            try:
                return fn(*args)
            finally:
                signal.setitimer(signal.ITIMER_REAL, 0)
        except _Late:
            raise TimeoutError(f"Timed out after {timeout_s:.1f}s") from None
        finally:
            signal.signal(signal.SIGALRM, before)
    return within_thread(fn, timeout_s, *args)


def within_thread(fn: Callable[..., Any], timeout_s: float, *args: Any) -> Any:
    """within() by the helper thread alone: for calls that an alarm must not cut short, as those into the JVM."""
    helper = getattr(_helpers, "own", None)
    if helper is None:
        helper = _helpers.own = _Helper()
    helper.asked.put((fn, args))
    try:
        made, exc = helper.done.get(timeout=timeout_s)
    except queue.Empty:
        helper.asked.put(None)  # it ends after the call that hangs
        _helpers.own = None
        raise TimeoutError(f"Timed out after {timeout_s:.1f}s") from None
    if exc is not None:
        raise exc
    return made


class Isolated:
    """Calls of fn in a process of its own, which is killed and replaced when a call takes too long.

    The process is a fork: fn needs no pickling, its arguments and results do. One serves all calls of a task; close() ends it.
    """

    def __init__(self, fn: Callable[..., Any]) -> None:
        self.fn, self._process, self._link = fn, None, None

    def _serve(self, link: Any) -> None:
        while True:
            try:
                args = link.recv()
            except EOFError:
                os._exit(0)
            try:
                answer: tuple[Any, BaseException | None] = (self.fn(*args), None)
            except BaseException as exc:  # raised in the caller's process
                answer = (None, exc)
            try:
                link.send(answer)
            except Exception as exc:  # what can't be pickled
                link.send((None, RuntimeError(f"{type(exc).__name__}: {exc}")))

    def __call__(self, timeout_s: float | None, *args: Any) -> Any:
        if self._process is None:
            fork = multiprocessing.get_context("fork")
            self._link, theirs = fork.Pipe()
            self._process = fork.Process(target=self._serve, args=(theirs,), daemon=True)
            self._process.start()
            theirs.close()
        self._link.send(args)
        try:
            if not self._link.poll(timeout_s or None):
                self.close()
                raise TimeoutError(f"Timed out after {timeout_s:.1f}s")
            made, exc = self._link.recv()
        except EOFError:
            self.close()
            raise RuntimeError("the process of the call died") from None
        if exc is not None:
            raise exc
        return made

    def close(self) -> None:
        if self._process is not None:
            self._link.close()
            self._process.kill()
            self._process.join()
            self._process = self._link = None


@dataclass(frozen=True)
class Attempted:
    """Runs a Python function on each row, in Arrow batches, with a time limit and retries inside the task.

    fn(row: dict, attempt: int) gets the payload columns and returns a dict of them or raises. Adds `attempts` and, if
    timed, `elapsed_ms`, the row's whole time with all attempts. Without a policy or a timeout of its own it takes the
    pipeline's (a timeout of 0 is none); budget_col holds a row's own number of retries (null or -1: the policy's). Waits
    are the policy's if sleep is true. breaker: settings of a CircuitBreaker that each task has on its own clock; while it
    is open, rows fail as Transient / CircuitBreaker without a call. isolate: calls are made in a process of the task's own, which
    is killed when one is late, whatever it is doing. A task that Spark repeats runs the function again: it has to be idempotent.
    """

    fn: Callable[[dict, int], dict]
    policy: RetryPolicy | None = None
    timeout_s: float | None = None
    sleep: bool = False
    category: str | None = None
    budget_col: str | None = None
    timed: bool = False
    breaker: Mapping[str, Any] | None = None
    isolate: bool = False

    def with_defaults(self, policy: RetryPolicy, timeout_s: float) -> Attempted:
        return replace(self, policy=self.policy or policy, timeout_s=timeout_s if self.timeout_s is None else self.timeout_s)

    def apply(self, df: DataFrame) -> DataFrame:
        added = {"attempts": "int"} | ({"elapsed_ms": "double"} if self.timed else {})
        names = [c for c in payload_of(df) if c not in added]
        df = df.drop(*added)
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{k} {v}" for k, v in added.items())])
        me = replace(self, policy=self.policy or RetryPolicy())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            guard = CircuitBreaker(**me.breaker) if me.breaker is not None else None
            apart = Isolated(me.fn) if me.isolate else None
            call = (lambda *args: apart(me.timeout_s, *args)) if apart else (lambda *args: within(me.fn, me.timeout_s, *args))
            try:
                yield from attempt(batches, guard, call)
            finally:
                if apart:
                    apart.close()

        def attempt(batches: Iterator[pa.RecordBatch], guard: CircuitBreaker | None, call: Callable[..., Any]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.flatnonzero(batch[ERROR].is_null().to_numpy(zero_copy_only=False)).tolist()
                payload = batch.select(names).take(pa.array(good, pa.int64())).to_pylist() if good else []
                attempts, elapsed = [0] * batch.num_rows, [0.0] * batch.num_rows
                changes: dict[str, dict[int, Any]] = {}
                for i, row in zip(good, payload):
                    if guard and not guard.allow(time.monotonic()):
                        changes.setdefault(ERROR, {})[i] = {"message": "Circuit breaker is open", "type": TRANSIENT, "category": "CircuitBreaker", "exception": None}
                        continue
                    began = time.perf_counter()
                    attempts[i], made, failure = me._one(row, call)
                    if guard:
                        guard.record(time.monotonic(), failure is None)
                    elapsed[i] = (time.perf_counter() - began) * 1000
                    for name, value in made.items():
                        if name in names:
                            changes.setdefault(name, {})[i] = value
                    if failure:
                        changes.setdefault(ERROR, {})[i] = failure
                columns = [_patched(batch[f.name], changes.get(f.name)) for f in batch.schema] + [pa.array(attempts, pa.int32())]
                columns += [pa.array(elapsed)] if me.timed else []
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *added])

        return df.mapInArrow(run, schema)

    def _one(self, payload: dict, call: Callable[..., Any]) -> tuple[int, dict, dict | None]:
        """(attempts, changed columns, failure)"""
        own = payload[self.budget_col] if self.budget_col else None
        most = self.policy.max_retries if own is None or own == -1 else own
        attempt = 0
        while True:
            attempt += 1
            try:
                return attempt, call(dict(payload), attempt), None
            except Exception as exc:  # errors are data here
                kind, category = classify(exc)
                failure = {"message": str(exc), "type": kind, "category": self.category or category, "exception": type(exc).__name__}
            if attempt > most or not self.policy.wants(failure):
                return attempt, {}, failure
            if self.policy.on_retry:
                self.policy.on_retry(attempt, failure)
            if self.sleep:
                time.sleep(self.policy.delay(attempt) / 1000 * (0.75 + random.randrange(101) / 100 * 0.25))


def _patched(column: pa.Array, changes: dict[int, Any] | None) -> pa.Array:
    if not changes:
        return column
    values = column.to_pylist()
    for i, value in changes.items():
        values[i] = value
    return pa.array(values, column.type)


def dead_letters(df: DataFrame, attempts: str | None = None) -> DataFrame:
    """Failures (filtered rows apart) as dead-letter rows: trace_id, is_success, value, error, attempts."""
    bad = failed(df)
    count = F.col(attempts) if attempts else F.lit(1)
    value = F.struct(*[c for c in payload_of(df) if c != attempts])
    return bad.select(F.col("_trace_id").alias("trace_id"), F.lit(False).alias("is_success"), value.alias("value"), F.col(ERROR).alias("error"), count.cast("int").alias("attempts"))


def replay(letters: DataFrame) -> DataFrame:
    """Payloads of dead letters that are failures and have a value."""
    return letters.where(~F.coalesce(F.col("is_success"), F.lit(False)) & F.col("value").isNotNull()).select("value.*")


def route(df: DataFrame) -> DataFrame:
    """df with `route`: sink, filtered, retry (transient failures) or dead_letter."""
    e = F.col(ERROR)
    where = F.when(ok(), "sink").when(e["category"].eqNullSafe(F.lit("Filtered")), "filtered").when(e["type"] == TRANSIENT, "retry").otherwise("dead_letter")
    return df.withColumn("route", where)


def failure_ratio(df: DataFrame, ok_col: str, ts_col: str, seconds: int, keys: tuple[str, ...] = (), row_key: tuple[str, ...] = ()) -> DataFrame:
    """df with failures, total and ratio of the rows of the last `seconds` (both ends included) of the same key.

    row_key: columns that tell rows apart; with them the counts come from bins of time, so neither a hot key nor the want of
    any keys puts all rows into one task. Rows without a key or a time then count nothing, and have no ratio.
    """
    if row_key:
        bad = {"window_failures": (~F.col(ok_col)).cast("long")}
        out = interval_sums(df, df.select(*keys, ts_col, ok_col), keys, row_key, ts_col, ts_col, seconds, sums=bad, count="window_total")
        return out.withColumn("failure_ratio", F.when(F.col("window_total") > 0, F.col("window_failures") / F.col("window_total")))
    ts = F.col(ts_col).cast("timestamp").cast("double")
    w = Window.partitionBy(*keys).orderBy(ts).rangeBetween(-seconds, 0)
    out = df.withColumns({"window_total": F.count("*").over(w), "window_failures": F.sum((~F.col(ok_col)).cast("long")).over(w)})
    return out.withColumn("failure_ratio", F.col("window_failures") / F.col("window_total"))


class CircuitBreaker:
    """The breaker's state machine on event time (seconds): Closed, Open, HalfOpen, Isolated.

    Half-open probes that neither close nor reopen it are renewed after another break_s: it never stays half-open for good.
    """

    def __init__(self, failure_ratio: float = 0.5, sampling_s: float = 30.0, least: int = 10, break_s: float = 30.0, half_open: int = 3) -> None:
        self.failure_ratio, self.sampling_s, self.least, self.break_s, self.half_open = failure_ratio, sampling_s, least, break_s, half_open
        self.reset()

    def reset(self) -> None:
        self.state, self.ewma = "Closed", 0.0
        self.window: deque[tuple[float, bool]] = deque()
        self.failures = 0
        self.opened = 0.0
        self._probe()

    def _probe(self) -> None:
        self.probes = self.probe_successes = 0

    def isolate(self) -> None:
        self.state = "Isolated"

    def _add(self, now: float, good: bool) -> None:
        self.window.append((now, good))
        self.failures += not good
        self._expire(now)

    def _expire(self, now: float) -> None:
        while self.window and self.window[0][0] < now - self.sampling_s:
            self.failures -= not self.window.popleft()[1]

    @property
    def ratio(self) -> float:
        return self.failures / len(self.window) if self.window else 0.0

    def allow(self, now: float) -> bool:
        self._expire(now)
        if now - self.opened >= self.break_s and (self.state == "Open" or self.state == "HalfOpen" and self.probes >= self.half_open):
            self.state, self.opened = "HalfOpen", now
            self._probe()
        if self.state == "HalfOpen":
            self.probes += 1
            return self.probes <= self.half_open
        return self.state == "Closed"

    def record(self, now: float, good: bool) -> None:
        alpha = 0.5 if self.ewma > 0.1 else 0.2
        self._add(now, good)
        self.ewma = (1 - alpha) * self.ewma + (0.0 if good else alpha)
        if good:
            if self.state == "HalfOpen":
                self.probe_successes += 1
                if self.probe_successes >= self.half_open // 2 + 1:
                    self.state, self.ewma = "Closed", 0.0
                    self._probe()
            return
        if self.ewma > 1.5 * self.failure_ratio:
            self._add(now, False)  # an early warning counts double
        if len(self.window) >= self.least and self.ratio >= self.failure_ratio and self.state in ("Closed", "HalfOpen"):
            self.state, self.opened = "Open", now
            self._probe()

    def metrics(self, now: float) -> dict[str, Any]:
        self._expire(now)
        return {"cb_state": self.state, "cb_failure_ratio": self.ratio, "cb_ewma_failure_rate": self.ewma, "cb_half_open_attempts": self.probes}


def breaker_replay(df: DataFrame, key: str, ts_col: str, order_col: str, ok_col: str, **settings: Any) -> DataFrame:
    """Each row of each key in event-time order through a breaker: allowed, and the breaker's metrics after the row.

    A row that isn't allowed is not recorded. A task keeps the breaker of one key, not its rows.
    """

    def step(breaker: CircuitBreaker, t: float, good: bool) -> tuple[CircuitBreaker, tuple]:
        allowed = breaker.allow(t)
        if allowed:
            breaker.record(t, bool(good))
        return breaker, (allowed, *breaker.metrics(t).values())

    columns = [F.col(ts_col).cast("timestamp").cast("double"), F.col(ok_col)]
    out = "allowed boolean, cb_state string, cb_failure_ratio double, cb_ewma_failure_rate double, cb_half_open_attempts int"
    return fold(df, key, [ts_col, order_col], columns, lambda: CircuitBreaker(**settings), step, out, kept=[order_col])


__all__ = ["ERROR_DDL", "Attempted", "CircuitBreaker", "RetryPolicy", "breaker_replay", "budget", "classify", "dead_letters", "failure_ratio", "jittered", "replay", "route", "schedule", "within"]
