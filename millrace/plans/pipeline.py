"""The pipeline: sources, transforms and sinks, folded into one DataFrame plan."""

from __future__ import annotations

import contextlib
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators.resilience import Attempted, within_thread
from millrace.operators.transforms import Filter, Transform
from millrace.plans import envelope
from millrace.plans.options import PipelineOptions
from millrace.sources.readers import Concat, Source
from millrace.sources.sinks import Sink, fan_out
from millrace.streaming import metrics
from millrace.streaming.meters import Meters
from millrace.streaming.retries import RetryTable
from millrace.streaming.runner import StreamRun, stream_dedup
from millrace.streaming.tracing import Spanned, span


@dataclass
class Outcome:
    """How a run ended: Completed, or Faulted when its time was up."""

    state: str
    figures: dict[str, Any]


@dataclass(frozen=True)
class Pipeline:
    """Immutable: every method returns a new pipeline. Transforms are all applied, in order."""

    sources: tuple[Source, ...] = ()
    transforms: tuple[Transform, ...] = ()
    sinks: tuple[Sink, ...] = ()
    settings: PipelineOptions = field(default_factory=PipelineOptions)
    key: Column | str | None = None
    name: str | None = None

    def source(self, source: Source) -> Pipeline:
        return replace(self, sources=(*self.sources, source))

    def transform(self, *transforms: Transform) -> Pipeline:
        return replace(self, transforms=(*self.transforms, *transforms))

    pipe = transform

    def sink(self, sink: Sink) -> Pipeline:
        return replace(self, sinks=(*self.sinks, sink))

    def options(self, **changes: Any) -> Pipeline:
        return replace(self, settings=replace(self.settings, **changes))

    def keyed(self, key: Column | str) -> Pipeline:
        return replace(self, key=key)

    def attempt(self, fn: Callable[[dict, int], dict], **options: Any) -> Pipeline:
        """Add a Python function on each row under the pipeline's retry policy and attempt timeout (see Attempted)."""
        return self.transform(Attempted(fn, **options))

    def read(self, spark: SparkSession, counted: Observation | None = None, skipped: list | None = None) -> DataFrame:
        """All sources, deduplicated if asked for. counted observes the rows before that; skipped gets sources left out."""
        if not self.sources:
            raise ValueError("a pipeline needs a source")
        s = self.settings
        note = lambda i, exc: skipped.append((i, str(exc))) if skipped is not None else None
        df = self.sources[0].read(spark) if len(self.sources) == 1 else Concat(self.sources, skip_failing=s.continue_on_error, on_skip=note).read(spark)
        if s.dedup_keys:
            if counted is not None:
                df = df.observe(counted, F.count(F.lit(1)).alias("rows_read"))
            df = stream_dedup(df, s.dedup_keys, *s.dedup_watermark) if df.isStreaming else df.dropDuplicates(list(s.dedup_keys))
        return df

    def wrapped(self, df: DataFrame) -> DataFrame:
        return envelope.wrap(df, self.key, pipeline=self.name)

    def transformed(self, df: DataFrame) -> DataFrame:
        """An enveloped DataFrame through all transforms, those without limits of their own under the pipeline's."""
        s = self.settings

        def step(d: DataFrame, t: Transform) -> DataFrame:
            if isinstance(t, Attempted):
                t = t.with_defaults(s.retry, s.attempt_timeout_s)
            return t.compact(d) if s.compact and isinstance(t, Filter) else t.apply(d)

        return reduce(step, self.transforms, df)

    def plan(self, spark: SparkSession, counted: Observation | None = None, skipped: list | None = None) -> DataFrame:
        """The enveloped result, not yet run. Compact pipelines drop filtered rows, so predicates reach the scan."""
        return self.transformed(self.wrapped(self.read(spark, counted, skipped)))

    def process_one(self, spark: SparkSession, row: dict, schema: str) -> dict:
        """One row through the same transforms: is_success, value, error, trace_id. Takes a job, so milliseconds at best."""
        if not self.transforms:
            return {"is_success": False, "value": None, "error": {"message": "No transforms", "type": envelope.PERMANENT, "category": None, "exception": None}, "trace_id": None}
        began = time.monotonic()
        done = envelope.as_result(self.transformed(self.wrapped(spark.createDataFrame([row], schema)))).first()
        result = done.asDict(True) if done else {"is_success": False, "value": None, "error": {"message": "Filtered out", "type": envelope.PERMANENT, "category": envelope.FILTERED, "exception": None}, "trace_id": None}
        if self.settings.on_metrics:
            filtered = not result["is_success"] and result["error"]["category"] == envelope.FILTERED
            tries = (result["value"] or {}).get("attempts") or 1
            self.settings.on_metrics({"items_processed": 1, "items_succeeded": int(result["is_success"]), "items_failed": int(not result["is_success"] and not filtered), "items_filtered": int(filtered), "retries": tries - 1, "elapsed_ms": (time.monotonic() - began) * 1000})
        return result

    def _all_sinks(self) -> Sequence[Sink]:
        letters = self.settings.dead_letter
        return [*self.sinks, letters] if letters is not None else list(self.sinks)

    def run(self, spark: SparkSession) -> Outcome:
        """Run as a batch. When the total timeout is up its jobs are cancelled and the state is Faulted, without raising."""
        s = self.settings
        if not (self.sources and self.transforms and self._all_sinks()):
            raise ValueError("a pipeline needs a source, a transform and a sink")
        settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(s.capacity)} | ({"spark.sql.shuffle.partitions": str(s.parallelism)} if s.parallelism else {})
        notify = lambda a, b: s.on_state(a, b) if s.on_state else None
        notify("NotStarted", "Running")
        began, tag, late = time.monotonic(), f"millrace-{id(self)}", threading.Event()

        def stop() -> None:
            late.set()
            spark.sparkContext.cancelJobGroup(tag)

        timer = threading.Timer(s.total_timeout_s, stop)
        with _settings(spark, settings):
            counted, skipped = Observation(), []
            with span("plan", s.on_span, pipeline=self.name):
                df = self.plan(spark, counted, skipped)
            if not s.continue_on_error:
                df = _stop_at_failure(df)
            # The counters ride on the first sink's pass; later sinks read what it persisted.
            df, seen = metrics.observed(df)
            spark.sparkContext.setJobGroup(tag, self.name or "millrace", interruptOnCancel=True)
            timer.start()
            try:
                fan_out(df, [Spanned(x, s.on_span, self.name) for x in self._all_sinks()] if s.on_span else self._all_sinks())
            except Exception:
                notify("Running", "Faulted")
                if late.is_set():
                    return Outcome("Faulted", {"elapsed_ms": (time.monotonic() - began) * 1000})
                raise
            finally:
                timer.cancel()
                for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                    spark.sparkContext.setLocalProperty(name, None)
        latency = metrics.RunningLatency()
        figures = latency.add(_observed(seen)) | {"elapsed_ms": (time.monotonic() - began) * 1000, "sources_failed": len(skipped)}
        if s.dedup_keys and not s.compact and figures.get("items_processed"):
            figures["duplicates_filtered"] = _observed(counted).get("rows_read", 0) - figures["items_processed"]
        if s.on_metrics:
            s.on_metrics(figures)
        if s.meter is not None:
            Meters(s.meter, self.name).publish(figures, latency.counts)
        notify("Running", "Completed")
        return Outcome("Completed", figures)

    def to(self, spark: SparkSession, sink: Sink) -> Outcome:
        """Add a sink and run."""
        return self.sink(sink).run(spark)

    def run_background(self, spark: SparkSession) -> Background:
        """Run in a thread; the handle gives the outcome or raises what the run raised, and can cancel it."""
        return Background(self, spark)

    def rows(self, spark: SparkSession):
        """Results one by one, fetched partition by partition."""
        return envelope.as_result(self.plan(spark)).toLocalIterator()

    def stream(self, spark: SparkSession, checkpoint: str, **trigger: Any) -> StreamRun:
        """The same plan on a streaming source.

        With options(retry_table=path) the transforms run in each micro-batch, and transient failures wait in that table
        until they are due; the payload then has the column `attempt`.
        """
        s = self.settings
        if s.retry_table is None:
            df = self.plan(spark)
            run = StreamRun(df.observe("millrace", *metrics.counters(df)), self._all_sinks(), checkpoint, s.on_state, **trigger)
        else:
            table = RetryTable(s.retry_table, s.retry)
            run = StreamRun(self.read(spark), self._all_sinks(), checkpoint, s.on_state, lambda batch, n: table.run(batch, n, self.transformed, self.wrapped), **trigger)
        if s.on_metrics or s.meter is not None:
            publish = Meters(s.meter, self.name).publish if s.meter is not None else None
            spark.streams.addListener(metrics.ProgressListener(s.on_metrics, publish, lambda: run.starting))
        return run


class Background(threading.Thread):
    """A pipeline's run in a thread of its own."""

    def __init__(self, pipeline: Pipeline, spark: SparkSession) -> None:
        super().__init__(daemon=True)
        self._pipeline, self._spark = pipeline, spark
        self._outcome: Outcome | None = None
        self._error: BaseException | None = None
        self.start()

    def run(self) -> None:
        try:
            self._outcome = self._pipeline.run(self._spark)
        except BaseException as exc:  # raised again by result()
            self._error = exc

    def cancel(self) -> None:
        """Stop its jobs; result() then raises."""
        self._spark.sparkContext.cancelJobGroup(f"millrace-{id(self._pipeline)}")

    def result(self, timeout_s: float | None = None) -> Outcome:
        self.join(timeout_s)
        if self.is_alive():
            raise TimeoutError("still running")
        if self._error is not None:
            raise self._error
        return self._outcome


def _observed(seen: Observation, wait_s: float = 10.0) -> dict[str, Any]:
    """What was counted; nothing if no sink ran an action, for then there is nothing to wait for."""
    try:
        return {k: v or 0 for k, v in within_thread(lambda: seen.get, wait_s).items()}
    except TimeoutError:
        return {}


@contextlib.contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings for as long as a run takes."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _stop_at_failure(df: DataFrame) -> DataFrame:
    bad = (~envelope.ok()) & ~F.col(envelope.ERROR)["category"].eqNullSafe(F.lit(envelope.FILTERED))
    check = F.when(bad, F.raise_error(F.concat(F.lit("pipeline stopped: "), F.col(envelope.ERROR)["message"])).cast(envelope.ERROR_DDL))
    return df.withColumn(envelope.ERROR, check.otherwise(F.col(envelope.ERROR)))
