"""Retries that wait outside a task: rows with due times in folders by time, read by the micro-batch in which they are due."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.resilience import RetryPolicy, budget
from millrace.plans.envelope import ERROR, META, TRANSIENT, payload_of
from millrace.plans.storage import forget
from millrace.streaming.keytable import folders

ATTEMPT, DUE = "attempt", "due"
_ROW, _TRIED, _MOST, _SLOT = "retry_row", "retry_tried", "retry_most", "_slot"


@dataclass(frozen=True)
class RetryTable:
    """Transient failures wait in the shared folder until they are due; no task sleeps and no row is lost with one.

    run(batch, n, apply) puts the due rows beside the batch's, with the number of the `attempt` (from 1) as a payload
    column, applies the transforms, and gives back the rows that are done: successes, permanent failures and transient
    ones whose budget is spent. The others are written with the time of their next attempt. budget_col: a row's own number
    of retries (null or -1: the policy's).

    Rows carry a number of their own through the transforms, in the metadata, so keys and trace ids may be null or repeat.
    Each batch writes its waiting rows to waits/batch=<n>/_slot=<second it is due> and its time to times/batch=<n>. A row
    written by batch w is waiting before batch n if it is due after the time of batch n-1, or if w is n-1; so a batch reads
    the slots between two times, rewrites nothing, and comes to the same if it runs again. Folders whose slots have all passed are deleted.
    """

    path: str
    policy: RetryPolicy = RetryPolicy()
    budget_col: str | None = None

    def _at(self, kind: str, n: int) -> str:
        return f"{self.path.rstrip('/')}/{kind}/batch={n}"

    def _batches(self, spark: SparkSession, kind: str) -> list[int]:
        return sorted(int(x.removeprefix("batch=")) for x in folders(spark, f"{self.path.rstrip('/')}/{kind}") if x.startswith("batch="))

    def _slots(self, spark: SparkSession, n: int) -> list[int]:
        return [int(x.removeprefix(f"{_SLOT}=")) for x in _children(spark, self._at("waits", n)) if x.startswith(f"{_SLOT}=")]

    def _time(self, spark: SparkSession, n: int) -> int | None:
        """Microseconds since 1970 of batch n; None if it didn't begin."""
        return spark.read.parquet(self._at("times", n)).first()[0] if n in self._batches(spark, "times") else None

    def _waiting(self, spark: SparkSession, before: int, until: int | None = None) -> DataFrame | None:
        """Rows that wait before batch `before`; those due by `until` alone."""
        have = [w for w in self._batches(spark, "waits") if w < before and self._slots(spark, w)]
        if not have:
            return None
        last = max((t for t in self._batches(spark, "times") if t < before), default=None)
        passed = self._time(spark, last) if last is not None else None
        rows = spark.read.option("basePath", f"{self.path.rstrip('/')}/waits").parquet(*[self._at("waits", w) for w in have])
        if passed is not None:
            rows = rows.where((F.col(_SLOT) >= passed // 1_000_000) | (F.col("batch") == last))
            rows = rows.where((F.unix_micros(DUE) > passed) | (F.col("batch") == last))
        if until is not None:
            rows = rows.where((F.col(_SLOT) <= until // 1_000_000) & (F.unix_micros(DUE) <= until))
        return rows.drop("batch", _SLOT)

    def pending(self, spark: SparkSession, before: int = 1 << 62) -> DataFrame | None:
        """Rows that wait (payload, attempt, due), after the last batch or the one before `before`; None before any batch."""
        found = self._waiting(spark, before)
        if found is None and self._batches(spark, "times"):
            work = spark.read.parquet(f"{self.path.rstrip('/')}/work/in").limit(0)
            found = work.select(*payload_of(work), F.lit(None).cast("timestamp").alias(DUE))
        return found

    def run(self, batch: DataFrame, n: int, apply: Callable[[DataFrame], DataFrame], wrap: Callable[[DataFrame], DataFrame], now: Column | None = None) -> DataFrame:
        spark = batch.sparkSession
        moment = self._time(spark, n)
        if moment is None:  # a batch that runs again keeps its time
            moment = spark.range(1).select(F.unix_micros(now if now is not None else F.current_timestamp()).alias("t")).first()[0]
            before = [t for t in self._batches(spark, "times") if t < n]
            moment = max(moment, self._time(spark, max(before)) if before else moment)
            spark.createDataFrame([(moment,)], "t long").coalesce(1).write.mode("overwrite").parquet(self._at("times", n))
        fresh = batch.withColumn(ATTEMPT, F.lit(1))
        old = self._waiting(spark, n, moment)
        work = fresh if old is None else fresh.unionByName(old.drop(DUE))
        # Written before the transforms run: a table is read again below, and functions may not be deterministic.
        base = f"{self.path.rstrip('/')}/work"
        most = budget(F.col(self.budget_col), self.policy) if self.budget_col else F.lit(self.policy.max_retries)
        work = wrap(work).withColumn("_row", F.monotonically_increasing_id())
        facts = F.create_map(F.lit(_ROW), F.col("_row").cast("string"), F.lit(_TRIED), F.col(ATTEMPT).cast("string"), F.lit(_MOST), most.cast("string"))
        work = work.withColumn(META, F.map_concat(F.coalesce(META, F.create_map().cast("map<string,string>")), facts)).drop("_row")
        work.write.mode("overwrite").parquet(f"{base}/in")
        work = spark.read.parquet(f"{base}/in")
        again = F.coalesce(F.col(ERROR)["type"] == TRANSIENT, F.lit(False)) & (F.col(META)[_TRIED].cast("int") <= F.col(META)[_MOST].cast("int"))
        apply(work).withColumn("_again", again).write.mode("overwrite").parquet(f"{base}/out")
        out = spark.read.parquet(f"{base}/out")
        failed = out.where("_again").select(F.col(META)[_ROW].alias("_r"))
        back = work.join(failed, F.col(META)[_ROW] == F.col("_r"), "left_semi").select(*payload_of(work))
        delay = F.make_dt_interval(secs=(self.policy.delay_column(F.col(ATTEMPT)) / 1000).cast("decimal(18,6)"))
        waits = back.withColumn(DUE, F.timestamp_micros(F.lit(moment)) + delay).withColumn(ATTEMPT, F.col(ATTEMPT) + 1)
        waits = waits.withColumn(_SLOT, F.floor(F.unix_micros(DUE) / 1_000_000))
        # All rows may be due in one second: they are several tasks' then.
        tasks = spark.sparkContext.defaultParallelism
        waits = waits.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(tasks)))
        waits.repartition(_SLOT, "_salt").drop("_salt").write.mode("overwrite").partitionBy(_SLOT).parquet(self._at("waits", n))
        self._tidy(spark, n)
        rest = F.map_filter(META, lambda k, _: ~k.isin(_ROW, _TRIED, _MOST))
        return out.where("not _again").drop("_again").withColumn(META, F.when(F.size(rest) > 0, rest))

    def _tidy(self, spark: SparkSession, n: int) -> None:
        """Delete folders of batches before n-1 whose last slot was over before batch n-1, and old times."""
        passed = self._time(spark, n - 1)
        if passed is None:
            return
        for w in self._batches(spark, "waits"):
            slots = self._slots(spark, w)
            if w < n - 1 and max(slots, default=-math.inf) < passed // 1_000_000:
                forget(spark, self._at("waits", w))
        for t in self._batches(spark, "times")[:-3]:
            forget(spark, self._at("times", t))


def _children(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [x.getPath().getName() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
