"""A set of keys in hash buckets, one segment of changes per micro-batch, merged by size.

    path/seg=<first batch>-<last batch>/bucket=<b>/...

A batch writes a segment of its own changes. FAN neighbours of one level make a segment of the next, so a key is rewritten
once a level and a lookup reads at most FAN segments a level, in the buckets of the keys it looks for. A merge never takes
in the batch that is running: run again, it finds what it found before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.storage import forget

ALIVE, BATCH, BUCKET = "_alive", "_batch", "_bucket"
#: Segments of a level that are merged into one.
FAN = 8


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in `path` that were written to their end."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    at = jvm(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    return [x.getPath().getName() for x in system.listStatus(at) if system.exists(jvm(f"{path}/{x.getPath().getName()}/_SUCCESS"))]


@dataclass(frozen=True)
class KeyTable:
    """Keys that are alive after all changes; null components are values like others."""

    path: str
    keys: Sequence[str]
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _segments(self, spark: SparkSession, before: int) -> list[tuple[int, int]]:
        """Ranges of batches, without those that a merged segment holds."""
        have = [tuple(map(int, x.removeprefix("seg=").split("-"))) for x in folders(spark, self.path) if x.startswith("seg=")]
        have = sorted(x for x in have if x[1] < before)
        return [x for x in have if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in have)]

    def _at(self, lo: int, hi: int) -> str:
        return f"{self.path}/seg={lo}-{hi}"

    def _latest(self, spark: SparkSession, segments: list[tuple[int, int]], buckets: list[int] | None = None) -> DataFrame:
        """The last change of each key."""
        rows = spark.read.option("basePath", self.path).parquet(*[self._at(*x) for x in segments]).drop("seg")
        if buckets is not None:
            rows = rows.where(F.col(BUCKET).isin(buckets))
        return rows.groupBy(*self.keys, BUCKET).agg(F.max_by(ALIVE, BATCH).alias(ALIVE), F.max(BATCH).alias(BATCH))

    def without(self, rows: DataFrame, before: int) -> DataFrame:
        """rows whose key is not alive in the batches before `before`."""
        spark = rows.sparkSession
        self.merge(spark, before)
        segments = self._segments(spark, before)
        if not segments:
            return rows
        # At most `buckets` numbers; only their folders are read.
        met = [r[0] for r in rows.select(self._bucket()).distinct().collect()]
        old = self._latest(spark, segments, met).where(ALIVE).select(*[F.col(k).alias(f"_old_{k}") for k in self.keys], F.col(BUCKET).alias("_old_bucket"))
        same = self._bucket() == F.col("_old_bucket")
        for k in self.keys:
            same &= F.col(k).eqNullSafe(F.col(f"_old_{k}"))
        return rows.join(old, same, "left_anti")

    def put(self, keys: DataFrame, n: int, alive: bool = True) -> None:
        """Batch n's change: these keys are alive, or not any more."""
        rows = keys.select(*self.keys, F.lit(alive).alias(ALIVE), F.lit(n).cast("long").alias(BATCH), self._bucket().alias(BUCKET))
        self._write(rows, n, n)

    def _write(self, rows: DataFrame, lo: int, hi: int) -> None:
        if rows.isEmpty():  # a folder without files has no schema
            forget(rows.sparkSession, self._at(lo, hi))
            return
        rows.repartition(F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(self._at(lo, hi))

    def merge(self, spark: SparkSession, before: int) -> None:
        """Merge what FAN segments of a level make, the batch just before `before` left out; drop what is merged."""
        have = [tuple(map(int, x.removeprefix("seg=").split("-"))) for x in folders(spark, self.path) if x.startswith("seg=")]
        for x in have:
            if any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in have):
                forget(spark, self._at(*x))
        while True:
            segments = self._segments(spark, before)
            level = lambda x: 0 if x[0] == x[1] else len(str(x[1] - x[0]))
            run = next((segments[i : i + FAN] for i in range(len(segments) - FAN + 1) if len({level(x) for x in segments[i : i + FAN]}) == 1), None)
            if run is None:
                return
            self._write(self._latest(spark, run), run[0][0], run[-1][1])
            for x in run:
                forget(spark, self._at(*x))

    def alive(self, spark: SparkSession, before: int = 1 << 62) -> DataFrame:
        """All keys that are alive; there has to be a change."""
        return self._latest(spark, self._segments(spark, before)).where(ALIVE).select(*self.keys)
