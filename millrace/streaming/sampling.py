"""A sample that outlives batches: the bottom-k rows of each group over all that a stream has brought."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.sketches import bottom_k
from millrace.plans.storage import forget
from millrace.streaming.keytable import folders


class StreamSample:
    """k rows per group with the smallest hashes of a bigint key, however the rows fell into batches.

    The bottom k of two parts are the bottom k of both parts' bottom k, so a batch reads the sample before it and its own
    rows and writes the next sample: version=<n>. A batch that runs again reads the version before it; two versions are kept.
    The same rows give the same sample as bottom_k() over all of them at once. Rows that repeat a key count as they come.
    """

    def __init__(self, path: str, key: str, k: int, by: Sequence[str] = ()) -> None:
        self.path, self.key, self.k, self.by = path.rstrip("/"), key, k, list(by)

    def _versions(self, spark: SparkSession, before: int = 1 << 62) -> list[int]:
        return sorted(v for v in (int(x.removeprefix("version=")) for x in folders(spark, self.path) if x.startswith("version=")) if v < before)

    def _at(self, n: int) -> str:
        return f"{self.path}/version={n}"

    def add(self, batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        have = self._versions(spark, n)
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(self._at(have[-1]))) if have else batch
        bottom_k(rows, self.key, self.k, self.by or None).write.mode("overwrite").parquet(self._at(n))
        for v in self._versions(spark)[:-2]:
            forget(spark, self._at(v))

    def rows(self, spark: SparkSession) -> DataFrame:
        """The sample after the last batch; there has to be one."""
        return spark.read.parquet(self._at(self._versions(spark)[-1]))
