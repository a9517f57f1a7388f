"""The folder that driver and executors share, and the size of the batches that go to Python."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch.
BATCH_BYTES, _BATCH = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder under the shared folder named by spark.checkpoint.dir.

    Where that is unset a temporary folder is taken, if the master is local; on a cluster it would be another folder on
    every machine, so there it is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        kept = sc._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            base = kept.get()
        elif (sc.master or "").startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        else:
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}/{label}"


def forget(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder that no later plan reads."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def bounded(df: DataFrame, limit: int = BATCH_BYTES) -> DataFrame:
    """df, and its session's Arrow batches bound to `limit` bytes if they may be larger.

    A batch is held by the JVM, as vectors and as the stream's bytes, and by the Python worker at once. The setting stays:
    plans run after operators return.
    """
    spark = df.sparkSession
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if now > limit:
        spark.conf.set(_BATCH, str(limit))
    return df
