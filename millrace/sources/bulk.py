"""Rows to and from a Derby database that the driver's process alone can open, as files in a folder that executors share.

Tasks write and read the files; the database loads and unloads them itself, so no row is a row of the driver's. The folder is a mounted
one (file:): Derby opens no others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.storage import forget

#: Derby writes CSV so, and reads it; null is nothing, an empty string a pair of quotes.
_CSV = {"quote": '"', "escape": '"', "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


@contextmanager
def connected(spark: SparkSession, url: str) -> Iterator[Any]:
    """A connection of the driver's JVM, without commits of its own."""
    link = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        link.setAutoCommit(False)
        yield link
    finally:
        link.rollback()
        link.close()


def _local(path: str) -> str:
    name = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in name:
        raise ValueError(f"{path}: a database loads files of mounted folders alone")
    return name


def _call(link: Any, sql: str, *values: str | None) -> None:
    call = link.prepareCall(sql)
    try:
        for i, x in enumerate(values, 1):
            call.setString(i, x)
        call.execute()
    finally:
        call.close()


def stored_name(table: str) -> str:
    """A table's name as the database keeps it: in capitals unless quoted."""
    return table[1:-1].replace('""', '"') if table.startswith('"') else table.upper()


def load(link: Any, rows: DataFrame, table: str, folder: str) -> None:
    """Adds rows to a table that has their columns, in their order. Each file is a transaction of its own."""
    spark, at = rows.sparkSession, f"{folder.rstrip('/')}/load-{uuid.uuid4().hex}"
    local = _local(at)
    if odd := [f.name for f in rows.schema if not isinstance(f.dataType, T.AtomicType) or isinstance(f.dataType, T.BinaryType)]:
        raise ValueError(f"no way to load columns {odd}")
    # quoted text keeps its spaces and line ends; null stays bare
    text = lambda f: F.concat(F.lit('"'), F.replace(F.col(f"`{f.name}`"), F.lit('"'), F.lit('""')), F.lit('"')) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`").cast("string")
    line = F.array_join(F.array(*[F.coalesce(text(f), F.lit("")) for f in rows.schema]), ",")
    rows.select(line.alias("value")).write.text(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    for part in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
        name = part.getPath().getName()
        if name.startswith("part-") and part.getLen():
            _call(link, "CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)", stored_name(table), f"{local}/{name}")
    forget(spark, at)


def unload(link: Any, spark: SparkSession, queries: list[str], schema: T.StructType, folder: str) -> DataFrame:
    """The rows of the queries, a file each, which stay in the folder."""
    at = f"{folder.rstrip('/')}/unload-{uuid.uuid4().hex}"
    local = _local(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    for i, sql in enumerate(queries):
        _call(link, "CALL SYSCS_UTIL.SYSCS_EXPORT_QUERY(?, ?, ',', '\"', 'UTF-8')", sql, f"{local}/{i:06d}.csv")
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    # Files without text are read in ranges; text may hold line ends.
    # What is bare becomes a word that no row holds, or Spark would take an empty string for null too.
    rows = spark.read.schema(texts).options(**_CSV, nullValue=uuid.uuid4().hex, mode="FAILFAST", multiLine=any(isinstance(f.dataType, T.StringType) for f in schema)).csv(at)
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
