"""Sources: each has read(spark) -> DataFrame. Schemas are given, never guessed."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.resilience import replay
from millrace.sources import bulk


_log = logging.getLogger(__name__)


class Source(Protocol):
    def read(self, spark: SparkSession) -> DataFrame: ...


def _ddl(schema: T.StructType | str) -> str:
    return schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


@dataclass(frozen=True)
class ParquetSource:
    path: str
    schema: T.StructType | str | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.schema(self.schema) if self.schema is not None else spark.read
        return reader.parquet(self.path)


@dataclass(frozen=True)
class FileSource:
    """Any format that spark.read knows: orc, avro, text, ..."""

    format: str
    path: str
    schema: T.StructType | str | None = None
    options: Mapping[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.options)
        return (reader.schema(self.schema) if self.schema is not None else reader).load(self.path)


@dataclass(frozen=True)
class CsvSource:
    """Delimited text with a header; columns are found by header name, missing ones and unreadable values are null.

    All files of a folder need the same header: one with other columns or another order raises instead of being misread.
    """

    path: str
    schema: T.StructType | str
    separator: str = ","
    locale: str = "en-US"

    def read(self, spark: SparkSession) -> DataFrame:
        options = {"header": True, "sep": self.separator, "mode": "PERMISSIVE", "locale": self.locale, "enforceSchema": False}
        head = spark.read.options(**options, inferSchema=False).csv(self.path)
        wanted = spark.createDataFrame([], self.schema).schema
        have = {c.lower(): c for c in head.columns}
        clean = lambda f: F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)
        return head.select(*[clean(f).try_cast(f.dataType).alias(f.name) for f in wanted])


@dataclass(frozen=True)
class JsonSource:
    """A JSON array in one file, or one JSON value a line, told apart by the first character. Malformed input raises.

    Null elements, blank lines and null lines are dropped. A scalar type (`string`) reads scalars into column `value`.
    An array file is one row of text before it is taken apart: split large inputs into lines.
    """

    path: str
    schema: T.StructType | str

    def __post_init__(self) -> None:
        if not self.path or not self.path.strip():
            raise ValueError("a path is needed")

    def _scalar(self) -> bool:
        return isinstance(self.schema, str) and self.schema.strip().lower() in ("string", "int", "bigint", "double", "boolean")

    def read(self, spark: SparkSession) -> DataFrame:
        first = spark.read.text(self.path).select(F.ltrim("value").alias("value")).where("value <> ''").select(F.substring("value", 1, 1)).head()
        array = bool(first) and first[0] == "["
        kind = self.schema if self._scalar() else f"struct<{_ddl(self.schema).replace('` ', '`:')}>" if not isinstance(self.schema, str) else f"struct<{self.schema}>"
        if array:
            whole = spark.read.text(self.path, wholetext=True)
            if self._scalar():
                parts = whole.select(F.explode(F.from_json("value", f"array<{kind}>", {"mode": "FAILFAST"})).alias("value"))
                return parts.where("value is not null")
            parts = whole.select(F.explode(F.from_json("value", f"array<{kind}>", {"mode": "FAILFAST"})).alias("v"))
            return parts.where("v is not null").select("v.*")
        lines = spark.read.text(self.path).where("trim(value) not in ('', 'null')")
        if self._scalar():
            return lines.select(F.parse_json("value").cast(kind).alias("value"))
        return lines.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("v")).where("v is not null").select("v.*")


@dataclass(frozen=True)
class SqlSource:
    """Any SQL over registered tables, with named parameters; `views` maps names to Parquet paths or DataFrames."""

    sql: str
    params: Mapping[str, Any] = field(default_factory=dict)
    views: Mapping[str, str | DataFrame] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        for name, at in self.views.items():
            (spark.read.parquet(at) if isinstance(at, str) else at).createOrReplaceTempView(name)
        return spark.sql(self.sql, args=dict(self.params)) if self.params else spark.sql(self.sql)


@dataclass(frozen=True)
class JdbcSource:
    """SQL run by an external database. partition = (column, low, high, n) reads ranges of a column in parallel.

    through: a folder that driver and executors share, into which an embedded Derby database, which the driver's process alone
    can open, unloads the rows (without partition and time limit).
    """

    url: str
    sql: str
    timeout_s: int = 30
    options: Mapping[str, str] = field(default_factory=dict)
    partition: tuple[str, int, int, int] | None = None
    through: str | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.format("jdbc").options(url=self.url, queryTimeout=self.timeout_s, **self.options)
        if self.through is not None:
            schema = reader.option("query", self.sql).load().schema  # asked by the driver
            with bulk.connected(spark, self.url) as link:
                return bulk.unload(link, spark, [self.sql], schema, self.through)
        if self.partition is None:
            return reader.option("query", self.sql).load()
        column, low, high, n = self.partition
        return reader.options(dbtable=f"({self.sql}) t", partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=n).load()


@dataclass(frozen=True)
class TableSource:
    """A table, or a query composed on it; filters and columns chosen there reach the scan."""

    table: str | Source
    query: Callable[[DataFrame], DataFrame] | None = None

    def with_query(self, query: Callable[[DataFrame], DataFrame]) -> TableSource:
        return TableSource(self.table, query)

    def read(self, spark: SparkSession) -> DataFrame:
        df = spark.table(self.table) if isinstance(self.table, str) else self.table.read(spark)
        return self.query(df) if self.query else df


@dataclass(frozen=True)
class DeadLetterSource:
    """Payloads of dead letters in JSON: lines, an array or a single object. Only failures with a value are given.

    Names, those of the payload and its nested records included, are matched without regard to case (of names that
    differ in case alone, the first); a missing IsSuccess counts as a failure. The first line of the input tells lines
    from whole files; an array file is one row of text before it is taken apart. Malformed input raises.
    """

    path: str
    schema: T.StructType | str

    def read(self, spark: SparkSession) -> DataFrame:
        kind = self.schema if isinstance(self.schema, T.StructType) else spark.createDataFrame([], self.schema).schema
        lines = spark.read.text(self.path).where(F.col("value").rlike(r"\S"))
        first = lines.head()
        text = first[0].strip() if first else ""
        if text.startswith("{") and spark.range(1).select(F.try_parse_json(F.lit(text)).isNotNull()).first()[0]:
            letters = lines.select(F.parse_json("value").alias("v"))
        else:
            whole = spark.read.text(self.path, wholetext=True).where(F.col("value").rlike(r"\S")).select(F.parse_json("value").alias("v"))
            many = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v").cast("array<variant>")).otherwise(F.array("v"))
            letters = whole.select(F.explode(many).alias("v"))
        fields = _fields(F.col("v"))
        good = F.coalesce(_member(fields, "is_success", "issuccess").cast("boolean"), F.lit(False))
        rows = letters.where("v is not null").select(_member(fields, "value").alias("value"), good.alias("is_success"))
        return replay(rows.select(_picked(F.col("value"), kind).alias("value"), "is_success"))


def _fields(value: Column) -> Column:
    """Names and values of a variant that is an object; null for any other."""
    return F.map_entries(F.when(F.schema_of_variant(value).startswith("OBJECT"), value.cast("map<string,variant>")))


def _member(fields: Column, *names: str) -> Column:
    return F.get(F.filter(fields, lambda e: F.lower(e["key"]).isin(*names)), 0)["value"]


def _picked(value: Column, kind: T.DataType) -> Column:
    """A variant as `kind`, fields found by name without regard to case."""
    absent = value.isNull() | F.is_variant_null(value)
    if isinstance(kind, T.StructType):
        fields = _fields(value)
        return F.when(~absent, F.struct(*[_picked(_member(fields, f.name.lower()), f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.when(~absent, F.transform(value.cast("array<variant>"), lambda x: _picked(x, kind.elementType)))
    return value.cast(kind)


@dataclass(frozen=True)
class DeadLetterTable:
    """Payloads of a dead-letter table in Parquet."""

    path: str

    def read(self, spark: SparkSession) -> DataFrame:
        return replay(spark.read.parquet(self.path))


@dataclass(frozen=True)
class FnSource:
    """Any function from a session to a DataFrame."""

    fn: Callable[[SparkSession], DataFrame]

    def read(self, spark: SparkSession) -> DataFrame:
        return self.fn(spark)


@dataclass(frozen=True)
class Concat:
    """Several sources one after the other; `order_col` numbers them.

    skip_failing: a source that can't be planned is left out, logged as a warning and given to on_skip(number, error).
    """

    sources: tuple[Source, ...]
    order_col: str | None = None
    skip_failing: bool = False
    on_skip: Callable[[int, Exception], None] | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        parts = []
        for i, source in enumerate(self.sources):
            try:
                df = source.read(spark)
            except Exception as exc:
                if not self.skip_failing:
                    raise
                _log.warning("source %d (%s) is left out: %s", i, type(source).__name__, exc)
                if self.on_skip:
                    self.on_skip(i, exc)
                continue
            parts.append(df.withColumn(self.order_col, F.lit(i)) if self.order_col else df)
        if not parts:
            raise ValueError("no source could be read")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge(*frames: DataFrame) -> DataFrame:
    """Bag union of any number of DataFrames, batch or streaming, in no order."""
    return reduce(lambda a, b: a.unionByName(b), frames)
