"""Row transforms. Each takes an enveloped DataFrame and touches only rows that have not failed."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.envelope import ENVELOPE, ERROR, FILTERED, PERMANENT, TRANSIENT, error, fail_where, ok, payload_of
from millrace.plans.storage import bounded


class Transform(Protocol):
    def apply(self, df: DataFrame) -> DataFrame: ...


def _set(df: DataFrame, columns: Mapping[str, Column], when: Column | None = None) -> DataFrame:
    """Set columns of rows that have not failed (and meet `when`); new columns are null elsewhere."""
    guard = ok() if when is None else ok() & F.coalesce(when, F.lit(False))
    return df.withColumns({k: F.when(guard, v).otherwise(F.col(k)) if k in df.columns else F.when(guard, v) for k, v in columns.items()})


@dataclass(frozen=True)
class Middleware:
    """Sets payload columns from expressions (row by row, no Python)."""

    columns: Mapping[str, Column]

    def apply(self, df: DataFrame) -> DataFrame:
        return _set(df, self.columns)


@dataclass(frozen=True)
class PythonMiddleware:
    """A Python function on each row, in Arrow batches; an exception is a permanent failure of category Middleware."""

    fn: Callable[[dict], dict]

    def apply(self, df: DataFrame) -> DataFrame:
        from millrace.operators.resilience import Attempted, RetryPolicy

        call = Attempted(lambda row, _: self.fn(row), RetryPolicy(1, retry_on=lambda _: False), category="Middleware")
        return call.apply(df).drop("attempts")


@dataclass(frozen=True)
class Filter:
    """Rows for which the predicate isn't true fail with category Filtered. Null counts as false, also under ~."""

    predicate: Column

    # Conjunction and disjunction of three-valued predicates are true exactly where the two-valued ones are, so only
    # negation needs the null made false; what stays plain can be pushed down.
    def __and__(self, other: Filter) -> Filter:
        return Filter(self.predicate & other.predicate)

    def __or__(self, other: Filter) -> Filter:
        return Filter(self.predicate | other.predicate)

    def __invert__(self) -> Filter:
        return Filter(~self.predicate | self.predicate.isNull())

    def apply(self, df: DataFrame) -> DataFrame:
        return fail_where(df, ~F.coalesce(self.predicate, F.lit(False)), error("Filtered out", PERMANENT, FILTERED))

    def compact(self, df: DataFrame) -> DataFrame:
        """The same rows dropped, so that the predicate can reach the scan."""
        return df.where(self.predicate)


@dataclass(frozen=True)
class Validation:
    """Rules (condition, message) in order; all messages of a row joined by '; '."""

    rules: Sequence[tuple[Column, str]] = ()

    def require(self, condition: Column, message: str) -> Validation:
        return Validation((*self.rules, (condition, message)))

    def required(self, column: str) -> Validation:
        return self.require(F.coalesce(F.length(F.trim(F.col(column).cast("string"))) > 0, F.lit(False)), f"The {column} field is required.")

    def within(self, column: str, low: Any, high: Any) -> Validation:
        return self.require(F.col(column).isNull() | F.col(column).between(low, high), f"The field {column} must be between {low} and {high}.")

    def messages(self) -> Column:
        """All messages; empty for a valid row."""
        each = [F.when(~F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in self.rules]
        return F.concat_ws("; ", *each) if each else F.lit("")

    def apply(self, df: DataFrame) -> DataFrame:
        return fail_where(df, self.messages() != "", error(self.messages(), PERMANENT, "Validation"))

    def to_filter(self) -> Filter:
        return Filter(reduce(lambda a, b: a & b, [c for c, _ in self.rules]) if self.rules else F.lit(True))


@dataclass(frozen=True)
class Conditional:
    """Sets columns where the condition is true; other rows pass."""

    condition: Column
    columns: Mapping[str, Column]

    def apply(self, df: DataFrame) -> DataFrame:
        return _set(df, self.columns, self.condition)


@dataclass(frozen=True)
class Composite:
    """Transforms in order; a row stops at its first failure and keeps its trace id."""

    transforms: Sequence[Transform]

    def apply(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, t: t.apply(d), self.transforms, df)


@dataclass(frozen=True)
class JsonReshape:
    """The payload written as JSON and read back under another schema, names matched without regard to case.

    from_column reads a JSON text column instead and keeps the other columns. Unreadable JSON is a permanent failure.
    """

    schema: T.StructType
    from_column: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.from_column is None:
            by_name = {c.lower(): c for c in payload_of(df)}
            chosen = [(F.col(by_name[f.name.lower()]) if f.name.lower() in by_name else F.lit(None).cast(f.dataType)).alias(f.name) for f in self.schema]
            text, kept = F.to_json(F.struct(*chosen)), []
        else:
            text, kept = F.col(self.from_column), [c for c in payload_of(df) if c not in {f.name for f in self.schema}]
        whole = T.StructType([*self.schema, T.StructField("_corrupt", T.StringType())])
        read = F.from_json(text, whole, {"columnNameOfCorruptRecord": "_corrupt"})
        df = df.withColumn("_read", read)
        df = fail_where(df, F.col("_read").isNull() | F.col("_read._corrupt").isNotNull(), error("Unreadable JSON", PERMANENT, "Serialization"))
        return df.select(*kept, *[F.when(ok(), F.col("_read")[f.name]).alias(f.name) for f in self.schema], *ENVELOPE)


@dataclass(frozen=True)
class CsvReshape:
    """The payload written as one CSV record and read back under another schema, by name."""

    schema: T.StructType
    separator: str = ","

    def apply(self, df: DataFrame) -> DataFrame:
        by_name = {c.lower(): c for c in payload_of(df)}
        chosen = [(F.col(by_name[f.name.lower()]).cast("string") if f.name.lower() in by_name else F.lit(None).cast("string")).alias(f.name) for f in self.schema]
        whole = T.StructType([*self.schema, T.StructField("_corrupt", T.StringType())])
        read = F.from_csv(F.to_csv(F.struct(*chosen), {"sep": self.separator}), F.lit(_ddl(whole)), {"sep": self.separator, "columnNameOfCorruptRecord": "_corrupt"})
        df = df.withColumn("_read", read)
        df = fail_where(df, F.col("_read._corrupt").isNotNull(), error("Unreadable CSV", PERMANENT, "Serialization"))
        return df.select(*[F.when(ok(), F.col("_read")[f.name]).alias(f.name) for f in self.schema], *ENVELOPE)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


@dataclass(frozen=True)
class MapFields:
    """A new payload: target column to (source column or expression, type or None). A failed cast is a permanent failure."""

    fields: Mapping[str, tuple[str | Column, str | None]]

    def apply(self, df: DataFrame) -> DataFrame:
        made = {}
        for name, (source, kind) in self.fields.items():
            base = F.col(source) if isinstance(source, str) else source
            cast = base.try_cast(kind) if kind else base
            made[name] = cast
            if kind:
                df = fail_where(df, base.isNotNull() & cast.isNull(), error(f"Cannot map {name}", PERMANENT, "Mapping"))
        return df.select(*[F.when(ok(), c).alias(n) for n, c in made.items()], *ENVELOPE)


@dataclass(frozen=True)
class Compress:
    """A binary column compressed in Arrow batches of bounded bytes: gzip (always the same bytes), or brotli if that module is installed."""

    column: str
    algorithm: str = "brotli"
    level: int | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.algorithm == "gzip":
            level = 6 if self.level is None else self.level

            def squeeze(data: bytes) -> bytes:
                return gzip.compress(data, level, mtime=0)
        elif self.algorithm == "brotli":
            try:
                import brotli
            except ImportError as exc:
                raise NotImplementedError("brotli needs the brotli module; use algorithm='gzip'") from exc
            level = 11 if self.level is None else self.level

            def squeeze(data: bytes) -> bytes:
                return brotli.compress(data, quality=level)
        else:
            raise NotImplementedError(f"unknown algorithm {self.algorithm!r}")

        @F.pandas_udf("binary")
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda x: None if x is None else squeeze(bytes(x)))

        return _set(bounded(df), {self.column: run(F.col(self.column).cast("binary"))})


@F.pandas_udf(T.BinaryType())
def gunzip(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else gzip.decompress(bytes(x)))


@dataclass(frozen=True)
class Guarded:
    """A transform behind a breaker: rows fail as Transient / CircuitBreaker, untouched, where `open_when` is true (a column
    that says so, from breaker_replay for one). Python functions get retries, time limits and a breaker by Attempted."""

    inner: Transform
    open_when: Column = field(default_factory=lambda: F.lit(False))

    def apply(self, df: DataFrame) -> DataFrame:
        return self.inner.apply(fail_where(df, self.open_when, error("Circuit breaker is open", TRANSIENT, "CircuitBreaker")))


__all__ = ["Composite", "Compress", "Conditional", "CsvReshape", "Filter", "Guarded", "JsonReshape", "MapFields", "Middleware", "PythonMiddleware", "Transform", "Validation", "gunzip"]
