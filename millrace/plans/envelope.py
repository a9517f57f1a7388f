"""The row envelope: payload columns at the top level, and four columns that carry identity, lineage and failure.

A row has failed exactly if `_error` is not null. Payload columns stay where they are, so pruning and pushdown reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACE, META, ERROR = "_trace_id", "_metadata", "_error"
ENVELOPE = (TRACE, META, ERROR)
ERROR_DDL = "struct<message:string,type:string,category:string,exception:string>"
TRANSIENT, PERMANENT = "Transient", "Permanent"
FILTERED = "Filtered"


def error(message: Column | str, kind: str = PERMANENT, category: str | None = None, exception: Column | str | None = None) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(as_col(message).alias("message"), F.lit(kind).alias("type"), F.lit(category).cast("string").alias("category"), as_col(exception).alias("exception"))


def no_error() -> Column:
    return F.lit(None).cast(ERROR_DDL)


def wrap(df: DataFrame, key: Column | str | None = None, source: str | None = None, pipeline: str | None = None) -> DataFrame:
    """df in an envelope. The trace id is the key (a whole number) or a hash of the key or of all columns."""
    if key is None:
        trace = F.xxhash64(*df.columns)
    else:
        column = F.col(key) if isinstance(key, str) else key
        whole = df.select(column.alias("k")).schema["k"].dataType.typeName() in ("long", "integer", "short", "byte")
        trace = column.cast("long") if whole else F.xxhash64(column)
    facts = [(k, v) for k, v in (("lineage_source", source), ("lineage_pipeline", pipeline)) if v is not None]
    meta = F.create_map(*[F.lit(x) for kv in facts for x in kv]) if facts else F.lit(None)
    return df.withColumns({TRACE: trace, META: meta.cast("map<string,string>"), ERROR: no_error()})


def payload_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ENVELOPE]


def ok() -> Column:
    return F.col(ERROR).isNull()


def fail_where(df: DataFrame, condition: Column, failure: Column) -> DataFrame:
    """Rows that have not failed yet fail where the condition is true."""
    return df.withColumn(ERROR, F.when(ok() & F.coalesce(condition, F.lit(False)), failure).otherwise(F.col(ERROR)))


def succeeded(df: DataFrame) -> DataFrame:
    return df.where(ok()).select(*payload_of(df))


def failed(df: DataFrame, with_filtered: bool = False) -> DataFrame:
    """Failures; rows that a filter turned away count only on demand."""
    bad = df.where(~ok())
    return bad if with_filtered else bad.where(~F.col(ERROR)["category"].eqNullSafe(F.lit(FILTERED)))


def as_result(df: DataFrame) -> DataFrame:
    """trace_id, is_success, value (null on failure), error."""
    value = F.when(ok(), F.struct(*payload_of(df)))
    return df.select(F.col(TRACE).alias("trace_id"), ok().alias("is_success"), value.alias("value"), F.col(ERROR).alias("error"))


def describe(failure: Column) -> Column:
    """An error as one line of text."""
    return F.format_string("Type: %s, Category: %s, Message: %s", failure["type"], F.coalesce(failure["category"], F.lit("N/A")), failure["message"])


def lineage(df: DataFrame, **facts: str) -> DataFrame:
    """Add facts to the metadata; later ones win."""
    more = F.create_map(*[F.lit(x) for k, v in facts.items() for x in (k, v)])
    base = F.coalesce(F.map_filter(F.col(META), lambda k, _: ~k.isin(*facts)), F.create_map().cast("map<string,string>"))
    return df.withColumn(META, F.map_concat(base, more))
