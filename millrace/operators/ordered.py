"""Ordered folds: a key's rows go through a state one after the other, in an explicit order.

Rows are dealt by key and sorted by Spark, which spills; a task sees them as a stream of Arrow batches and keeps one key's
state alone. So a key may have any number of rows (they take one task's time, as a recurrence must).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

_NO_KEY = object()


def fold(
    df: DataFrame, key: str, order: Sequence[str], columns: Sequence[Column], start: Callable[[], Any], step: Callable[..., Any],
    out: str, last: Callable[[Any], tuple] | None = None, kept: Sequence[str] = (),
) -> DataFrame:
    """step(state, *columns) for each row by key, in `order` (nulls first; a tie-breaker belongs in it).

    With last: step gives the next state, and each key one row (key, *last(state)). Without: step gives (state, values),
    and each row one row (key, *kept, *values). A null key is a key of its own. out: DDL of the columns after the key.
    """
    names = [f"_c{i}" for i in range(len(columns))]
    rows = df.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"_p{i}") for i, c in enumerate(kept)], *[c.alias(n) for c, n in zip(columns, names)])
    rows = rows.repartition("_k").sortWithinPartitions("_k", *[f"_o{i}" for i in range(len(order))])
    rows = rows.select("_k", *[f"_p{i}" for i in range(len(kept))], *names)
    head = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *kept)] if last is None else [f"`{key}` {df.schema[key].dataType.simpleString()}"]
    ddl = ", ".join([*head, out])
    schema = to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = _NO_KEY, None
        for batch in batches:
            made = []
            for k, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if now is _NO_KEY or k != now:
                    if last and now is not _NO_KEY:
                        made.append((now, *last(state)))
                    now, state = k, start()
                if last:
                    state = step(state, *values[width:])
                else:
                    state, found = step(state, *values[width:])
                    made.append((k, *values[:width], *found))
            yield _batch(made, schema)
        if last and now is not _NO_KEY:
            yield _batch([(now, *last(state))], schema)

    return rows.mapInArrow(run, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
