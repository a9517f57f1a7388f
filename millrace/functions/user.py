"""User-defined aggregates with partial sums, and table functions."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Aggregator(Protocol):
    """zero() is an empty state; add() puts rows into a state; merge() joins two; finish() gives the output columns."""

    def zero(self) -> Any: ...

    def add(self, state: Any, rows: pd.DataFrame) -> Any: ...

    def merge(self, a: Any, b: Any) -> Any: ...

    def finish(self, state: Any) -> dict: ...


def aggregate(df: DataFrame, by: Sequence[str], columns: Sequence[str], aggregator: Aggregator, out: str) -> DataFrame:
    """(by..., out...) of each group. Each task sends one state per group and batch; states are merged, rows don't travel.

    A null key is a group of its own. out: DDL of what finish() gives. No rows give no groups.
    """
    keys = list(by)
    held = df.select(*keys, *columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name in keys)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*(k if isinstance(k, tuple) else (k,)), pickle.dumps(aggregator.add(aggregator.zero(), own[list(columns)]))) for k, own in frame.groupby(keys, dropna=False)]
            yield pd.DataFrame(rows, columns=[*keys, "_state"])

    def final(frame: pd.DataFrame) -> pd.DataFrame:
        state = aggregator.zero()
        for blob in frame["_state"]:
            state = aggregator.merge(state, pickle.loads(blob))
        return pd.DataFrame([{**{k: frame[k].iloc[0] for k in keys}, **aggregator.finish(state)}])

    states = held.mapInPandas(partial, f"{kinds}, _state binary")
    return states.groupBy(*keys).applyInPandas(final, f"{kinds}, {out}")


def register_table_function(spark: SparkSession, name: str, fn: Callable[..., Iterable[tuple]], out: str) -> None:
    """fn(*values) yields tuples; afterwards SQL can say FROM t, LATERAL name(t.a, t.b). out: DDL of the tuples."""

    class Rows:
        def eval(self, *values: Any) -> Iterator[tuple]:
            yield from fn(*values)

    spark.udtf.register(name, F.udtf(Rows, returnType=out))


def scalar(fn: Callable[..., pd.Series], out: str) -> Callable[..., Column]:
    """A function of pandas Series as a column function, in Arrow batches."""
    return F.pandas_udf(fn, out)
