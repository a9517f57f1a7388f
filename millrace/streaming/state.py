"""Ordered folds of a stream over event time, with keyed state on RocksDB and timers.

They run by transformWithStateInPandas; a query over them needs the session's state store provider that rocksdb() sets. All
timers go by event time: a stream that has nothing new settles, so availableNow and drain() end. (By processing time Spark plans
batches for ever.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_KEY = "state_key"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB: on disk, with changes alone in each checkpoint."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _Ordered(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then folds them in order.

    State: `held`, a list of rows that wait; `fold`, the fold's state and the time of the last row folded. One timer is set
    per key: when its first waiting row may go, or, with none waiting, when it is forgotten.
    """

    def __init__(self, key: str, order: Sequence[str], names: Sequence[str], out: Sequence[str], held: str, state: str, start: Callable[[], tuple], step: Callable[..., tuple], expire_ms: int | None) -> None:
        self.key, self.order, self.names, self.out, self.held_ddl, self.state_ddl = key, list(order), list(names), list(out), held, state
        self.start, self.step, self.expire_ms = start, step, expire_ms
        self.columns = ["_ts", key, *order, *names, "_us"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_ddl)
        self.fold = handle.getValueState("fold", f"{self.state_ddl}, _last long")

    # Each call of the handle is a message to Spark and back, so as few are made as will do.
    # Both handlers work at once instead of on demand: Spark has set the key whose state they meet for the call alone.
    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        timers, new = list(self.handle.listTimers()), []
        waits = bool(timers) and self.held.exists()
        for frame in rows:
            frame.columns = self.columns  # Spark renames some of them
            new += zip(*(_plain(frame[c]) for c in ("_us", *self.order, *self.names)))
        if not new:
            return iter([])
        self.held.appendList(new)
        due = -(-min(r[0] for r in new) // 1000)
        # The one timer is that of a waiting row, or else the key's end, which is put off.
        at = min([due, *timers]) if waits else due
        for old in timers:
            if old != at:
                self.handle.deleteTimer(old)
        if at not in timers:
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.held.get(), key=lambda r: tuple((x is not None, x) for x in r[: 1 + len(self.order)]))
        ready = [r for r in rows if r[0] <= limit]
        wait = rows[len(ready) :]
        *state, last = self.fold.get() or (*self.start(), None)
        made = []
        for us, *rest in ready:
            if self.expire_ms is not None and last is not None and us - last > self.expire_ms * 1000:
                state = self.start()
            state, found = self.step(tuple(state), *rest[len(self.order) :])
            last = us
            made.append((key[0], *found))
        if ready:
            self.held.put(wait) if wait else self.held.clear()
        # Spark deletes the timer that has expired, the key's only one, after this.
        if wait:
            self.handle.registerTimer(-(-wait[0][0] // 1000))
        elif self.expire_ms is not None and last is not None and last + self.expire_ms * 1000 > limit:
            self.handle.registerTimer(-(-last // 1000) + self.expire_ms)
        elif self.expire_ms is not None:
            self.fold.clear()
            last = None
        if last is not None:
            self.fold.update((*state, last))
        return iter([pd.DataFrame(made, columns=[self.key, *self.out])] if made else [])

    def close(self) -> None: ...


def _plain(column: pd.Series) -> list:
    """A column's values as Python's, with None for nulls."""
    values, null = column.tolist(), column.isna().to_numpy()
    return [None if n else x for x, n in zip(values, null)] if null.any() else values


def ordered_fold(
    df: DataFrame, key: str, ts: str, delay: str, order: Sequence[str], columns: dict[str, Column], state: str, start: Callable[[], tuple], step: Callable[..., tuple], out: str, expire_s: float | None = None
) -> DataFrame:
    """(key, *out) for each row of a stream, folded per key in the order of ts, then `order`, however the rows arrive.

    step(state, *columns) gives the next state and the row's values; state and out are DDL, and neither depends on how rows
    fall into batches. A row waits until the watermark, `delay` behind the newest row, has passed it; rows that
    the watermark of the batch before had passed are dropped; the last rows of a stream wait for its next. A key whose next row is more than expire_s after its last
    starts anew, and is forgotten when the watermark has passed that time, so state is bounded by the keys in use. A null key is a
    key of its own; rows without a time take no part. key: of a type that a cast to text and back keeps.
    """
    names, outs = list(columns), [x.split()[0] for x in out.split(", ")]
    # Null keys of Spark's stateful workers meet other keys: the key goes as text that is never null.
    text = F.concat(F.when(F.col(key).isNull(), "-").otherwise("+"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = df.where(F.col(ts).isNotNull()).select(F.col(ts).cast("timestamp").alias("_ts"), text.alias(_KEY), *[F.col(c).alias(c) for c in order], *[c.alias(n) for n, c in columns.items()])
    rows = rows.withColumn("_us", F.unix_micros("_ts")).withWatermark("_ts", delay)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    held = ", ".join(f"`{c}` {kind[c]}" for c in ("_us", *order, *names))
    processor = _Ordered(_KEY, order, names, outs, held, state, start, step, None if expire_s is None else int(expire_s * 1000))
    made = rows.groupBy(_KEY).transformWithStateInPandas(processor, f"{_KEY} string, {out}", "Append", "EventTime")
    own = F.when(F.col(_KEY).startswith("+"), F.substr(_KEY, F.lit(2)).cast(df.schema[key].dataType))
    return made.select(own.alias(key), *outs)
