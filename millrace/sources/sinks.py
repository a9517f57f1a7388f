"""Sinks: each has write(df) for an enveloped DataFrame. Value sinks take rows that succeeded, dead letters the others."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.resilience import dead_letters
from millrace.plans.envelope import as_result, succeeded
from millrace.sources import bulk


class Sink(Protocol):
    """write() takes a whole run's rows. A sink with write_batch(df, n) takes a stream's micro-batch n so that a batch that
    Spark repeats replaces itself; others get write() for each micro-batch and see a repeated batch twice."""

    def write(self, df: DataFrame) -> None: ...


def _of_batch(sink: Any, n: int) -> Any:
    """The same sink for micro-batch n: a folder batch_id=n that is written as a whole, however often the batch runs."""
    return replace(sink, path=f"{sink.path.rstrip('/')}/batch_id={n}", mode="overwrite")


@dataclass(frozen=True)
class FileSink:
    """Successful rows in any format that Spark writes, by partition."""

    path: str
    format: str = "parquet"
    mode: str = "overwrite"
    options: Mapping[str, Any] = field(default_factory=dict)
    partition_by: tuple[str, ...] = ()

    def write(self, df: DataFrame) -> None:
        succeeded(df).write.format(self.format).mode(self.mode).options(**self.options).partitionBy(*self.partition_by).save(self.path)

    def write_batch(self, df: DataFrame, n: int) -> None:
        _of_batch(self, n).write(df)


def CsvSink(path: str, separator: str = ",", mode: str = "overwrite") -> FileSink:
    """Delimited text with a header."""
    return FileSink(path, "csv", mode, {"header": True, "sep": separator})


@dataclass(frozen=True)
class JsonSink:
    """Successful rows as JSON, one a line; as_array writes one indented array, held by one task: for small outputs."""

    path: str
    as_array: bool = False
    mode: str = "overwrite"

    def write(self, df: DataFrame) -> None:
        rows = succeeded(df)
        if self.as_array:
            whole = rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns)), {"pretty": "true"}).alias("value"))
            whole.coalesce(1).write.mode(self.mode).text(self.path)
        else:
            rows.write.mode(self.mode).json(self.path)

    def write_batch(self, df: DataFrame, n: int) -> None:
        _of_batch(self, n).write(df)


@dataclass(frozen=True)
class JdbcSink:
    """Successful rows appended to a table of an external database, in batches.

    through: a folder that driver and executors share. An embedded Derby database can be opened by the driver's process alone;
    it loads the rows from files there.
    """

    url: str
    table: str
    mode: str = "append"
    options: Mapping[str, str] = field(default_factory=dict)
    through: str | None = None

    def write(self, df: DataFrame) -> None:
        rows = succeeded(df)
        into = lambda r: r.write.format("jdbc").mode(self.mode).options(url=self.url, dbtable=self.table, **self.options).save()
        if self.through is None:
            into(rows)
            return
        into(rows.limit(0))  # makes the table; no task
        with bulk.connected(df.sparkSession, self.url) as link:
            bulk.load(link, rows, self.table, self.through)


@dataclass(frozen=True)
class LedgerSink:
    """Successful rows in a table of an external database, each micro-batch of a stream once, however often it runs.

    Tasks write the rows to a staging table of the batch, each under a number of its own; then one transaction copies them
    to the table and the batch's number to a ledger, so both are there or neither. A batch that the ledger knows is skipped; one that
    failed on the way begins with a staging table of its own again. A task that ran twice left rows with equal numbers, of which one
    is copied. `stream` names the stream in the ledger. The database does the copying; the driver sends it statements alone.
    through: as of JdbcSink; files hold what each task wrote once.
    """

    url: str
    table: str
    stream: str
    options: Mapping[str, str] = field(default_factory=dict)
    ledger: str = "millrace_ledger"
    through: str | None = None

    def write(self, df: DataFrame) -> None:
        self.write_batch(df, -1)

    def write_batch(self, df: DataFrame, n: int) -> None:
        rows = succeeded(df)
        spark, stage = df.sparkSession, f"{self.table}_stage_{n if n >= 0 else 'once'}"
        with bulk.connected(spark, self.url) as link:
            if not self._table(link, self.ledger):
                _run(link, f'CREATE TABLE {_quoted(self.ledger)} ("stream" VARCHAR(200) NOT NULL, "batch" BIGINT NOT NULL, PRIMARY KEY ("stream", "batch"))')
                link.commit()
            if self._known(link, n):
                return
            if not self._table(link, self.table):
                self._save(rows.limit(0), self.table, "append")
            names, once = ", ".join(_quoted(c) for c in rows.columns), ""
            if self.through is None:
                once = self._stage(rows, stage)
            else:
                self._save(rows.limit(0), stage, "overwrite")
                bulk.load(link, rows, _quoted(stage), self.through)
            try:
                _run(link, f"INSERT INTO {_quoted(self.table)} ({names}) SELECT {names} FROM {_quoted(stage)} s{once}")
                self._remember(link, n)
                link.commit()
            except Exception:
                link.rollback()
                raise
            _run(link, f"DROP TABLE {_quoted(stage)}")
            link.commit()

    def _stage(self, rows: DataFrame, stage: str) -> str:
        """Writes the staging table; gives the condition that leaves out copies by tasks that ran twice."""
        copy = F.expr("reflect('java.util.UUID', 'randomUUID')").cast("varchar(40)")
        self._save(rows.withColumns({"_row": F.monotonically_increasing_id(), "_copy": copy}), stage, "overwrite", {"createTableColumnTypes": "_copy VARCHAR(40)"})
        return f' WHERE NOT EXISTS (SELECT 1 FROM {_quoted(stage)} t WHERE t."_row" = s."_row" AND t."_copy" < s."_copy")'

    def _save(self, rows: DataFrame, table: str, mode: str, more: Mapping[str, str] | None = None) -> None:
        rows.write.format("jdbc").mode(mode).options(url=self.url, dbtable=_quoted(table), **self.options, **(more or {})).save()

    def _table(self, link: Any, name: str) -> bool:
        found = link.getMetaData().getTables(None, None, name, None)
        try:
            return found.next()
        finally:
            found.close()

    def _known(self, link: Any, n: int) -> bool:
        ask = link.prepareStatement(f'SELECT 1 FROM {_quoted(self.ledger)} WHERE "stream" = ? AND "batch" = ?')
        try:
            ask.setString(1, self.stream)
            ask.setLong(2, n)
            return ask.executeQuery().next()
        finally:
            ask.close()

    def _remember(self, link: Any, n: int) -> None:
        put = link.prepareStatement(f'INSERT INTO {_quoted(self.ledger)} VALUES (?, ?)')
        try:
            put.setString(1, self.stream)
            put.setLong(2, n)
            put.executeUpdate()
        finally:
            put.close()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _run(link: Any, sql: str) -> None:
    statement = link.createStatement()
    try:
        statement.execute(sql)
    finally:
        statement.close()


@dataclass(frozen=True)
class DbApiSink:
    """Successful rows through a DB-API connection: connect() is called in each task; sql has :name placeholders."""

    connect: Callable[[], Any]
    sql: str | None = None
    table: str | None = None
    batch: int = 1000

    def write(self, df: DataFrame) -> None:
        rows = succeeded(df)
        names = rows.columns
        sql = self.sql or f"INSERT INTO {self.table} ({', '.join(names)}) VALUES ({', '.join(':' + n for n in names)})"
        connect, batch = self.connect, self.batch

        def run(part: Iterator) -> None:
            link, held = connect(), []
            try:
                for row in part:
                    held.append(row.asDict())
                    if len(held) >= batch:
                        link.cursor().executemany(sql, held)
                        held = []
                if held:
                    link.cursor().executemany(sql, held)
                link.commit()
            finally:
                link.close()

        rows.foreachPartition(run)


@dataclass(frozen=True)
class LoggerSink:
    """Each row to the executors' log: successes at info, failures at error."""

    name: str = "millrace"

    def write(self, df: DataFrame) -> None:
        name = self.name

        def run(part: Iterator) -> None:
            log = logging.getLogger(name)
            for trace, good, value, why in part:
                if good:
                    log.info("%s: %s", trace, value)
                else:
                    log.error("%s: %s", trace, why)

        as_result(df).select("trace_id", "is_success", F.to_json("value"), F.col("error.message")).foreachPartition(run)


@dataclass(frozen=True)
class DeadLetterSink:
    """Failures (filtered rows apart) with payload, error and attempts: JSON lines, or Parquet."""

    path: str
    format: str = "json"
    attempts: str | None = None
    mode: str = "overwrite"

    def write(self, df: DataFrame) -> None:
        dead_letters(df, self.attempts if self.attempts in df.columns else None).write.format(self.format).mode(self.mode).save(self.path)

    def write_batch(self, df: DataFrame, n: int) -> None:
        _of_batch(self, n).write(df)


@dataclass(frozen=True)
class FnSink:
    """Any function of the enveloped DataFrame."""

    fn: Callable[[DataFrame], None]

    def write(self, df: DataFrame) -> None:
        self.fn(df)


def fan_out(df: DataFrame, sinks: Sequence[Sink], keep: bool = True, batch: int | None = None) -> None:
    """All rows to all sinks, in order. With several sinks the rows are persisted, so that sources are read once.

    batch: the number of a stream's micro-batch, for sinks that write by it.
    """
    many = keep and len(sinks) > 1 and not df.isStreaming
    if many:
        df = df.persist()
    try:
        for sink in sinks:
            if batch is not None and hasattr(sink, "write_batch"):
                sink.write_batch(df, batch)
            else:
                sink.write(df)
    finally:
        if many:
            df.unpersist()
