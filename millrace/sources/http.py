"""HTTP source and sink. The source is a Python data source; the sink posts from the tasks."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.operators.resilience import RetryPolicy
from millrace.plans.envelope import succeeded


def _open(request: urllib.request.Request, timeout: float, policy: RetryPolicy | None) -> bytes:
    attempt = 0
    while True:
        attempt += 1
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return reply.read()
        except (urllib.error.URLError, TimeoutError) as exc:
            final = isinstance(exc, urllib.error.HTTPError) and exc.code < 500
            if policy is None or final or attempt > policy.max_retries:
                raise
            time.sleep(policy.delay(attempt) / 1000)


class _Page(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, schema: Any, options: dict) -> None:
        self.names = schema.fieldNames()
        self.urls = json.loads(options["urls"])
        self.timeout = float(options.get("timeout", 30))
        self.retries = int(options.get("retries", 0))

    def partitions(self) -> list[InputPartition]:
        return [_Page(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        policy = RetryPolicy(self.retries, 100) if self.retries else None
        rows = json.loads(_open(urllib.request.Request(partition.url), self.timeout, policy) or b"null")
        if rows is not None and not isinstance(rows, list):
            raise ValueError(f"{partition.url}: the body is not a JSON array")
        for row in rows or []:
            if row is not None:
                by_name = {k.lower(): v for k, v in row.items()}
                yield tuple(by_name.get(n.lower()) for n in self.names)


class HttpJson(DataSource):
    """One GET per URL, in parallel over URLs; each body is a JSON array of objects, null means no rows, other than 2xx raises."""

    @classmethod
    def name(cls) -> str:
        return "millrace_http"

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


@dataclass(frozen=True)
class HttpSource:
    urls: tuple[str, ...]
    schema: str
    timeout_s: float = 30.0
    retries: int = 0

    def read(self, spark: SparkSession) -> DataFrame:
        spark.dataSource.register(HttpJson)
        options = {"urls": json.dumps(list(self.urls)), "timeout": self.timeout_s, "retries": self.retries}
        return spark.read.format("millrace_http").schema(self.schema).options(**options).load()


@dataclass(frozen=True)
class HttpSink:
    """One POST of a JSON object per successful row. The reply's status counts only with check_status: receivers must
    bear repeats, as Spark may run a task again."""

    url: str
    policy: RetryPolicy | None = field(default=None)
    timeout_s: float = 30.0
    check_status: bool = False

    def write(self, df: DataFrame) -> None:
        url, policy, timeout, strict = self.url, self.policy, self.timeout_s, self.check_status

        def send(rows: Iterator) -> None:
            for row in rows:
                request = urllib.request.Request(url, row[0].encode(), {"Content-Type": "application/json"}, method="POST")
                try:
                    _open(request, timeout, policy)
                except urllib.error.HTTPError:
                    if strict:
                        raise

        succeeded(df).selectExpr("to_json(struct(*)) AS body").foreachPartition(send)
