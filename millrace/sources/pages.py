"""Numbered pages of rows as a data source of Spark: a folder's files or a server's answers, read as a batch or a stream and
written with commit and abort.

    spark.read.format("millrace_pages").schema("k long").load("/data/pages")
    spark.readStream.format("millrace_pages").schema("k long").option("pages", 10).load("http://host/feed")

A page is a JSON array of objects. Of a folder, pages are the files that manifests name, in the manifests' order, or, without
manifests, its *.json files in the order of their names; of a server, GET <url>/index.json gives the names of its pages, in order. Pages
are only ever added at the end. A stream's offset is the number of pages taken, so a restart goes on with the next one.
"""

from __future__ import annotations

import json
import math
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

_MANIFESTS, _DRAFTS = "_manifests", "_drafts"


class _Place:
    """A folder or a server."""

    def __init__(self, path: str, timeout_s: float) -> None:
        self.path, self.timeout_s = path.rstrip("/"), timeout_s
        self.remote = path.startswith(("http://", "https://"))
        if not self.remote:
            self.system, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
            self.root = self.root.rstrip("/")
        #: Pages by manifest, as far as read: a manifest that is there stays as it is.
        self.listed: dict[str, list[str]] = {}

    def get(self, name: str) -> bytes:
        if self.remote:
            with urllib.request.urlopen(f"{self.path}/{name}", timeout=self.timeout_s) as reply:
                return reply.read()
        with self.system.open_input_stream(f"{self.root}/{name}") as file:
            return file.read()

    def put(self, name: str, body: bytes) -> None:
        where = f"{self.root}/{name}"
        self.system.create_dir(where.rpartition("/")[0], recursive=True)
        draft = f"{where}.{uuid.uuid4().hex}.tmp"
        with self.system.open_output_stream(draft) as file:
            file.write(body)
        self.system.move(draft, where)

    def names(self, folder: str = "") -> list[str]:
        found = self.system.get_file_info(fs.FileSelector(f"{self.root}/{folder}".rstrip("/"), allow_not_found=True))
        return sorted(x.base_name for x in found if x.type == fs.FileType.File and x.base_name.endswith(".json"))

    def pages(self) -> list[str]:
        if self.remote:
            return json.loads(self.get("index.json"))
        manifests = self.names(_MANIFESTS)
        for m in manifests:
            if m not in self.listed:
                self.listed[m] = json.loads(self.get(f"{_MANIFESTS}/{m}"))
        return [p for m in manifests for p in self.listed[m]] if manifests else self.names()


@dataclass
class _Page(InputPartition):
    name: str


class _Reading:
    def __init__(self, options: dict, names: list[str]) -> None:
        self.place = _Place(options["path"], float(options.get("timeout", 30)))
        self.fields = names
        self.most, self.share = int(options.get("pages", 0)), float(options.get("share", 0))

    def read(self, partition: Any) -> Iterator[tuple]:
        """Fields by name, whatever its case; null rows are left out."""
        rows = json.loads(self.place.get(partition.name) or b"[]")
        if not isinstance(rows, list):
            raise ValueError(f"{partition.name}: not a JSON array")
        for row in rows:
            if row is not None:
                by_name = {k.lower(): v for k, v in row.items()}
                yield tuple(by_name.get(f.lower()) for f in self.fields)


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [_Page(p) for p in self.place.pages()]


class _Stream(_Reading, DataSourceStreamReader):
    """Asked for its latest offset, it goes at most `pages` pages on (0: as far as there are any), or `share` of those that
    wait, if that is more: a backlog takes a number of micro-batches that grows with its logarithm, and ends `pages` by `pages`.
    """

    taken: int | None = None

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        there, taken = len(self.place.pages()), self.taken or 0
        step = max(self.most, math.floor(self.share * (there - taken)))
        self.taken = max(taken, min(there, taken + step)) if self.most else there
        return {"page": self.taken}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.taken = max(self.taken or 0, end["page"])
        return [_Page(p) for p in self.place.pages()[start["page"] : end["page"]]]

    def commit(self, end: dict) -> None:
        self.taken = max(self.taken or 0, end["page"])


@dataclass
class _Written(WriterCommitMessage):
    drafts: list[str]


class _Writing:
    """Tasks write drafts; what is committed is moved to its place and then named in one manifest, which makes it visible.

    A task that failed or ran twice leaves a draft that no manifest names; abort deletes the drafts of the tasks that ended.
    """

    def __init__(self, options: dict, names: list[str]) -> None:
        self.place = _Place(options["path"], 30)
        if self.place.remote:
            raise ValueError("pages are written to folders")
        self.fields, self.rows = names, int(options.get("rows", 10_000))

    def write(self, iterator: Iterator[Any]) -> _Written:
        drafts, held = [], []
        for row in iterator:
            held.append(dict(zip(self.fields, row)))
            if len(held) == self.rows:
                drafts.append(self._draft(held))
                held = []
        if held:
            drafts.append(self._draft(held))
        return _Written(drafts)

    def _draft(self, rows: list[dict]) -> str:
        name = f"{_DRAFTS}/{uuid.uuid4().hex}.json"
        self.place.put(name, json.dumps(rows, default=str).encode())
        return name

    def _publish(self, messages: list[Any], number: str) -> None:
        if f"{number}.json" in self.place.names(_MANIFESTS):  # this batch was committed before
            self._drop(messages)
            return
        pages = []
        for i, draft in enumerate(d for m in messages if m is not None for d in m.drafts):
            pages.append(f"page-{number}-{i:06d}.json")
            self.place.system.move(f"{self.place.root}/{draft}", f"{self.place.root}/{pages[-1]}")
        self.place.put(f"{_MANIFESTS}/{number}.json", json.dumps(pages).encode())

    def _drop(self, messages: list[Any]) -> None:
        for draft in (d for m in messages if m is not None for d in m.drafts):
            self.place.system.delete_file(f"{self.place.root}/{draft}")


class _BatchWriter(_Writing, DataSourceWriter):
    def commit(self, messages: list[Any]) -> None:
        self._publish(messages, f"{len(self.place.names(_MANIFESTS)):012d}")

    def abort(self, messages: list[Any]) -> None:
        self._drop(messages)


class _StreamWriter(_Writing, DataSourceStreamWriter):
    def commit(self, messages: list[Any], batchId: int) -> None:
        self._publish(messages, f"{batchId:012d}")

    def abort(self, messages: list[Any], batchId: int) -> None:
        self._drop(messages)


class Pages(DataSource):
    """Options: path; pages (a stream's micro-batch takes so many), share (or this part of those that wait, if more), timeout (seconds of a GET), rows (of a page written)."""

    @classmethod
    def name(cls) -> str:
        return "millrace_pages"

    def schema(self) -> str:
        raise ValueError("pages need a schema")

    def reader(self, schema: Any) -> DataSourceReader:
        return _Batch(dict(self.options), schema.fieldNames())

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return _Stream(dict(self.options), schema.fieldNames())

    def writer(self, schema: Any, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("pages are only ever added")
        return _BatchWriter(dict(self.options), schema.fieldNames())

    def streamWriter(self, schema: Any, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(dict(self.options), schema.fieldNames())
