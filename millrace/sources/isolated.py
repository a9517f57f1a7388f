"""Files read one by one, so that a damaged one costs its own rows alone and leaves a record of its failure."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.plans import envelope

FAILURE = "_failure"
FAILURE_DDL = "struct<path:string,part:bigint,message:string>"
#: Lines of a text file that make a batch.
LINES = 4096


@dataclass(frozen=True)
class IsolatedFiles:
    """Rows of all files under a folder, Parquet or JSON lines, and one row for each part that can't be read.

    read() gives the schema's columns and `_failure` (null, or path, part and message; the columns are null then). A Parquet
    file fails by row group, a text file by line; what can't be opened, or breaks off while it is read, fails as a whole from
    there (part -1, or the number of lines read so far), and what was read before stays. A field that a row lacks is null, one
    that doesn't fit its type fails the line. Files are opened by the file system that their URI names to pyarrow.
    """

    path: str
    schema: str
    format: str = "parquet"

    def __post_init__(self) -> None:
        if self.format not in ("parquet", "json"):
            raise ValueError(f"unknown format {self.format!r}")

    def read(self, spark: SparkSession) -> DataFrame:
        schema = spark.createDataFrame([], self.schema).schema
        out = spark.createDataFrame([], f"{self.schema}, {FAILURE} {FAILURE_DDL}").schema
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.path).select("path")
        many = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return files.repartition(many, "path").mapInArrow(_reader(self.format, to_arrow_schema(schema), to_arrow_schema(out)), out)

    def enveloped(self, spark: SparkSession, key: str | None = None) -> DataFrame:
        """The rows in envelopes: a part that can't be read is a row that failed, for dead letters to keep."""
        df = self.read(spark)
        rows = envelope.wrap(df, key)
        why = envelope.error(F.concat_ws(": ", f"{FAILURE}.path", F.col(f"{FAILURE}.part").cast("string"), f"{FAILURE}.message"), envelope.PERMANENT, "Source", "ReadError")
        return envelope.fail_where(rows, F.col(FAILURE).isNotNull(), why).drop(FAILURE)


def _reader(kind: str, want: pa.Schema, out: pa.Schema):
    def good(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = [table[f.name].cast(f.type) if f.name in table.schema.names else pa.nulls(table.num_rows, f.type) for f in want]
        whole = pa.table([*columns, pa.nulls(table.num_rows, out.field(FAILURE).type)], schema=out)
        yield from whole.to_batches()

    def bad(path: str, part: int, why: BaseException) -> pa.RecordBatch:
        row = [pa.nulls(1, f.type) for f in want]
        return pa.RecordBatch.from_arrays([*row, pa.array([{"path": path, "part": part, "message": f"{type(why).__name__}: {why}"}], out.field(FAILURE).type)], schema=out)

    def parquet(system: fs.FileSystem, at: str, path: str) -> Iterator[pa.RecordBatch]:
        with system.open_input_file(at) as raw:
            file = pq.ParquetFile(raw)
            names = [f.name for f in want if f.name in file.schema_arrow.names]
            for part in range(file.num_row_groups):
                try:
                    batches = list(good(file.read_row_group(part, columns=names, use_threads=False)))
                except (OSError, pa.ArrowException, ValueError) as why:
                    batches = [bad(path, part, why)]
                yield from batches

    def lines(system: fs.FileSystem, at: str, path: str) -> Iterator[pa.RecordBatch]:
        done, held = 0, []
        with system.open_input_stream(at, compression="detect") as raw:
            try:
                for line in _lines_of(raw):
                    held.append(line)
                    if len(held) == LINES:
                        yield from rows(path, done, held)
                        done, held = done + len(held), []
            except (OSError, pa.ArrowException) as why:
                yield from rows(path, done, held)
                yield bad(path, done + len(held), why)
                return
        yield from rows(path, done, held)

    def rows(path: str, first: int, found: list[bytes]) -> Iterator[pa.RecordBatch]:
        kept, failed = [], []
        for i, line in enumerate(found):
            if not line.strip():
                continue
            try:
                row = json.loads(line)
                if not isinstance(row, dict):
                    raise ValueError("not an object")
                row = {f.name: row.get(f.name) for f in want}
                pa.Table.from_pylist([row], schema=want)
                kept.append(row)
            except (ValueError, TypeError, pa.ArrowException) as why:
                failed.append(bad(path, first + i, why))
        if kept:
            yield from good(pa.Table.from_pylist(kept, schema=want))
        yield from failed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                try:
                    system, at = fs.FileSystem.from_uri(path)
                    yield from (parquet if kind == "parquet" else lines)(system, at, path)
                except (OSError, pa.ArrowException, ValueError) as why:
                    yield bad(path, -1, why)

    return run


def _lines_of(raw: Any) -> Iterator[bytes]:
    rest = b""
    while block := raw.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest
