"""JSON arrays read in byte ranges: one large array feeds many tasks.

Whether a byte lies inside a string, and how deep, depends on all bytes before it. So a first pass tells of each range, for a start
outside and inside a string, how the quotes and brackets in it change that; an exclusive scan over a file's ranges, which are a
few numbers each, gives each range its start; a second pass cuts out the elements whose first byte lies in the range, reading on
behind it to the end of the last one. Elements become rows in the JVM by from_json.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_QUOTE, _BACK = ord('"'), ord("\\")
_OPEN, _CLOSE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_OPEN[[ord("["), ord("{")]] = True
_CLOSE[[ord("]"), ord("}")]] = True
_BLANK = b" \t\r\n"
#: Bytes of a range, and of what is read on behind one at a time.
RANGE, MORE = 8 << 20, 1 << 16

_RANGES = "path string, at long, size long, total long"


def _read(path: str, at: int, n: int) -> bytes:
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as file:
        return file.read_at(n, at)


def _quotes(data: np.ndarray, before: int) -> np.ndarray:
    """Which bytes are quotes that no backslash escapes; before: backslashes in a row that end just ahead."""
    back = data == _BACK
    at = np.arange(len(data))
    # A run of backslashes that ends at i - 1 escapes byte i if its length is odd.
    last_other = np.maximum.accumulate(np.where(~back, at, -1))
    run = np.where(back, at - last_other + np.where(last_other < 0, before, 0), 0)
    prior = np.concatenate([[before], run[:-1]]) if len(data) else run
    return (data == _QUOTE) & (prior % 2 == 0)


def _ahead(path: str, at: int) -> int:
    """Backslashes in a row just ahead of a byte."""
    n, step = 0, 64
    while at > 0:
        part = _read(path, max(0, at - step), min(step, at))
        tail = len(part) - len(part.rstrip(b"\\"))
        n += tail
        if tail < len(part):
            break
        at -= len(part)
    return n


def _change(data: np.ndarray, quotes: np.ndarray, inside: bool) -> np.ndarray:
    """Depth added by each byte, for a start inside or outside a string."""
    within = (np.cumsum(quotes) - quotes + inside) % 2 == 1
    return np.where(within | quotes, 0, _OPEN[data].astype(np.int64) - _CLOSE[data])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, at, size in zip(*(batch[c].to_pylist() for c in ("path", "at", "size"))):
            data = np.frombuffer(_read(path, at, size), dtype=np.uint8)
            quotes = _quotes(data, _ahead(path, at))
            out.append((int(quotes.sum() % 2), int(_change(data, quotes, False).sum()), int(_change(data, quotes, True).sum())))
        columns = list(zip(*out)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], [*batch.schema.names, "odd", "outside", "inside"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, at, size, total, odd, depth in zip(*(batch[c].to_pylist() for c in ("path", "at", "size", "total", "in_string", "depth"))):
            raw = bytearray(_read(path, at, size))
            found: list[str] = []
            begins: int | None = None
            done = 0  # bytes of raw that have been looked at
            before = _ahead(path, at)
            while True:
                data = np.frombuffer(bytes(raw[done:]), dtype=np.uint8)
                quotes = _quotes(data, before)
                change = _change(data, quotes, bool(odd))
                level = depth + np.cumsum(change)
                within = (np.cumsum(quotes) - quotes + odd) % 2 == 1
                marks = np.flatnonzero((~within) & ~quotes & (((data == ord("[")) & (level == 1) & (change == 1)) | ((data == ord(",")) & (level == 1)) | ((data == ord("]")) & (level == 0) & (change == -1))))
                over = False
                for m in marks.tolist():
                    i = done + m
                    if begins is not None:
                        text = bytes(raw[begins:i]).strip(_BLANK)
                        if text:
                            found.append(text.decode())
                        begins = None
                    if i >= size:  # elements from here on are another range's
                        over = True
                        break
                    if data[m] != ord("]"):
                        begins = i + 1
                if over or begins is None or at + len(raw) >= total:
                    break
                # The last element goes on behind the range.
                done, odd, depth = len(raw), (odd + int(quotes.sum())) % 2, int(level[-1]) if len(level) else depth
                tail = bytes(raw[-1024:])
                before = len(tail) - len(tail.rstrip(b"\\"))
                before = _ahead(path, at + len(raw)) if before == len(tail) else before
                raw += _read(path, at + len(raw), min(MORE, total - at - len(raw)))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["value"])


@dataclass(frozen=True)
class JsonArraySource:
    """Rows of files that each hold a JSON array of objects, or several one after the other, in ranges of `range_bytes` whatever a file's size.

    An element that isn't an object of the schema gives nulls, as from_json does; a field that a row lacks is null. Nothing is
    held but a range and its last element. Files are opened by the file system that their URI names to pyarrow, uncompressed.
    """

    path: str
    schema: str
    range_bytes: int = RANGE

    def elements(self, spark: SparkSession) -> DataFrame:
        """One row per element, as text."""
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.path).select("path", F.col("length").alias("total"))
        starts = files.where("total > 0").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(self.range_bytes).cast("long"))))
        ranges = starts.select("path", "at", F.least(F.lit(self.range_bytes), F.col("total") - F.col("at")).cast("long").alias("size"), "total")
        many = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        ranges = ranges.repartition(many, "path", "at")
        told = ranges.mapInArrow(_summaries, f"{_RANGES}, odd long, outside long, inside long")
        before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        told = told.withColumn("in_string", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
        own: Column = F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside"))
        told = told.withColumn("own", own).withColumn("depth", F.coalesce(F.sum("own").over(before), F.lit(0)))
        told = told.select("path", "at", "size", "total", "in_string", "depth").repartition(many, "path", "at")
        return told.mapInArrow(_elements, "value string")

    def read(self, spark: SparkSession) -> DataFrame:
        return self.elements(spark).select(F.from_json("value", self.schema).alias("r")).select("r.*")
