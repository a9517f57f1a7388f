"""Shared pieces of the corpus operators: shared-folder storage, id chunks, Arrow slicing, vectorised hashing.

Everything here is either a plan fragment or code that runs inside one task on a bounded slice of rows.
"""

from __future__ import annotations

import ctypes
import gc
import math
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.storage import _BATCH, BATCH_BYTES, bounded, forget, workspace  # noqa: F401

#: Text bytes that a task works on at once.
SLICE_BYTES = 2_000_000
#: Text bytes of one id chunk (the unit that grouped tasks hold in memory); larger ones, up to LARGE_CHUNK_BYTES, keep a very
#: large corpus to some MANY_CHUNKS of them.
CHUNK_BYTES, LARGE_CHUNK_BYTES, MANY_CHUNKS = 8_000_000, 64_000_000, 100_000
#: Quantiles asked of one sketch.
MAX_QUANTILES = 4096


def stored(df: DataFrame, label: str, scratch: list[str] | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage ends here, lost executors don't matter.

    scratch: gets the path, for forget_all() when no plan reads it any more.
    """
    spark = df.sparkSession
    path = workspace(spark, label)
    if scratch is not None:
        scratch.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_all(spark: SparkSession, scratch: list[str]) -> None:
    for path in scratch:
        forget(spark, path)
    scratch.clear()


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that are done: Spark deletes them when the driver's garbage is collected.

    What the first collection finds holds others, which go with the second; the deletion itself needs a moment.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def id_chunks(df: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> np.ndarray:
    """Ascending lower bounds of id ranges that hold at most about 2 * chunk_bytes of text each, or one id.

    Quantiles of a sketch in which a row stands once, and once more per mean size of text that it has: no range then has
    over twice the mean. Beyond MAX_QUANTILES ranges each range gets its own quantiles in a second job, so the bounds
    follow the ids at any size. The driver gets the bounds alone, one long per chunk, 100,000 or so at most.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = df.where(F.col(id_col).isNotNull())
    total, n = rows.agg(F.sum(size), F.count("*")).first()
    chunk_bytes = max(chunk_bytes, min(LARGE_CHUNK_BYTES, (total or 0) // MANY_CHUNKS))
    chunks = max(1, math.ceil((total or 0) / chunk_bytes))
    if not n or chunks == 1:
        low = rows.agg(F.min(id_col)).first()[0]
        return np.array([] if low is None else [low], dtype=np.int64)
    often = F.least(size / F.lit(max(1.0, total / n)), F.lit(1e6)).cast("int") + 1
    weighed = rows.select(F.col(id_col).alias("id"), F.explode(F.array_repeat(F.lit(0), often)))
    coarse = min(chunks, MAX_QUANTILES)
    low, inner = weighed.agg(F.min("id"), _quantiles("id", coarse)).first()
    bounds = np.unique(np.array([low, *inner[1:]], dtype=np.int64))
    if chunks > coarse:
        fine = weighed.groupBy(chunk_of("id", bounds).alias("chunk")).agg(_quantiles("id", math.ceil(chunks / coarse)).alias("q"))
        bounds = np.unique(np.concatenate([bounds, *(np.array(r["q"][1:], dtype=np.int64) for r in fine.collect())]))
    return bounds


def _quantiles(column: str, n: int) -> Column:
    return F.percentile_approx(column, [i / n for i in range(n)], 10_000 if n < 1000 else 100_000)


def chunks_of(ids: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """The chunk (0-based) of each id; null ids sort last and go to the last chunk."""
    at = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right") - 1
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), max(len(bounds) - 1, 0), np.maximum(at, 0)).astype(np.int32)


def chunk_of(id_col: str, bounds: np.ndarray) -> Column:
    """chunks_of() as a column."""

    @F.arrow_udf("int")
    def find(ids: pa.Array) -> pa.Array:
        return pa.array(chunks_of(ids, bounds))

    return find(F.col(id_col))


def slices(table: pa.Table | pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Consecutive row ranges of at most `limit` bytes of text (a longer text stands alone)."""
    table = pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table
    sizes = np.cumsum(pc.fill_null(pc.binary_length(table[text_col]), 0).to_numpy().astype(np.int64))
    at, n = 0, table.num_rows
    while at < n:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield table.slice(at, end - at)
        at = end


def give_back() -> None:
    """Return what a task has freed to the system: Spark reuses workers, and their memory counts all the time."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _buffers(column: pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()


def text_bytes(column: pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in _buffers(column)]


# Vectorised polynomial (Rabin-Karp) hashing modulo 2^64. Random odd bases; a finaliser mixes the weak low bits.
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = {"byte": 0x9E3779B97F4A7C15 | 1, "word": 0xD1B54A32D192ED03 | 1}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if kind not in _powers or len(_powers[kind][0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (_BASE[kind], pow(_BASE[kind], -1, 2**64)):
            p = np.ones(m, dtype=np.uint64)
            done = 1
            while done < m:
                p[done : 2 * done] = p[:done] * np.uint64(pow(b, done, 2**64))
                done *= 2
            out.append(p)
        _powers[kind] = (out[0], out[1])
    return _powers[kind][0][:n], _powers[kind][1][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """Hash of values[s:e] (uint64) for each pair: prefix sums of the polynomial, shifted back to the start."""
    up, down = powers(kind, len(values) + 1)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    return mix64(h)


#: Bytes that separate words: space and the controls 09-0D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_hashes(texts: list[bytes], separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and the index of each text's first word (one more at the end)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    sep = separators[buf]
    edge = np.diff(np.concatenate(([True], sep)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    h = rolling(_BYTE[buf], starts, ends, "byte")
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return h, np.searchsorted(starts, at[:-1]).tolist() + [len(starts)]  # type: ignore[return-value]


def window_hashes(words: np.ndarray, first: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of `width` words within one text: hash, text index, first word's index in the text."""
    first_a = np.asarray(first, dtype=np.int64)
    counts = np.maximum(np.diff(first_a) - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = first_a[doc] + pos
    return rolling(words, start, start + width, "word"), doc, pos
