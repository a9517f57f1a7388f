"""64-bit hash functions on unsigned values. Spark's bigint raises on overflow, so they run on numpy in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The murmur finaliser's multipliers, FNV-1a's offset and prime, the jump hash's step.
MIX_1, MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
JUMP_STEP = 2862933555777941757


def _unsigned(values: pa.Array) -> np.ndarray:
    return values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _result(out: np.ndarray, source: pa.Array, kind: pa.DataType) -> pa.Array:
    return pa.array(out, kind, mask=source.is_null().to_numpy(zero_copy_only=False))


def mix64_array(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX_1)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(33))


def jump_array(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach, 2014) of all keys at once."""
    out, at, key = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys)), keys.copy()
    place = np.zeros(len(keys), dtype=np.int64)
    while len(at):
        out[at] = place
        key = key * np.uint64(JUMP_STEP) + np.uint64(1)
        place = ((place + 1) * (float(1 << 31) / ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        go = place < buckets
        at, key, place = at[go], key[go], place[go]
    return out


def fnv_array(keys: np.ndarray) -> np.ndarray:
    h = np.full(len(keys), FNV_OFFSET, dtype=np.uint64)
    for i in range(8):
        h = (h ^ ((keys >> np.uint64(8 * i)) & np.uint64(0xFF))) * np.uint64(FNV_PRIME)
    return h


@F.arrow_udf(T.LongType())
def _mix64(values: pa.Array) -> pa.Array:
    return _result(mix64_array(_unsigned(values)).view(np.int64), values, pa.int64())


@F.arrow_udf(T.LongType())
def _fnv(values: pa.Array) -> pa.Array:
    return _result(fnv_array(_unsigned(values)).view(np.int64), values, pa.int64())


def mix64(key: Column | str) -> Column:
    """The murmur finaliser of a bigint, as the same 64 bits signed."""
    return _mix64(F.col(key) if isinstance(key, str) else key)


def fnv1a64(key: Column | str) -> Column:
    """FNV-1a of a bigint's eight bytes, lowest first."""
    return _fnv(F.col(key) if isinstance(key, str) else key)


def jump_hash(key: Column | str, buckets: int) -> Column:
    """Bucket in [0, buckets) of a bigint key; null stays null."""
    if buckets < 1:
        raise ValueError("buckets must be positive")

    @F.arrow_udf("int")
    def run(values: pa.Array) -> pa.Array:
        return _result(jump_array(_unsigned(values), buckets).astype(np.int32), values, pa.int32())

    return run(F.col(key) if isinstance(key, str) else key)


def hll_cell(key: Column | str, precision: int) -> Column:
    """struct(idx, rank) of a bigint key for a sketch of 2^precision registers."""

    @F.arrow_udf("struct<idx:int,rank:int>")
    def run(values: pa.Array) -> pa.Array:
        h = mix64_array(_unsigned(values))
        rest = h >> np.uint64(precision)
        # Leading zeros by halving: exact for all 64 bits, unlike a logarithm.
        zeros, x = np.full(len(rest), 64, dtype=np.int64), rest.copy()
        for s in (32, 16, 8, 4, 2, 1):
            big = x >= np.uint64(1 << s)
            zeros -= np.where(big, s, 0)
            x = np.where(big, x >> np.uint64(s), x)
        zeros -= (x > 0).astype(np.int64)
        idx = (h & np.uint64((1 << precision) - 1)).astype(np.int32)
        cells = pa.StructArray.from_arrays([pa.array(idx), pa.array((zeros - precision + 1).astype(np.int32))], ["idx", "rank"])
        return cells if not values.null_count else pa.array([None if n else c for c, n in zip(cells.to_pylist(), values.is_null().to_pylist())], cells.type)

    return run(F.col(key) if isinstance(key, str) else key)
