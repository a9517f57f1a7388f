"""Approximate and consistent aggregates, each groupable: distinct counts, log histograms, samples, dedup, shards."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import hll_cell, jump_hash, mix64


def _as_list(by: Sequence[str] | str | None) -> list[str]:
    return [] if by is None else [by] if isinstance(by, str) else list(by)


def spare(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hll_registers(df: DataFrame, key: str, precision: int = 12, by: Sequence[str] | str | None = None) -> DataFrame:
    """The non-zero registers (by..., idx, rank) of a HyperLogLog sketch of a bigint key: a table that merges by max."""
    if not 4 <= precision <= 16:
        raise ValueError("precision must be 4 to 16")
    cell = df.where(F.col(key).isNotNull()).select(*_as_list(by), hll_cell(key, precision).alias("_c"))
    return cell.select(*_as_list(by), "_c.idx", "_c.rank").groupBy(*_as_list(by), "idx").agg(F.max("rank").alias("rank"))


def hll_merge(*registers: DataFrame) -> DataFrame:
    """Union of sketches of one precision."""
    out = registers[0]
    for more in registers[1:]:
        out = out.unionByName(more)
    return out.groupBy(*[c for c in out.columns if c != "rank"]).agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, precision: int = 12, by: Sequence[str] | str | None = None) -> DataFrame:
    """(by..., estimate): bias-corrected harmonic mean, linear counting where registers are empty and the mean is small."""
    m = 1 << precision
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    zeros = F.lit(m) - F.count("idx")
    raw = F.lit(alpha * m * m) / (zeros + F.sum(F.coalesce(F.pow(F.lit(2.0), -F.col("rank")), F.lit(0.0))))
    group = registers.groupBy(*_as_list(by)) if by else registers
    out = group.agg(raw.alias("raw"), zeros.alias("zeros"))
    raw, zeros = F.coalesce("raw", F.lit(0.0)), F.col("zeros")
    linear = F.when(zeros > 0, F.lit(float(m)) * F.log(F.lit(float(m)) / zeros))
    return out.select(*_as_list(by), F.when((raw <= 2.5 * m) & (zeros > 0), linear).otherwise(raw).alias("estimate"))


def distinct_count(df: DataFrame, key: str, by: Sequence[str] | str | None = None, lg_config: int = 12) -> DataFrame:
    """(by..., estimate) by Spark's own mergeable sketch: partial aggregation in the JVM."""
    group = df.groupBy(*_as_list(by)) if by else df
    return group.agg(F.hll_sketch_estimate(F.hll_sketch_agg(key, lg_config)).alias("estimate"))


class LogHistogram:
    """Buckets whose width grows by a constant factor; bucket of v is trunc(ln v / ln base), clamped."""

    def __init__(self, low: float = 0.1, high: float = 100_000.0, buckets: int = 100) -> None:
        self.low, self.buckets, self.base = low, buckets, (high / low) ** (1.0 / buckets)

    def bucket(self, value: Column) -> Column:
        b = (F.log(value) / F.lit(math.log(self.base))).cast("int")
        return F.greatest(F.lit(0), F.least(b, F.lit(self.buckets - 1)))

    def counts(self, df: DataFrame, value: str, by: Sequence[str] | str | None = None) -> DataFrame:
        """(by..., bucket, n); values at or below 0 and nulls are left out."""
        return df.where(F.col(value) > 0).groupBy(*_as_list(by), self.bucket(F.col(value)).alias("bucket")).agg(F.count("*").alias("n"))

    def percentiles(self, df: DataFrame, value: str, at: Sequence[float] = (0.5, 0.95, 0.99), by: Sequence[str] | str | None = None, compat: bool = True) -> DataFrame:
        """(by..., p50, p95, ...): the middle of the first bucket whose running count reaches the rank.

        compat: the rank is floor(total * p), as the classic definition has it; else ceil, so that one value is its own
        median. At most `buckets` rows per group reach the running sum.
        """
        keys = _as_list(by)
        w = Window.partitionBy(*keys)
        run = self.counts(df, value, by).withColumns({"run": F.sum("n").over(w.orderBy("bucket")), "total": F.sum("n").over(w)})
        rank = lambda p: F.floor(F.col("total") * p) if compat else F.ceil(F.col("total") * p)
        first = [F.min(F.when(F.col("run") >= rank(p), F.col("bucket"))).alias(f"b{i}") for i, p in enumerate(at)]
        out = (run.groupBy(*keys) if keys else run).agg(*first)
        fix = lambda i: F.coalesce(F.pow(F.lit(self.base), F.col(f"b{i}") + 0.5), F.lit(0.0))
        return out.select(*keys, *[fix(i).alias(f"p{round(p * 100)}") for i, p in enumerate(at)])


def uniform_sample(df: DataFrame, k: int, seed: int) -> DataFrame:
    """k rows, each set equally likely: a top-k heap per task and one merge of k rows."""
    u = spare(df, "_u")
    return df.withColumn(u, F.rand(seed)).orderBy(u).limit(k).drop(u)


def bottom_k(df: DataFrame, key: str, k: int, by: Sequence[str] | str | None = None) -> DataFrame:
    """The k rows (of each group) with the smallest unsigned mix64 of a bigint key: a uniform sample that reruns alike.

    Groups are cut to k rows before and after the shuffle.
    """
    unsigned = mix64(key).bitwiseXOR(F.lit(-(2**63)))  # flips the sign bit: signed order is then unsigned order
    u = spare(df, "_u")
    if by is None:
        return df.withColumn(u, unsigned).orderBy(u, key).limit(k).drop(u)
    n = spare(df, "_n")
    ranked = df.withColumn(u, unsigned).withColumn(n, F.row_number().over(Window.partitionBy(*_as_list(by)).orderBy(u, key)))
    return ranked.where(F.col(n) <= k).drop(u, n)


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str] | None = None) -> DataFrame:
    """One row per key: any, or the first in an order. Exact, so no new row is ever taken for an old one."""
    if order is None:
        return df.dropDuplicates(list(keys))
    w = Window.partitionBy(*keys).orderBy(*order)
    n = spare(df, "_n")
    return df.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The last n rows of each key in an order: what a bounded queue that drops its oldest rows would hold."""
    turned = [(F.col(c) if isinstance(c, str) else c).desc() for c in order]
    w = Window.partitionBy(*keys).orderBy(*turned)
    rank = spare(df, "_n")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n).drop(rank)


def remove_keys(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The delete of a dedup set: rows whose keys aren't in `gone`."""
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def merge_keys(*tables: DataFrame) -> DataFrame:
    """Union of dedup sets."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out.distinct()


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter for n keys at false-positive rate p."""
    bits = int(-n * math.log(p) / math.log(2) ** 2)
    return bits, max(1, int(bits / n * math.log(2)))


def shards(df: DataFrame, key: str, buckets: int, as_col: str = "shard") -> DataFrame:
    """df with its jump-hash shard."""
    return df.withColumn(as_col, jump_hash(key, buckets))


def reshard(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Shard i in partition i; no row is lost."""
    shard = spare(df, "_shard")
    return shards(df, key, buckets, shard).repartitionById(buckets, F.coalesce(shard, F.lit(0))).drop(shard)
