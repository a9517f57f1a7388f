"""Joins on a range of times, by bins: pairs, and counts and sums without pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_US = 1_000_000


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def _bin(us: Column, width: int) -> Column:
    return F.floor(us / width).cast("long")


def interval_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, before_s: float, after_s: float = 0.0) -> DataFrame:
    """Pairs of equal keys, the right row from before_s earlier to after_s later than the left one, both ends included.

    Times are cut into bins as wide as the range, so a left row meets two or three bins and a right row lies in one: each pair
    is found once, and a key with many rows is dealt out by bins. Columns of the right side are prefixed by right_; null
    keys and times match nothing.
    """
    low, high = int(before_s * _US), int(after_s * _US)
    width = max(1, low + high)
    right = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns]).withColumn("_rt", _micros(f"right_{right_time}"))
    right = right.withColumn("_rbin", _bin(F.col("_rt"), width))
    left = left.withColumn("_lt", _micros(time)).where(F.col("_lt").isNotNull())
    left = left.withColumn("_lbin", F.explode(F.sequence(_bin(F.col("_lt") - low, width), _bin(F.col("_lt") + high, width))))
    same = [F.col("_lbin") == F.col("_rbin"), *[F.col(k) == F.col(f"right_{k}") for k in keys]]
    inside = F.col("_rt").between(F.col("_lt") - low, F.col("_lt") + high)
    return left.join(right, reduce(lambda x, y: x & y, [*same, inside])).drop("_lt", "_lbin", "_rt", "_rbin")


def interval_sums(
    left: DataFrame, right: DataFrame, keys: Sequence[str], row_key: Sequence[str], time: str, right_time: str, before_s: float, after_s: float = 0.0, sums: dict[str, Column] | None = None, count: str = "n", bins_per_range: int = 4, block: int = 1024
) -> DataFrame:
    """left with `count`: how many right rows of the same keys lie from before_s earlier to after_s later; and sums over them.

    What lies in a range is what lies up to its end less what lies before its start. Both ends of a left row and the right rows
    meet in bins, bins_per_range to a range; running sums inside a bin, over the bins of a block and over blocks add up. No pair is
    made, and neither a key with many rows nor the want of any key (keys = ()) puts rows into one task: only bins' and blocks'
    sums of one key meet. sums: whole or decimal expressions of the right side are exact; floating ones carry the
    rounding of a difference. row_key has to tell left rows apart. Rows with a null key or time count nothing.
    """
    low, high = int(before_s * _US), int(after_s * _US)
    width = max(1, (low + high) // bins_per_range)
    sums, names = sums or {}, [count, *(sums or {})]
    own = F.struct(*left.columns)
    ends = F.array(F.struct(F.lit(1).alias("sign"), (F.col("_t") + high).alias("at"), F.lit(2).alias("turn")), F.struct(F.lit(-1).alias("sign"), (F.col("_t") - low).alias("at"), F.lit(0).alias("turn")))
    a = left.withColumns({"_t": _micros(time), "_row": own}).withColumn("_end", F.explode(ends))
    zeros = {n: F.lit(0) for n in names}
    a = a.select(*keys, F.col("_row"), F.struct(*row_key).alias("_id"), F.col("_end.sign").alias("_sign"), F.col("_end.at").alias("_at"), F.col("_end.turn").alias("_turn"), *[v.alias(k) for k, v in zeros.items()])
    values = {count: F.lit(1).cast("long"), **{k: F.coalesce(v, F.lit(0)) for k, v in sums.items()}}
    b = right.select(*keys, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.lit(None).cast(a.schema["_id"].dataType).alias("_id"), F.lit(0).alias("_sign"), _micros(right_time).alias("_at"), F.lit(1).alias("_turn"), *[v.alias(k) for k, v in values.items()])
    b = reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, b.where(F.col("_at").isNotNull()))
    both = a.unionByName(b).withColumn("_bin", _bin(F.col("_at"), width)).withColumn("_block", F.floor(F.col("_bin") / block).cast("long"))

    def upto(by: Sequence[str], order: Sequence[str], last: int) -> Window:
        return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)

    def running(df: DataFrame, by: Sequence[str], order: Sequence[str], suffix: str) -> DataFrame:
        return df.withColumns({f"{n}{suffix}": F.coalesce(F.sum(n).over(upto(by, order, -1)), F.lit(0)) for n in names})

    bins = both.groupBy(*keys, "_block", "_bin").agg(*[F.sum(n).alias(n) for n in names])
    blocks = running(bins.groupBy(*keys, "_block").agg(*[F.sum(n).alias(n) for n in names]), keys, ["_block"], "_b").drop(*names)
    bins = running(bins, [*keys, "_block"], ["_bin"], "_a").drop(*names)
    inside = both.withColumns({n: F.sum(n).over(upto([*keys, "_bin"], ["_at", "_turn"], 0)) for n in names}).where("_sign <> 0")

    def joined(x: DataFrame, y: DataFrame, on: Sequence[str]) -> DataFrame:
        y = y.select(*[F.col(c).alias(f"_y_{c}") if c in on else F.col(c) for c in y.columns])
        return x.join(y, reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_y_{c}")) for c in on]), "left").drop(*[f"_y_{c}" for c in on])

    found = joined(joined(inside, bins, [*keys, "_block", "_bin"]), blocks, [*keys, "_block"])
    whole = [F.sum(F.col("_sign") * (F.col(n) + F.coalesce(f"{n}_a", F.lit(0)) + F.coalesce(f"{n}_b", F.lit(0)))).alias(n) for n in names]
    out = found.groupBy("_id").agg(F.any_value("_row").alias("_row"), *whole)
    missing = reduce(lambda p, q: p | q, [F.col(f"_row.{c}").isNull() for c in (*keys, time)])
    return out.select("_row.*", *[F.when(missing, F.lit(0)).otherwise(F.coalesce(n, F.lit(0))).alias(n) for n in names])
