"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014), as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.llm._common import forget_all, stored


def _marked(edges: DataFrame, scratch: list[str]) -> tuple[DataFrame, tuple]:
    """The edges, stored, with their number and a checksum of them, taken by the job that writes them."""
    seen = Observation()
    checksum = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    kept = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), checksum.alias("sum")), "edges", scratch)
    return kept, (seen.get["n"], seen.get["sum"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of `edges` (u, v: comparable ids); root is the smallest node reachable.

    Self loops, repeats and either direction are fine; no edges give no rows. Each round ends in a table in the shared
    folder and drops the one before; the driver sees one count and one checksum. A round takes two aggregations with partial sums and two
    joins, whose skewed side (a hub's neighbours) adaptive execution splits. Raises if max_rounds don't suffice.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    scratch: list[str] = []
    e, mark = _marked(e, scratch)
    for _ in range(max_rounds if mark[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        e = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = e.unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        old, before = mark, scratch.copy()
        scratch.clear()
        e, mark = _marked(e, scratch)
        forget_all(e.sparkSession, before)
        if mark == old:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
