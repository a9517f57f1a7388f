"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each row's key is -ln(u) / w: u a uniform number from the MD5 of seed and id, w the document's quality weight. A source's
target is spent on complete epochs first; the rest goes to the rows with the smallest keys, by prefix sums of sizes.
Keys fall into bins of a logarithmic scale, 1/`buckets` wide: whatever the weights, the logarithm of an exponential key has
a density of at most 1/e, so no bin gets over 1/(e * buckets) of a source's rows. Sums per (source, bin) give each bin's
offset, running sums sort one bin at a time, and a source with a third of all rows spreads over thousands of bins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._common import stored

_SPACE = r"[\x20\x09-\x0D]+"
_EDGES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null counts 0."""
    edge = lambda c: F.coalesce(c.isin(*_EDGES), F.lit(False)).cast("int")
    n = F.size(F.split(text, _SPACE)) - edge(F.left(text, F.lit(1))) - edge(F.right(text, F.lit(1)))
    return F.when(text.isNull() | (text == ""), 0).otherwise(n).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sources (s, z, source_size) plus `target`: weights by rank of the name, nulls last, capped at most * source_size.

    The caps are met by filling to a common level: sorted by cap per weight, a source is full if the level that the
    sources not yet full would get reaches its cap. One row per source goes through the one unpartitioned window.
    """
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy("z", "s")))
    ranked = ranked.withColumn("w", F.get(cycle, (F.col("rank") - 1) % len(weights))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every, before = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    final = F.min(F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct(F.col("cap") / F.col("w"), "rank", "level"))).over(every)
    return level.withColumn("target", F.least("cap", F.coalesce(final["level"] * F.col("w"), F.col("cap")))).select("s", "z", "source_size", "target")


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    source_weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    buckets: int = 1000,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row of docs.

    quality: rows (id, weight) with positive weights, averaged per id; ids without one, or a null or non-positive one,
    weigh 1. A null or blank text has size 0 and is never taken in part; a null source is a source of its own, ranked
    last; rows without an id get their random number from the text. Repeated rows are drawn apart. Ties go by id, then size. A source of size 0
    has target 0. No rows give no rows. The row whose words cross the target is taken if that ends nearer to it. Reruns
    agree: all randomness comes from ids, or texts where those are null.
    """
    mixed = _mixed(docs, quality, id_col, text_col, source_col, source_weights, share, most, seed, buckets)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _keys(id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """What tells rows apart in a mix: id, source and a hash of the text, without an id also its MD5."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    salt = F.when(F.col(id_col).isNull(), F.md5(text.cast("binary"))).otherwise("")
    return {"doc_id": F.col(id_col).cast("long"), "source": F.col(source_col).cast("string"), "print": F.xxhash64(text), "salt": salt}


def _mixed(
    docs: DataFrame, quality: DataFrame | None, id_col: str, text_col: str, source_col: str, source_weights: Sequence[float], share: float, most: float, seed: str, buckets: int
) -> DataFrame:
    """mix() with what tells its rows apart."""
    rows = docs.select(*[c.alias(k) for k, c in _keys(id_col, text_col, source_col).items()], word_count(F.col(text_col)).alias("size"))
    rows = rows.withColumns({"s": F.coalesce("source", F.lit("")), "z": F.col("source").isNull()})
    rows = stored(rows, "sizes")
    if quality is not None:
        q_id, q_weight = quality.columns[:2]
        q = quality.select(F.col(q_id).cast("long").alias("q_id"), F.col(q_weight).cast("double").alias("q")).where("q > 0 and q_id is not null")
        q = q.groupBy("q_id").agg(F.avg("q").alias("q"))
        rows = rows.join(q, rows["doc_id"] == q["q_id"], "left").drop("q_id")
    else:
        rows = rows.withColumn("q", F.lit(1.0))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), "salt")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(2.0**52)
    rows = rows.withColumn("key", -F.log(u) / F.coalesce("q", F.lit(1.0)))
    rows = rows.withColumn("bin", F.floor(F.log(F.greatest("key", F.lit(1e-300))) * buckets).cast("int"))

    bins = rows.groupBy("s", "z", "bin").agg(F.sum("size").alias("bin_size"))
    bins = stored(bins, "bins")
    goal = targets(bins.groupBy("s", "z").agg(F.sum("bin_size").alias("source_size")), source_weights, share, most)
    before = Window.partitionBy("s", "z").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("s", "z", "bin", F.coalesce(F.sum("bin_size").over(before), F.lit(0)).alias("offset"))
    bins = bins.join(goal, ["s", "z"])

    inside = Window.partitionBy("s", "z", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("size").over(inside)).join(bins, ["s", "z", "bin"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - whole * F.col("source_size")
    part = ((F.col("size") > 0) & (F.col("offset") + F.col("run") - F.col("size") / 2 <= rest)).cast("int")
    rows = rows.withColumn("copies", (whole + part).cast("int"))
    return rows


def draw(
    docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", source_weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
    most: float = 2.0, seed: str = "mix", buckets: int = 1000,
) -> DataFrame:
    """The mixed rows themselves: each row of docs as often as mix() takes it, all columns kept.

    Of m rows alike in id, source and text that mix() takes C times in all, each is given C div m times, and C mod m of them
    once more: the words drawn are the words taken, whatever ids are null or repeat.
    """
    keys = _keys(id_col, text_col, source_col)
    plan = _mixed(docs, quality, id_col, text_col, source_col, source_weights, share, most, seed, buckets)
    plan = plan.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"), F.sum("copies").alias("__c")).where("__c > 0")
    plan = stored(plan.select(*[F.col(k).alias(f"__{k}") for k in keys], "__m", "__c"), "copies")
    uneven = (F.col("__m") > 1) & (F.col("__c") % F.col("__m") > 0)
    same = reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(f"__{k}")) for k, c in keys.items()])
    own = [docs[c] for c in docs.columns]

    def given(rows: DataFrame, times: Column) -> DataFrame:
        return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), times))).select(*own)

    whole = docs.join(plan.where(~uneven).hint("merge"), same)
    out = given(whole, (F.col("__c") / F.col("__m")).cast("int"))
    if plan.where(uneven).isEmpty():
        return out
    # Rows alike are counted per task, so that any number of them is ranked in parts.
    part = F.shiftright("__at", 33)
    alike = [F.col(f"__{k}") for k in keys]
    rest = stored(docs.join(plan.where(uneven).hint("merge"), same).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", part), "alike")
    ahead = Window.partitionBy(*alike).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rest.groupBy(*alike, "__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
    parts = parts.select(*[c.alias(f"_{c_name}") for c, c_name in zip(alike, [f"__{k}" for k in keys])], F.col("__part").alias("___part"), "__ahead")
    on = reduce(lambda a, b: a & b, [F.col(f"__{k}").eqNullSafe(F.col(f"___{k}")) for k in keys]) & (F.col("__part") == F.col("___part"))
    rank = F.row_number().over(Window.partitionBy(*alike, "__part").orderBy("__at")) + F.col("__ahead")
    rest = rest.join(parts, on).withColumn("__rank", rank)
    times = F.floor(F.col("__c") / F.col("__m")) + (F.col("__rank") <= F.col("__c") % F.col("__m")).cast("int")
    rest = rest.withColumn("__times", times.cast("int")).where("__times > 0")
    rest = rest.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
    return out.unionByName(rest)
