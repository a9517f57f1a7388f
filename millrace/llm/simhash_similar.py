"""Near copies of whole texts: SimHash signatures under one-wildcard variants, verified by the likeness of word shingles.

The wide form of `simhash_dedup`. Two texts whose 5-word shingles have a Jaccard likeness of 0.8 differ in about 14 % of the
bits of a SimHash of those shingles, but in 7 % of one of their distinct words. So the signature is of words: `SEGMENTS`
segments of `BITS` bits. A pair is a candidate if a segment differs by at most one bit: each segment is indexed under its
one-wildcard variants and joined by equality. At 7 % that finds 93 of 100 pairs, at 6 % 97, at 4 % 99. Candidates at
more than `MAX_BITS` differing bits in all go; the shingles of the whole texts decide about the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._common import bounded, forget_all, mix64, slices, stored, text_bytes, window_hashes, word_hashes
from millrace.llm._graph import connected_components
from millrace.llm.simhash_dedup import majority_bits

SEGMENTS, BITS = 5, 28
#: Differing bits of all SEGMENTS * BITS at which a candidate is still looked at: 21 %, over five deviations beyond 7 %.
MAX_BITS = 30
_LANES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_LANE_SEGMENTS = 2
_SIM = ["w0", "w1", "w2"]


def normal(text: Column) -> Column:
    """A-Z lower-cased, words one space apart, none around; null is empty."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " "))


def signatures(texts: list[bytes]) -> list[np.ndarray]:
    """Per lane, the bits of each text's SimHash over its distinct words; 0 without words."""
    words, first = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(np.asarray(first, dtype=np.int64)))
    order = np.lexsort((words, doc))
    words, doc = words[order], doc[order]
    new = np.concatenate(([True], (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])))[: len(words)]
    words, counts = words[new], np.bincount(doc[new], minlength=len(texts))
    used = np.uint64((1 << (_LANE_SEGMENTS * BITS)) - 1)
    return [(majority_bits(mix64(words ^ lane), counts) & used).view(np.int64) for lane in _LANES]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Ascending hashes of the distinct `width`-word shingles of each text; of all its words if it has fewer."""
    words, first = word_hashes(texts)
    h, doc, _ = window_hashes(words, first, width)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    sets = []
    for i in range(len(texts)):
        if at[i] < at[i + 1]:
            sets.append(np.unique(h[at[i] : at[i + 1]]))
        else:
            whole = words[first[i] : first[i + 1]]
            sets.append(window_hashes(whole, [0, len(whole)], len(whole))[0] if len(whole) else np.zeros(1, dtype=np.uint64))
    return sets


def _alike(width: int, similarity: float):
    @F.arrow_udf("boolean")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        a, b = a.dictionary_encode(), b.dictionary_encode()
        sets_a, sets_b = (shingle_sets(text_bytes(pa.chunked_array([x.dictionary])), width) for x in (a, b))
        out = np.zeros(len(a), dtype=bool)
        for k, (i, j) in enumerate(zip(a.indices.to_pylist(), b.indices.to_pylist())):
            x, y = sets_a[i], sets_b[j]
            if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9:
                common = len(np.intersect1d(x, y, assume_unique=True))
                out[k] = common >= similarity * (len(x) + len(y) - common) - 1e-9
        return pa.array(out)

    return run


def _forest(width: int, similarity: float):
    """Spanning forest of the links between the texts of one tile of a hot bucket; texts of one root are linked already."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sets = shingle_sets(text_bytes(table["norm"]), width)
        sim = [table[w].to_numpy().view(np.uint64) for w in _SIM]
        node, side = table["node"].to_numpy(), table["side"].to_numpy()
        group = np.unique(table["root"].to_numpy(), return_inverse=True)[1]
        size = np.array([len(s) for s in sets])
        start = np.cumsum(size) - size
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        present = np.zeros(ids.max() + 1, dtype=bool)
        out = []
        for i in range(len(sets) - 1):
            rest = slice(i + 1, None)
            ask = (sum(np.bitwise_count(s[rest] ^ s[i]).astype(np.int64) for s in sim) <= MAX_BITS) & ((side[rest] | side[i]) == 3) & (group[rest] != group[i])
            ask &= np.minimum(size[rest], size[i]) >= similarity * np.maximum(size[rest], size[i]) - 1e-9
            if not ask.any():
                continue
            own = ids[start[i] : start[i] + size[i]]
            present[own] = True
            common = np.add.reduceat(present[ids[start[i + 1] :]], start[rest] - start[i + 1], dtype=np.int64)
            present[own] = False
            for j in (np.flatnonzero(ask & (common >= similarity * (size[rest] + size[i] - common) - 1e-9)) + i + 1).tolist():
                if group[j] != group[i]:
                    out.append((int(node[i]), int(node[j])))
                    group[group == group[j]] = group[i]
        return pa.table([[u for u, _ in out], [v for _, v in out]], schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return run


def _signed(texts: DataFrame) -> DataFrame:
    """(doc_id, node, w0, w1, w2) of rows (doc_id, node, norm)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "norm"):
                lanes = signatures(text_bytes(part["norm"]))
                yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), part["node"].combine_chunks(), *map(pa.array, lanes)], ["doc_id", "node", *_SIM])

    return bounded(texts).mapInArrow(run, "doc_id long, node long, w0 long, w1 long, w2 long")


def _buckets(nodes: DataFrame, scratch: list[str]) -> DataFrame:
    """(key, node, c) of keys that c > 1 nodes share; of keys with the same nodes one stays."""
    lane = f"case i div {_LANE_SEGMENTS * BITS} when 0 then w0 when 1 then w1 else w2 end"
    part = f"(shiftrightunsigned({lane}, cast({BITS} * ((i div {BITS}) % {_LANE_SEGMENTS}) as int)) & {(1 << BITS) - 1}L)"
    keyed = nodes.select("node", *_SIM, F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * BITS - 1))).alias("i"))
    keyed = keyed.select("node", F.expr(f"shiftleft(cast(i as bigint), 32) | ({part} & ~shiftleft(1L, i % {BITS}))").alias("key"))
    by_key = Window.partitionBy("key")
    shared = keyed.withColumn("c", F.count("*").over(by_key)).where("c > 1")
    shared = stored(shared, "variants", scratch)
    sums = [F.sum(F.expr(f"xxhash64(node, {k}) & {(1 << 40) - 1}L")).alias(f"s{k}") for k in (1, 2)]
    same = shared.groupBy("key", "c").agg(F.min("node").alias("least"), *sums)
    one = same.groupBy("c", "least", "s1", "s2").agg(F.min("key").alias("key")).select("key")
    return stored(shared.join(one.hint("merge"), "key"), "buckets", scratch)


def similar_links(nodes: DataFrame, texts: DataFrame, width: int, similarity: float, bucket_pairs: int, tile_bytes: int, scratch: list[str]) -> DataFrame:
    """Edges (u, v) between nodes of likeness `similarity` or more that share a variant; complete up to connectivity.

    nodes: (node, w0, w1, w2), texts: (node, norm) with repeats. Each bucket's texts are first compared with its smallest
    node; only buckets that this leaves in several components are compared pair by pair, and there only texts of
    different components. Buckets of more than `bucket_pairs` nodes go in tiles of two parts of some `tile_bytes` each.
    """
    by_key = Window.partitionBy("key")
    buckets = _buckets(nodes, scratch)
    wanted = texts.join(buckets.select("node").distinct().hint("merge"), "node", "left_semi")
    texts = stored(wanted.groupBy("node").agg(F.first("norm").alias("norm")).withColumn("size", F.octet_length("norm").cast("long") + 64), "texts", scratch)
    nodes = stored(nodes.join(texts.select("node", "size").hint("merge"), "node"), "signed", scratch)
    renamed = lambda df, end: df.toDF(*[end if x == "node" else f"{x}_{end}" for x in df.columns])
    distance = " + ".join(f"bit_count({w}_u ^ {w}_v)" for w in _SIM)

    def good(pairs: DataFrame) -> DataFrame:
        near = pairs.distinct().join(renamed(nodes, "u").hint("merge"), "u").join(renamed(nodes, "v").hint("merge"), "v").where(f"{distance} <= {MAX_BITS}").select("u", "v")
        near = near.join(renamed(texts, "u").hint("merge"), "u").join(renamed(texts, "v").hint("merge"), "v")
        return near.where(_alike(width, similarity)("norm_u", "norm_v")).select("u", "v")

    stars = good(buckets.select(F.min("node").over(by_key).alias("u"), F.col("node").alias("v")).where("u <> v"))
    stars = stored(stars, "stars", scratch)
    roots = connected_components(stars).withColumnRenamed("node", "member").withColumnRenamed("root", "of")
    left_over = buckets.join(roots.hint("merge"), F.col("node") == F.col("member"), "left").withColumn("root", F.coalesce("of", "node")).select("key", "node", "c", "root")
    left_over = left_over.withColumns({"low": F.min("root").over(by_key), "high": F.max("root").over(by_key)}).where("low <> high").drop("low", "high")
    left_over = stored(left_over, "open", scratch)
    few, many = left_over.where(F.col("c") <= bucket_pairs), left_over.where(F.col("c") > bucket_pairs)
    a, b = few.select("key", F.col("node").alias("u"), F.col("root").alias("root_u")), few.select("key", F.col("node").alias("v"), F.col("root").alias("root_v"))
    pairs = good(a.join(b.hint("merge"), "key").where("u < v and root_u <> root_v").select("u", "v"))
    weighed = many.join(nodes.hint("merge"), "node").withColumn("parts", F.ceil(F.sum("size").over(by_key) / tile_bytes).cast("int"))
    tiled = weighed.withColumn("p", F.expr("cast(pmod(xxhash64(node), parts) as int)")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("p") == F.col("q"), 3).when(F.col("p") < F.col("q"), 1).otherwise(2)
    tiled = tiled.select("node", "root", *_SIM, "key", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), side.alias("side"))
    hot = tiled.join(texts.select("node", "norm").hint("merge"), "node").groupBy("key", "x", "y").applyInArrow(_forest(width, similarity), "u long, v long")
    return stars.unionByName(pairs).unionByName(hot).distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, bucket_pairs: int = 32, tile_bytes: int = 4_000_000) -> DataFrame:
    """(doc_id, component_id) per row of docs: component_id is the smallest doc_id reachable over links.

    Texts are linked if their words, A-Z lower-cased, are the same, or if they share a variant and the Jaccard likeness of
    their distinct `width`-word shingles is `similarity` or more (a text of fewer words is one shingle). Null, empty and
    blank texts are copies of each other. Rows that repeat an id each get a row. A null id counts for no minimum; a
    component of null ids alone has component_id null. No rows give no rows. Other columns, whatever their names, are not
    read. A 64-bit hash stands for a text. Exact copies meet in one node by partial aggregation.
    """
    scratch: list[str] = []
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), normal(F.col(text_col)).alias("norm")).withColumn("node", F.xxhash64("norm"))
    own = stored(_signed(texts.select("doc_id", "node", "norm")), "signatures")
    nodes = stored(own.groupBy("node").agg(F.min("doc_id").alias("least_id"), *[F.first(w).alias(w) for w in _SIM]), "distinct", scratch)
    edges = similar_links(nodes.select("node", *_SIM), texts.select("node", "norm"), width, similarity, bucket_pairs, tile_bytes, scratch)
    roots = connected_components(edges)
    rooted = nodes.select("node", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = stored(rooted.join(least, "root").select("node", "component_id"), "classes")
    forget_all(docs.sparkSession, scratch)
    return own.join(classes.hint("merge"), "node").select("doc_id", "component_id")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the rows whose id isn't the smallest of its group; all columns stay. Groups of null ids alone stay."""
    found = similar_documents(docs, id_col, text_col, width, similarity)
    gone = found.where("doc_id <> component_id or (doc_id is null and component_id is not null)")
    gone = gone.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]), "left_anti")
