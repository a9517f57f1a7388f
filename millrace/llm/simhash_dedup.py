"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments, the fewest for which two fingerprints at distance 2 have a segment
that differs by at most one bit. Each segment is indexed under its 32 one-wildcard variants; an equality join on
(segment, wildcard, masked value) finds candidates, and the whole distance verifies them. Buckets that hold more than
`bucket_pairs` distinct fingerprints are not paired up: their fingerprints go under the 65 keys {itself, itself with one
bit flipped}. Two fingerprints share such a key exactly if they differ in two bits or fewer, so linking each to the
smallest of its key loses no link and the work stays linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._common import bounded, forget_all, slices, stored, text_bytes
from millrace.llm._graph import connected_components

#: Byte value to eight byte-wide counters, lane k holding bit k.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], dtype=np.uint64)


def shingle_hashes(text: bytes, width: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each `width`-word shingle of the lower-cased text; of the whole sequence if it has fewer words."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 0x20)
    starts = np.concatenate(([0], gaps + 1))[: max(1, len(words) - width + 1)].tolist()
    ends = np.concatenate((gaps, [len(joined)]))[min(width, len(words)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], seed) for a, b in zip(starts, ends)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of consecutive groups of `counts` hashes: bits set in over half of the group; 0 for an empty group."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    parts = (n + 254) // 255  # byte counters hold 255
    part_first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    at = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(part_first, parts))
    for b in range(8):
        lanes = _SPREAD[(hashes >> np.uint64(8 * b)).astype(np.uint8)]
        sums = np.add.reduceat(lanes, at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        bits = 2 * np.add.reduceat(sums, part_first, axis=0) > n[:, None]
        for k in range(8):
            out[full] |= bits[:, k].astype(np.uint64) << np.uint64(8 * b + k)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint) per row; null and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes = [shingle_hashes(t) for t in text_bytes(part["text"])]
                counts = np.array([len(x) for x in hashes], dtype=np.int64)
                flat = np.fromiter((y for x in hashes for y in x), dtype=np.uint64, count=counts.sum())
                fp = majority_bits(flat, counts).view(np.int64)
                yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), pa.array(fp)], ["doc_id", "fp"])

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame, bucket_pairs: int = 32, scratch: list[str] | None = None) -> DataFrame:
    """Edges (u, v) between distinct fingerprints `fp` at 1 or 2 differing bits; complete up to connectivity."""
    seg = "(shiftrightunsigned(fp, 32 * (i div 32)) & 4294967295L)"
    keyed = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select(
        "fp", F.expr(f"shiftleft(cast(i as bigint), 32) | ({seg} & ~shiftleft(1L, i % 32))").alias("key")
    )
    sized = keyed.withColumn("c", F.count("*").over(Window.partitionBy("key"))).where("c > 1")
    sized = stored(sized, "variants", scratch)
    few = sized.where(F.col("c") <= bucket_pairs)
    a, b = few.select("key", F.col("fp").alias("u")), few.select("key", F.col("fp").alias("v"))
    pairs = a.join(b.hint("merge"), "key").where("u < v and bit_count(u ^ v) <= 2").select("u", "v")
    many = sized.where(F.col("c") > bucket_pairs).select("fp").distinct()
    ball = many.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i")).select(
        "fp", F.expr("case when i < 0 then fp else fp ^ shiftleft(1L, i) end").alias("key")
    )
    stars = ball.withColumn("least", F.min("fp").over(Window.partitionBy("key"))).where("fp <> least and bit_count(fp ^ least) <= 2")
    return pairs.unionByName(stars.select(F.col("least").alias("u"), F.col("fp").alias("v"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_pairs: int = 32) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs: component_id is the smallest doc_id reachable over links.

    Null or blank texts have fingerprint 0 and link like any other. Rows that repeat an id each get a row. A null id
    counts for no minimum; a component of null ids alone has component_id null. No rows give no rows. Other columns of
    docs, whatever their names, are not read. Exact copies meet in one fingerprint by partial aggregation before any
    shuffle of links; the join back splits hot fingerprints by adaptive execution.
    """
    scratch: list[str] = []
    own = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct", scratch)
    roots = connected_components(links(fps, bucket_pairs, scratch)).withColumnRenamed("node", "fp")
    rooted = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = stored(rooted.join(least, "root").select("fp", "component_id"), "classes")
    forget_all(docs.sparkSession, scratch)
    return own.join(classes.hint("merge"), "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id isn't the smallest of its group; all columns stay. Groups of null ids alone stay."""
    found = near_duplicates(docs, id_col, text_col)
    gone = found.where("doc_id <> component_id or (doc_id is null and component_id is not null)")
    gone = gone.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]), "left_anti")
