"""Hierarchical packing of token ids into sequences of several lengths.

A document is its ids and an end id. What goes beyond whole sequences of the longest tier is routed to the shortest tier that
holds it. Tiers are packed from the longest down: a document opens a window of its tier, and the gap behind it is filled with
the largest documents of shorter tiers that fit, by counts of equal sizes, so a slice's plan takes one step per distinct size,
not one per document. What is too short for any window of its own, and what must be taken apart to close the last gaps, forms a
stream that is cut to fit: first the gaps, then whole windows of all tiers. Less than the shortest tier is left of a slice; the
leftovers of many slices meet in a second round and make windows together, so only the last window of such a group is padded.

Slices are bounded by bytes of text and packed where they are tokenized. Step groups deal each tier's sequences in turn: every
group gets the same number of each tier's, give or take one, and so about the same tokens.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._common import bounded, give_back, slices, stored
from millrace.llm.encoder import Encoder

TIERS = (4096, 2048, 1024, 512, 256)
#: Text bytes that are tokenized and packed together.
PACK_BYTES = 8_000_000
#: Leftovers of about so many slices are packed together, each less than the shortest tier.
JOINED = 4096
#: Ids of a step group, about.
STEP_IDS = 1 << 20

_PIECE = pa.schema([
    ("slice", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("tier", pa.int32()), ("seq", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])
_PIECE_DDL = "slice long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, tier int, seq long, offset long, ids binary"


class _Windows:
    """Windows of one tier that hold documents of the same sizes: (size, first rank) of each, and the gap left."""

    def __init__(self, tier: int, n: int, held: list[tuple[int, int]], gap: int) -> None:
        self.tier, self.n, self.held, self.gap = tier, n, held, gap

    def split(self, k: int) -> _Windows:
        """The first k of them; the rest stays here."""
        out = _Windows(self.tier, k, list(self.held), self.gap)
        self.n, self.held = self.n - k, [(s, lo + k) for s, lo in self.held]
        return out


def fill_tiers(counts: np.ndarray, tiers: Sequence[int] = TIERS) -> tuple[list[_Windows], list[tuple[int, int, int]]]:
    """Plan for counts[s] documents of each size s: windows, and (size, first rank, number) of those left for the stream.

    The smallest tier's shortest documents are left; windows with gaps are dissolved, the shortest and emptiest first, until
    the stream suffices to close all the gaps that remain.
    """
    free, used = counts.astype(np.int64).copy(), np.zeros(len(counts), dtype=np.int64)
    free[0] = 0
    closed: list[_Windows] = []

    def take(size: int, n: int) -> int:
        first = int(used[size])
        used[size] += n
        free[size] -= n
        return first

    for tier in tiers:
        for size in (np.flatnonzero(free[tier // 2 + 1 : tier + 1]) + tier // 2 + 1)[::-1].tolist():
            n = int(free[size])
            waiting = [_Windows(tier, n, [(size, take(size, n))], tier - size)]
            while waiting:
                w = waiting.pop()
                fits = np.flatnonzero(free[: min(w.gap, tier // 2) + 1]) if w.gap else ()
                if not len(fits):
                    closed.append(w)
                    continue
                best = int(fits[-1])
                k = min(w.n, int(free[best]))
                part = w.split(k)
                part.held.append((best, take(best, k)))
                part.gap -= best
                waiting += [w, part] if w.n else [part]
    stream = [(int(s), int(used[s]), int(free[s])) for s in np.flatnonzero(free)[::-1]]
    have, need = sum(s * n for s, _, n in stream), sum(w.gap * w.n for w in closed)
    open_ = sorted((w for w in closed if w.gap), key=lambda w: (w.tier, -w.gap))
    kept = [w for w in closed if not w.gap]
    for w in open_:
        if have < need:
            k = min(w.n, math.ceil((need - have) / w.tier))  # one less to fill, and its ids come free
            gone = w.split(k)
            stream += [(s, lo, k) for s, lo in gone.held]
            have, need = have + k * (w.tier - w.gap), need - k * w.gap
        if w.n:
            kept.append(w)
    return kept, stream


def pack_items(sizes: np.ndarray, tiers: Sequence[int] = TIERS) -> tuple[np.ndarray, ...]:
    """Pieces of items of 1 to tiers[0] ids each: item, start in it, length, tier, number of the tier's sequence, offset.

    Tier 0 is what is left, less than the shortest tier.
    """
    order = np.argsort(sizes, kind="stable")
    counts = np.bincount(sizes, minlength=tiers[0] + 1)
    first = np.cumsum(counts) - counts
    kept, stream = fill_tiers(counts, tiers)
    made = {t: 0 for t in (*tiers, 0)}
    parts: list[list[np.ndarray]] = []
    goals: list[np.ndarray] = []  # tier, sequence, offset, room of each gap

    def column(x: int, n: int) -> np.ndarray:
        return np.full(n, x, dtype=np.int64)

    for w in kept:
        seq, at = made[w.tier] + np.arange(w.n), 0
        made[w.tier] += w.n
        for size, lo in w.held:
            parts.append([order[first[size] + lo : first[size] + lo + w.n], column(0, w.n), column(size, w.n), column(w.tier, w.n), seq, column(at, w.n)])
            at += size
        if w.gap:
            goals.append(np.stack([column(w.tier, w.n), seq, column(at, w.n), column(w.gap, w.n)]))
    items = np.concatenate([order[first[s] + lo : first[s] + lo + n] for s, lo, n in stream]) if stream else np.zeros(0, dtype=np.int64)
    left = int(sizes[items].sum()) - sum(int(g[3].sum()) for g in goals)
    for tier in (*tiers, 0):
        n = left // tier if tier else int(left > 0)
        if n:
            goals.append(np.stack([column(tier, n), made[tier] + np.arange(n), column(0, n), column(tier or left, n)]))
            made[tier] += n
            left -= n * (tier or left)
    if len(items):
        goal = np.concatenate(goals, axis=1)
        item_end, goal_end = np.cumsum(sizes[items]), np.cumsum(goal[3])
        edge = np.unique(np.concatenate(([0], item_end, goal_end)))
        at, length = edge[:-1], np.diff(edge)
        i, g = np.searchsorted(item_end, at, side="right"), np.searchsorted(goal_end, at, side="right")
        parts.append([items[i], at - (item_end - sizes[items])[i], length, goal[0][g], goal[1][g], goal[2][g] + at - (goal_end - goal[3])[g]])
    if not parts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    return tuple(np.concatenate([np.asarray(p[i], dtype=np.int64) for p in parts]) for i in range(6))


def _rows(slice_id: int, doc_ids: pa.Array, totals: np.ndarray, item_doc: np.ndarray, item_at: np.ndarray, item_from: np.ndarray, flat: np.ndarray, sizes: np.ndarray, tiers: Sequence[int], with_ids: bool, last: bool = False) -> pa.RecordBatch:
    """Piece rows of items: of document item_doc, from its id item_from on, which stand in flat from item_at on.

    last: nothing comes after, so what is left makes a sequence of the longest tier.
    """
    item, start, length, tier, seq, offset = pack_items(sizes, tiers)
    if last:
        rest = tier == 0
        seq = np.where(rest, (tier == tiers[0]).any() and seq[tier == tiers[0]].max() + 1, seq)
        tier = np.where(rest, tiers[0], tier)
    raw, at = memoryview(flat.astype("<u4").tobytes()), item_at[item] + start
    cut = [bytes(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
    doc = item_doc[item]
    held = [x if with_ids or not t else None for x, t in zip(cut, tier.tolist())]
    columns = [pa.array(np.full(len(item), slice_id)), doc_ids.take(pa.array(doc)), pa.array(item_from[item] + start), pa.array(length), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(totals[doc]), pa.array(tier.astype(np.int32)), pa.array(seq), pa.array(offset), pa.array(held, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, schema=_PIECE)


def _tokenize(path: str, end_id: int, tiers: Sequence[int], with_ids: bool):
    longest = tiers[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = Encoder.of(path), TaskContext.get().partitionId() << 32
        try:
            for batch in batches:
                for part in slices(batch, "text", PACK_BYTES):
                    flat, counts = encoder.encode(part["text"])
                    flat = np.insert(flat, np.cumsum(counts), np.uint32(end_id))
                    counts = counts + 1
                    at = np.cumsum(counts) - counts
                    n = -(-counts // longest)
                    doc = np.repeat(np.arange(len(counts)), n)
                    base = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * longest
                    sizes = np.minimum(longest, counts[doc] - base)
                    yield _rows(number, part["doc_id"].combine_chunks(), counts, doc, at[doc] + base, base, flat, sizes, tiers, with_ids)
                    number += 1
        finally:
            Encoder.release()
            give_back()

    return run


def _join_rest(tiers: Sequence[int], with_ids: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("slice", "ascending"), ("offset", "ascending")])
        flat = np.frombuffer(b"".join(table["ids"].to_pylist()), dtype="<u4")
        sizes, base = table["length"].to_numpy(), table["start"].to_numpy()
        one = np.arange(len(sizes))
        batch = _rows((1 << 62) + key[0].as_py(), table["doc_id"].combine_chunks(), table["doc_tokens"].to_numpy(), one, np.cumsum(sizes) - sizes, base, flat, sizes, tiers, with_ids, last=True)
        return pa.Table.from_batches([batch])

    return run


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, tiers: Sequence[int] = TIERS, step_ids: int = STEP_IDS, with_ids: bool = True
) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group[, ids]), one per piece.

    Piece [start, start + length) of a document's doc_tokens ids lies at `offset` of its sequence; sequences are numbered
    from 0, hold up to `tier` ids without gaps, and all but the last ones of second-round groups are full. tiers: powers of
    two, each half the one before. ids: little-endian unsigned 32-bit. Null texts are empty (the end id alone), rows without
    an id or with a repeated one are packed like others, no rows give no pieces. Which documents meet depends on how
    the table is read, as slices are packed where they are; every task writes its pieces once, so a lost executor
    changes nothing.
    """
    spark = docs.sparkSession
    tiers = tuple(tiers)
    if any(a != 2 * b for a, b in zip(tiers, tiers[1:])):
        raise ValueError("each tier has to be half the one before")
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = stored(rows.mapInArrow(_tokenize(tokenizer, end_id, tiers, with_ids), _PIECE_DDL), "pieces")
    rest = first.where("tier = 0").select("slice", "doc_id", "start", "length", "doc_tokens", "offset", "ids")
    sums = first.agg(F.sum("length").alias("ids"), F.count_distinct(F.when(F.col("tier") == 0, F.col("slice"))).alias("left")).first()
    groups = max(1, math.ceil((sums["left"] or 0) / JOINED))
    second = rest.groupBy(F.pmod(F.xxhash64("slice"), F.lit(groups)).alias("group")).applyInArrow(_join_rest(tiers, with_ids), _PIECE_DDL)
    pieces = first.where("tier > 0").unionByName(stored(second, "rest"))

    # Dense numbers: sequences of a tier are counted per slice, in blocks of slices, before any window runs.
    made = pieces.groupBy("slice", "tier").agg((F.max("seq") + 1).alias("n"))
    made = made.withColumn("block", F.shiftright("slice", 32))
    made = stored(made, "sequences")
    blocks = made.groupBy("tier", "block").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("tier").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("tier", "block").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("tier", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__blocks"))
    made = made.withColumn("__inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, ["tier", "block"])
    made = made.select("slice", "tier", (F.col("__inside") + F.col("__blocks")).alias("__before"))
    per_tier = {r["tier"]: r["n"] for r in pieces.groupBy("slice", "tier").agg((F.max("seq") + 1).alias("n")).groupBy("tier").agg(F.sum("n").alias("n")).collect()}
    below, start = {}, 0
    for tier in tiers:
        below[tier], start = start, start + per_tier.get(tier, 0)
    steps = max(1, round((sums["ids"] or 0) / step_ids))
    base = F.create_map(*[F.lit(x) for t in tiers for x in (t, below[t])])[F.col("tier")]
    number = F.col("seq") + F.col("__before")
    out = pieces.join(made, ["slice", "tier"])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return out.select(*names, (number + base).cast("long").alias("sequence_id"), "offset", "tier", (number % steps).cast("int").alias("step_group"), *(["ids"] if with_ids else []))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, tier, step_group, ids, pieces) of pack()'s rows: a sequence's ids and its pieces (doc_id, start, length, offset)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    out = pieces.groupBy("sequence_id", "tier", "step_group").agg(parts.alias("p"))
    # ids as hexadecimal text join without a Python worker
    ids = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    return out.select("sequence_id", "tier", "step_group", ids.alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("pieces"))
