"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Documents are dealt into chunks that are consecutive ranges of ids. Each chunk sends every distinct window hash it has,
sorted and delta-coded, to the hash's bucket; a bucket tells each chunk which of its hashes an earlier chunk has too. An
earlier chunk has smaller ids only, so no ids travel with the hashes; repeats within a chunk are settled there. A hash
costs a bucket one entry per chunk at most, however many documents share it. Hashes have 64 bits: two different windows
among n collide with probability about n * n / 2^65 (1e-3 at 2e8 windows).
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import CHUNK_BYTES, bounded, chunk_of, id_chunks, slices, text_bytes, window_hashes, word_hashes

_LAST = np.iinfo(np.int64).max
_BLOB = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary())])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(_SPAN)), ("kept", pa.string())])


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Differences of ascending hashes, byte plane by byte plane: the high planes are zeros, which shuffles compress."""
    d = np.diff(sorted_hashes, prepend=np.uint64(0))
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(blob, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(d, dtype=np.uint64)


def _emit(width: int, bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = [np.unique(window_hashes(*word_hashes(text_bytes(part["text"])), width)[0]) for part in slices(table, "text")]
        h = np.unique(np.concatenate(found)) if found else np.array([], dtype=np.uint64)
        edges = np.searchsorted(h >> np.uint64(64 - bits), np.arange(2**bits + 1)) if bits else np.array([0, len(h)])
        rows = [(b, pack(h[x:y])) for b, (x, y) in enumerate(itertools.pairwise(edges)) if y > x]
        return pa.table([[b for b, _ in rows], [key[0].as_py()] * len(rows), [x for _, x in rows]], schema=_BLOB)

    return run


def _repeats(key: tuple, table: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk, the hashes that a smaller chunk has too."""
    table = table.sort_by("chunk")
    parts = [unpack(x) for x in table["hashes"].to_pylist()]
    chunks = np.repeat(table["chunk"].to_numpy(), [len(x) for x in parts])
    h = np.concatenate(parts)
    order = np.argsort(h, kind="stable")
    again = order[1:][h[order][1:] == h[order][:-1]]
    again = again[np.lexsort((h[again], chunks[again]))]
    ids, first = np.unique(chunks[again], return_index=True)
    blobs = [pack(x) for x in np.split(h[again], first[1:])] if len(ids) else []
    return pa.table([[key[0].as_py()] * len(ids), ids.astype(np.int32), blobs], schema=_BLOB)


def _cut(width: int):
    def run(key: tuple, docs: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _OUT.empty_table()
        earlier = np.sort(np.concatenate([np.array([], dtype=np.uint64), *(unpack(x) for x in verdicts["hashes"].to_pylist())]))
        parts = list(slices(docs, "text"))
        seen = []
        for part in parts:
            ids = part["doc_id"].fill_null(_LAST).to_numpy()
            words, first = word_hashes(text_bytes(part["text"]))
            h, doc, pos = window_hashes(words, first, width)
            seen.append((h, ids[doc], np.asarray(first)[doc] + pos, first))
        h, ids = np.concatenate([x[0] for x in seen]), np.concatenate([x[1] for x in seen])
        hit = np.zeros(len(h), dtype=bool)
        if len(h):
            order = np.lexsort((ids, h))
            start = np.concatenate(([True], h[order][1:] != h[order][:-1]))
            hit[order] = ids[order] > ids[order][start][np.cumsum(start) - 1]
        if len(earlier):
            at = np.minimum(np.searchsorted(earlier, h), len(earlier) - 1)
            hit |= earlier[at] == h
        out, done = [], 0
        for part, (own, _, where, first) in zip(parts, seen):
            mine = where[hit[done : done + len(own)]]
            done += len(own)
            n = first[-1]
            cover = np.cumsum(np.bincount(mine, minlength=n + width + 1) - np.bincount(mine + width, minlength=n + width + 1))[:n] > 0
            out.append(_rows(part, first, cover))
        return pa.concat_tables(out)

    return run


def _rows(part: pa.Table, first: list[int], cover: np.ndarray) -> pa.Table:
    counts = np.diff(first)
    removed = np.diff(np.concatenate(([0], np.cumsum(cover)))[first])
    kept, spans, offsets = [], [], [0]
    for i, text in enumerate(text_bytes(part["text"])):
        words = text.split()
        if removed[i]:
            own = cover[first[i] : first[i + 1]]
            words = list(itertools.compress(words, (~own).tolist()))
            edge = np.diff(np.concatenate(([0], own.astype(np.int8), [0])))
            spans += zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())
        offsets.append(len(spans))
        kept.append(b" ".join(words))
    pairs = pa.StructArray.from_arrays([pa.array([s for s, _ in spans], pa.int64()), pa.array([e for _, e in spans], pa.int64())], fields=list(_SPAN))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
    return pa.table([part["doc_id"].combine_chunks(), pa.array(counts), pa.array(removed), lists, pa.array(kept, pa.binary()).cast(pa.string())], schema=_OUT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, removed (maximal word intervals [start, end)), kept (words joined by a space).

    A word goes if a window of `width` words that covers it also starts in a row with a smaller id, judged on the input.
    Null and blank texts have no words; texts under `width` words have no window. Equal ids are not smaller, so repeated
    rows stay; a null id counts as larger than all others. No rows give no rows. Other columns are not read.
    """
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bounds = id_chunks(rows, "doc_id", "text", chunk_bytes)
    # Half as many buckets as chunks: hashes take about as many bytes as texts, and each blob holds the more of them.
    bits = max(0, math.ceil(math.log2(max(1, len(bounds) / 2))))
    chunked = rows.withColumn("chunk", chunk_of("doc_id", bounds))
    kind = "bucket int, chunk int, hashes binary"
    blobs = chunked.groupBy("chunk").applyInArrow(_emit(width, bits), kind)
    verdicts = blobs.groupBy("bucket").applyInArrow(_repeats, kind)
    both = chunked.groupBy("chunk").cogroup(verdicts.groupBy("chunk"))
    return both.applyInArrow(_cut(width), "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string")
