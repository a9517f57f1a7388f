"""Document fingerprints by winnowing (Schleimer, Wilkerson, Aiken, 2003).

Every k-gram of code points gets a rolling hash; of every window of w consecutive hashes the smallest is selected, the
rightmost of equals, and its position is kept. Two texts that share a run of w + k - 1 code points share a selected hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import CHUNK_BYTES, bounded, chunk_of, id_chunks, mix64, powers

K, W = 14, 24
_TABLE_MULT = np.uint64(0x9E3779B97F4A7C15)
_PRINT = pa.list_(pa.struct([("hash", pa.int64()), ("position", pa.int32())]))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all k-grams; a shorter text is one gram, an empty one has none."""
    n = len(points)
    if n == 0:
        return np.array([], dtype=np.uint32)
    k = min(k, n)
    up, down = powers("word", n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(((points.astype(np.uint64) + np.uint64(1)) * _TABLE_MULT) * up[:n], out=prefix[1:])
    h = (prefix[k:] - prefix[: n - k + 1]) * down[: n - k + 1]
    return (mix64(h) >> np.uint64(32)).astype(np.uint32)


def winnow(points: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes and their positions, in order of position."""
    h = gram_hashes(points, k)
    m = len(h)
    if m == 0:
        return h, np.array([], dtype=np.int64)
    low = np.uint64(0xFFFFFFFF)
    key = (h.astype(np.uint64) << np.uint64(32)) | (low - np.arange(m, dtype=np.uint64))  # equal hashes: the last is least
    w = min(w, m)
    span, least = 1, key
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: m - w + 1], least[w - span :])
    keep = np.concatenate(([True], least[1:] != least[:-1]))
    position = (low - (least[keep] & low)).astype(np.int64)
    return h[position], position


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of selected hashes; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def longest_shared(a: np.ndarray, print_a: tuple[np.ndarray, np.ndarray], b: np.ndarray, print_b: tuple[np.ndarray, np.ndarray], k: int = K) -> int:
    """Code points of the longest run that both texts have around a gram selected in both, found from the positions.

    Grams of one hash at the same shift (place in b less place in a) lie in one run if no code point between them differs;
    of a hash that stands several times in a text its first place is taken. Runs of w + k - 1 code points are always met.
    """
    (hash_a, at_a), (hash_b, at_b) = print_a, print_b
    if not len(hash_a) or not len(hash_b):
        return 0
    hash_a, first_a = np.unique(hash_a, return_index=True)
    hash_b, first_b = np.unique(hash_b, return_index=True)
    _, i, j = np.intersect1d(hash_a, hash_b, assume_unique=True, return_indices=True)
    shifts, best = at_b[first_b[j]] - at_a[first_a[i]], 0
    for shift in np.unique(shifts).tolist() if len(shifts) else ():
        low, high = max(0, -shift), min(len(a), len(b) - shift)
        if high - low <= best:
            continue
        breaks = np.flatnonzero(a[low:high] != b[low + shift : high + shift]) + low
        own = at_a[first_a[i[shifts == shift]]]
        own = own[(own >= low) & (own < high)]
        edges = np.concatenate(([low - 1], breaks, [high]))
        right = np.searchsorted(edges, own, side="left")
        right = np.where(edges[np.minimum(right, len(edges) - 1)] == own, right + 1, right)
        run = edges[np.minimum(right, len(edges) - 1)] - edges[right - 1] - 1
        inside = ~np.isin(own, breaks)
        best = max(best, int(run[inside].max(initial=0)))
    return best


def as_text(hashes: np.ndarray) -> str:
    """The distinct selected hashes, ascending, 8 hexadecimal digits each."""
    return np.unique(hashes).astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, text_col: str = "text", as_col: str = "winnowed", k: int = K, w: int = W) -> DataFrame:
    """docs with `as_col` (replaced if there): the selected (hash, position) pairs; none for null and empty texts.

    Texts under k code points are one gram; texts of fewer than w grams are one window. All other columns pass through.
    """

    @F.arrow_udf("array<struct<hash:bigint,position:int>>")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            h, at = winnow(code_points(text or ""), k, w)
            rows.append([{"hash": x, "position": p} for x, p in zip(h.tolist(), at.tolist())])
        return pa.array(rows, _PRINT)

    return bounded(docs).withColumn(as_col, run(F.col(text_col).cast("string")))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>, edited_positions array<int>, longest_shared long"
_PLACES = pa.list_(pa.int32())
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("positions", _PLACES), ("edited_positions", _PLACES), ("longest_shared", pa.int64())])


def _compare(k: int, w: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        own = table["guest"].to_numpy() == 0
        ids = table["doc_id"].to_pylist()
        texts = [x or "" for x in table["text"].to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (not own[i], ids[i] is None, ids[i] or 0, texts[i]))
        rows: dict[str, list] = {name: [] for name in _SCHEMA.names}
        n_own = int(own.sum())
        after = _read(texts[order[0]], k, w) if n_own else None
        for at in range(n_own):
            i = order[at]
            text, (points, mine) = texts[i], after
            follows = texts[order[min(at + 1, len(order) - 1)]]
            after = _read(follows, k, w)
            cut = len(text) - len(text) // 4
            edited = text[:cut] + follows[: len(text) // 4]
            changed = np.concatenate((points[:cut], after[0][: len(text) // 4]))
            theirs = winnow(changed, k, w)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            values = (ids[i], len(text), digest, as_text(mine[0]), as_text(theirs[0]), likeness(mine[0], theirs[0]), likeness(mine[0], after[1][0]), mine[1].astype(np.int32), theirs[1].astype(np.int32), longest_shared(points, mine, changed, theirs, k))
            for name, value in zip(_SCHEMA.names, values):
                rows[name].append(value)
        return pa.table(rows, schema=_SCHEMA)

    return run


def _read(text: str, k: int, w: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    points = code_points(text)
    return points, winnow(points, k, w)


def edit_trial(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Each row's fingerprint against that of an edited text and that of the next row's text, in ascending order of ids.

    The edit replaces the last floor(n / 4) code points by the first as many (or all) of the next text; the last row is
    followed by the first. Null texts are empty; equal ids go by text; null ids come last. A single row follows itself.
    No rows give no rows. positions and edited_positions: where the selected grams begin; longest_shared: code points of the
    longest run that positions of one hash in both texts lead to. Rows are dealt into ranges of ids; the first row of each range goes to the range before as well.
    """
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.withColumn("chunk", chunk_of("doc_id", id_chunks(rows, "doc_id", "text", chunk_bytes)))
    # One id per range reaches the driver, the smallest that occurs there.
    lows = sorted(r["low"] for r in dealt.groupBy("chunk").agg(F.min("doc_id").alias("low")).where("low is not null").collect())
    n = max(1, len(lows))
    own = F.struct(F.lit(0).alias("guest"), F.col("chunk"))
    before = F.struct(F.lit(1).alias("guest"), ((F.col("chunk") + n - 1) % n).cast("int").alias("chunk"))
    bounds = np.array(lows, dtype=np.int64)

    @F.arrow_udf("boolean")
    def is_first(ids: pa.Array) -> pa.Array:
        if not len(bounds):
            return ids.is_null()
        known = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), bounds)
        return pa.array(known & ids.is_valid().to_numpy(zero_copy_only=False))

    places = F.when(F.col("first"), F.array(own, before)).otherwise(F.array(own))
    dealt = rows.withColumns({"chunk": chunk_of("doc_id", bounds), "first": is_first("doc_id")}).select("doc_id", "text", F.inline(places))
    return dealt.groupBy("chunk").applyInArrow(_compare(k, w), _OUT)
