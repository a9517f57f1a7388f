"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence kept per group.

Fingerprints of 64 bits within `max_bits` of each other agree in at least two of max_bits + 2 blocks, so lines are joined
on the values of each pair of blocks. Candidate lines alone get their text back for the edit distance. Only distinct lines
take part; copies of a line share a hash. Each bucket's lines are first compared with its smallest; where that leaves
several components, lines of different components are compared pair by pair. Of more than `bucket_pairs` distinct lines
tasks compare tiles and return a spanning forest of the verified links, so no link is lost and no pairs pile up.

A fingerprint this near is rare among lines that are merely alike. With `bands`, lines are joined as well on MinHash keys:
band by band, the minima of three permutations of the line's byte n-grams (8 bytes, 4 in short lines), of which one equal
band is enough to make two lines candidates. These links need the edit similarity only.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from millrace.llm._common import _BYTE, bounded, forget_all, free_shuffles, mix64, rolling, slices, stored
from millrace.llm._graph import connected_components
from millrace.llm.encoder import offsets
from millrace.llm.simhash_dedup import majority_bits

#: ASCII marks and controls to spaces, A-Z to a-z, digits to 0; other bytes and newlines stay.
_NORMAL = np.array([b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b if b >= 128 or 97 <= b <= 122 or b == 10 else 32 for b in range(256)], dtype=np.uint8)
_PARSED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_lines", pa.int32()), ("lines", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64())), ("hash", pa.int64()), ("norm", pa.string()), ("size", pa.int32())])
_PARSED_DDL = "row long, doc_id long, n_lines int, lines array<int>, hashes array<long>, hash long, norm string, size int"
#: Keys on their way to their bucket: of a pair of blocks (the fingerprint holds the key), of a MinHash band.
_BLOCK = np.dtype([("sim", "<u8"), ("hash", "<u8"), ("size", "<u2")])
_BAND = np.dtype([("key", "<u4"), ("hash", "<u8"), ("size", "<u2")])
_BUCKETS = pa.schema([("key", pa.int64()), ("hash", pa.int64()), ("sim", pa.int64()), ("size", pa.int32()), ("c", pa.int32()), ("least", pa.int64()), ("star", pa.bool_())])
_BUCKETS_DDL = "key long, hash long, sim long, size int, c int, least long, star boolean"
#: Lines whose keys make up a part; n-grams and features that are worked on at once, so that they stay in a CPU's cache.
_PART_LINES, _CACHED = 40_000, 1 << 15
#: Sizes from here on aren't told apart in buckets.
_MAX_SIZE = 65535
#: Blocks' tags come first, then those of long lines' bands and of short lines' ones.
_TAGS = 48
#: Code points from which on strings are compared one pair at a time.
_LONG_ROWS = 1024
#: Pairs from which on they are compared a column at a time; 3-grams are counted in so many cells.
_MANY, _Q, _CELL_BITS = 200, 3, 10
#: Ends of lines: edits that a word of 64 rows rules out, words at most, symbols (code points modulo it), columns per row.
_END_EDITS, _END_WORDS, _SYMBOLS, _REACH = 74, 12, 59, 1.6
#: Pairs whose ends are compared at once, and from how many per word on that is worth it; pairs of a hot bucket that are looked at together.
_END_PAIRS, _FEW, _BLOCK_PAIRS = 2048, 32, 1 << 18
#: Text bytes that a task takes apart at once, and bytes of lines that it makes keys of.
_PART_BYTES, _LINE_BYTES = 1_000_000, 4_000_000
#: MinHash bands of a line for op4; permutations, each of which serves two bands; n-gram bytes of long and short lines.
BANDS, _PERMUTATIONS = 16, 24
_LONG_GRAM, _SHORT_GRAM = 8, 4
#: Code points up to which a line is short, and over which it is long; two lines that are 0.8 alike share a class.
_SHORT, _LONG = 60, 47
_ODD = np.random.Generator(np.random.PCG64(20240608)).integers(0, 2**32, _PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_GRAM, _GRAM32 = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x9E3779B1)
_TRIPLES = [(3 * i, 3 * i + 1, 3 * i + 2) for i in range(8)] + [(i, i + 8, i + 16) for i in range(8)]


def _cached(counts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of groups, and of their members, of about _CACHED members or one group."""
    ends = np.cumsum(counts)
    a = low = 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(ends, low + _CACHED, side="right")))
        yield a, b, low, int(ends[b - 1])
        a, low = b, int(ends[b - 1])


class Lines:
    """The lines with words of a slice of texts: distinct normalised lines, and where each line stands."""

    def __init__(self, texts: pa.ChunkedArray) -> None:
        data, edges = offsets(pc.fill_null(pa.concat_arrays(texts.chunks).cast(pa.string()), ""))
        t = _NORMAL[data]
        word = (t != 32) & (t != 10)
        before = np.concatenate(([False], word[:-1]))[: len(word)]
        before[edges[:-1][edges[:-1] < len(data)]] = False
        starts = np.flatnonzero(word & ~before)
        newlines = np.concatenate(([0], np.cumsum(t == 10)))
        text, line = np.searchsorted(edges, starts, side="right") - 1, newlines[starts]
        opens = np.concatenate(([True], (text[1:] != text[:-1]) | (line[1:] != line[:-1])))[: len(starts)]
        word[starts[~opens] - 1] = True  # one space between words of a line
        at = np.concatenate((np.cumsum(word)[starts[opens]] - 1, [word.sum()])).astype(np.int32)
        met = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(t[word])).dictionary_encode()
        #: Distinct lines; of each line its number there, its text and its number in the text; lines of each text.
        self.distinct, self.code = met.dictionary, met.indices.to_numpy()
        self.text = text[opens]
        self.number = line[opens] - newlines[edges[self.text]]
        self.per_text = np.where(np.diff(edges) > 0, newlines[edges[1:]] - newlines[edges[:-1]] + 1, 0)
        self.data, self.edges = offsets(self.distinct)

    @classmethod
    def of(cls, distinct: pa.Array) -> Lines:
        """Ready lines, without places."""
        own = cls.__new__(cls)
        own.distinct, (own.data, own.edges) = distinct, offsets(distinct)
        return own

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the distinct lines."""
        return rolling(_BYTE[self.data], self.edges[:-1], self.edges[1:], "byte")

    def fingerprints(self) -> np.ndarray:
        """SimHash of each distinct line; words, and pairs of neighbours, are the features."""
        if not len(self.distinct):
            return np.zeros(0, dtype=np.uint64)
        blank = self.data == 32
        before, after = np.concatenate(([True], blank[:-1])), np.concatenate((blank[1:], [True]))
        before[self.edges[:-1]], after[self.edges[1:] - 1] = True, True
        starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
        words = rolling(_BYTE[self.data], starts, ends, "byte")
        first = np.searchsorted(starts, self.edges)
        n, i = np.diff(first), np.arange(len(words))
        place = 2 * i - np.repeat(np.arange(len(n)), n)
        features = np.empty(2 * len(words) - len(n), dtype=np.uint64)
        features[place] = words
        inner = np.ones(len(words), dtype=bool)
        inner[first[1:] - 1] = False
        features[place[inner] + 1] = rolling(words, i[inner], i[inner] + 2, "word")
        n, out = 2 * n - 1, np.zeros(len(n), dtype=np.uint64)
        for a, b, low, high in _cached(n):
            out[a:b] = majority_bits(features[low:high], n[a:b])
        return out


def parsed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds, from one pass over the texts.

    Per row of docs (row, doc_id, n_lines, lines, hashes): numbers and hashes of its lines that have words. Without row:
    (hash, norm, size) of each line that a task meets for the first time, size in code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, seen = TaskContext.get().partitionId() << 40, 0, np.zeros(0, dtype=np.uint64)

        def rows(**columns: pa.Array) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _PARSED], schema=_PARSED)

        for batch in batches:
            for part in slices(batch, "text", _PART_BYTES):
                own = Lines(part["text"])
                hashes = own.hashes()
                at = pa.array(np.searchsorted(own.text, np.arange(part.num_rows + 1)).astype(np.int32))
                lines = pa.ListArray.from_arrays(at, pa.array(own.number.astype(np.int32)))
                of_lines = pa.ListArray.from_arrays(at, pa.array(hashes.view(np.int64)[own.code]))
                yield rows(row=pa.array(task + count + np.arange(part.num_rows)), doc_id=part["doc_id"].combine_chunks(), n_lines=pa.array(own.per_text.astype(np.int32)), lines=lines, hashes=of_lines)
                count += part.num_rows
                at = np.searchsorted(seen, hashes)
                new = np.flatnonzero(np.append(seen, np.uint64(0))[at] != hashes) if len(seen) else np.arange(len(hashes))
                if len(new):
                    seen = np.sort(np.concatenate((seen, hashes[new])))
                    norm = own.distinct.take(pa.array(new))
                    yield rows(hash=pa.array(hashes[new].view(np.int64)), norm=norm, size=pc.utf8_length(norm))

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _PARSED_DDL)


def block_keys(sim: np.ndarray, blocks: int, only: int | None = None) -> np.ndarray:
    """Keys of all pairs of blocks of each fingerprint, or of one pair only, one column per pair."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    part = [(sim >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in itertools.pairwise(cut)]
    pairs = itertools.combinations(range(blocks), 2)
    return np.stack([np.uint64(n << 58) | (part[i] << np.uint64(cut[j + 1] - cut[j])) | part[j] for n, (i, j) in enumerate(pairs) if only in (None, n)], axis=1)


def band_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gram: int, bands: int) -> np.ndarray:
    """MinHash keys of the lines data[s:e], one column per band; a line shorter than an n-gram is one n-gram."""
    count = np.maximum(ends - starts - gram + 1, 1)
    first = np.cumsum(count) - count
    at = np.repeat(starts - first, count) + np.arange(count.sum())
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    grams = np.ndarray(len(data), dtype=f"<u{gram}", buffer=padded, strides=(1,))[at].astype(np.uint64)
    short = np.flatnonzero(ends - starts < gram)
    grams[first[short]] &= (np.uint64(1) << (8 * (ends - starts)[short]).astype(np.uint64)) - np.uint64(1)
    grams = (mix64(grams * _GRAM) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((_PERMUTATIONS, len(starts)), dtype=np.uint64)
    for a, b, low, high in _cached(count):
        for k, odd in enumerate(_ODD):
            least[k, a:b] = np.minimum.reduceat(grams[low:high] * odd, first[a:b] - low)
    return np.stack([mix64(mix64((least[i] << np.uint64(32)) | least[j]) + least[k]) for i, j, k in _TRIPLES[:bands]], axis=1)


def _parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def packed_keys(own: Lines, hashes: np.ndarray, size: np.ndarray, max_bits: int, bands: int, parts: int) -> pa.RecordBatch:
    """(part, counts, blocks, bands): the lines' keys for each part, in order of their tags; counts holds keys by tag.

    A part holds whole buckets. Keys travel as bytes: one of a pair of blocks is its line's fingerprint, one of a band 32
    bits. Tag and part are the rest of a band's key; what lines meet by chance in it the edit similarity tells apart.
    """
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # tag, part, row
    few = np.minimum(size, _MAX_SIZE)
    sim = own.fingerprints()
    keys = block_keys(sim, max_bits + 2)
    rows = np.empty(keys.size, dtype=_BLOCK)
    n = keys.shape[1]
    rows["sim"], rows["hash"], rows["size"] = np.tile(sim, n), np.tile(hashes, n), np.tile(few, n)
    blocks = [(np.repeat(np.arange(n), len(hashes)), _parts_of(mix64(keys.T.ravel()), parts), rows)]
    for tag, gram, which in ((16, _LONG_GRAM, np.flatnonzero(size > _LONG)), (32, _SHORT_GRAM, np.flatnonzero(size <= _SHORT))) if bands else ():
        if len(which):
            keys = band_keys(own.data, own.edges[which], own.edges[which + 1], gram, bands)
            rows = np.empty(keys.size, dtype=_BAND)
            flat = keys.T.ravel()
            rows["key"], rows["hash"], rows["size"] = flat.astype(np.uint32), np.tile(hashes[which], bands), np.tile(few[which], bands)
            made.append((np.repeat(np.arange(tag, tag + bands), len(which)), _parts_of(flat, parts), rows))
    counts, columns = np.zeros((parts, _TAGS), dtype=np.int64), []
    for kind, dtype in ((blocks, _BLOCK), (made, _BAND)):
        tag, part = (np.concatenate([np.zeros(0, dtype=np.int64), *(x[i] for x in kind)]) for i in (0, 1))
        rows = np.concatenate([np.zeros(0, dtype=dtype), *(x[2] for x in kind)])
        rows = rows[np.argsort(part.astype(np.uint16), kind="stable")]
        counts += np.bincount(part * _TAGS + tag, minlength=parts * _TAGS).reshape(parts, _TAGS)
        edges = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts)))) * dtype.itemsize
        columns.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), parts, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(rows.tobytes())]).cast(pa.binary()))
    count = pa.ListArray.from_arrays(pa.array(np.arange(parts + 1, dtype=np.int32) * _TAGS), pa.array(counts.ravel().astype(np.int32)))
    out = pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), count, *columns], ["part", "counts", "blocks", "bands"])
    return out.filter(pa.array(counts.any(axis=1)))


def keyed_lines(texts: DataFrame, max_bits: int, bands: int, parts: int) -> DataFrame:
    """packed_keys() of the lines (hash, norm, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "norm", _LINE_BYTES):
                own = Lines.of(pa.concat_arrays(part["norm"].chunks).cast(pa.string()))
                yield packed_keys(own, part["hash"].to_numpy().view(np.uint64), part["size"].to_numpy().astype(np.int64), max_bits, bands, parts)

    return bounded(texts).mapInArrow(run, "part int, counts array<int>, blocks binary, bands binary")


def _buckets(max_bits: int, similarity: float):
    """Lines of the buckets of one part that hold several lines.

    star: another than the bucket's smallest, which its fingerprint and size let be alike to that one.
    """

    def run(group: tuple, table: pa.Table) -> pa.Table:
        counts = table["counts"].combine_chunks().flatten().to_numpy().reshape(-1, _TAGS)
        block = np.frombuffer(b"".join(table["blocks"].to_pylist()), dtype=_BLOCK)
        band = np.frombuffer(b"".join(table["bands"].to_pylist()), dtype=_BAND)
        tag = np.repeat(np.tile(np.arange(16), len(counts)), counts[:, :16].ravel())
        key = np.empty(len(block) + len(band), dtype=np.uint64)
        for i in np.unique(tag).tolist():
            own = np.flatnonzero(tag == i)
            key[own] = block_keys(block["sim"][own], max_bits + 2, i)[:, 0]
        tag = np.repeat(np.tile(np.arange(16, _TAGS), len(counts)), counts[:, 16:].ravel()).astype(np.uint64)
        # Within the part 32 bits suffice; beyond it the part tells equal ones apart.
        key[len(block) :] = (tag << np.uint64(58)) | (np.uint64(group[0].as_py()) << np.uint64(32)) | band["key"]
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        order = order[np.append(same, False) | np.append(False, same)]
        key = key[order]
        hashes, size = (np.concatenate((block[x], band[x]))[order] for x in ("hash", "size"))
        sim = np.concatenate((block["sim"], np.zeros(len(band), dtype=np.uint64)))[order]
        hashes = hashes.view(np.int64)
        order = np.lexsort((hashes, key))
        key, hashes, size, sim = key[order], hashes[order], size[order].astype(np.int64), sim[order]
        once = np.append(True, (key[1:] != key[:-1]) | (hashes[1:] != hashes[:-1]))[: len(key)]
        key, hashes, size, sim = key[once], hashes[once], size[once], sim[once]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        c = np.diff(np.append(first, len(key)))
        least, c = np.repeat(first, c), np.repeat(c, c)
        most = np.maximum(size, size[least])
        star = (hashes != hashes[least]) & (np.bitwise_count(sim ^ sim[least]) <= max_bits)
        star &= (np.abs(size - size[least]) <= (1 - similarity) * most + 1e-9) | (most >= _MAX_SIZE)
        many = c > 1
        columns = [key.view(np.int64), hashes, sim.view(np.int64), size.astype(np.int32), c.astype(np.int32), hashes[least], star]
        return pa.table([pa.array(x[many]) for x in columns], schema=_BUCKETS)

    return run


@lru_cache(maxsize=64)
def _places(a: str) -> dict[str, int]:
    """Of each code point the bits of its places."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    return at


def _in_common(a: str, b: str, least: float) -> bool:
    """Whether the longest common subsequence has `least` code points or more, bit-parallel (Hyyro, 2004)."""
    at, n = _places(a), len(a)
    full = free = (1 << n) - 1
    left = len(b)
    for start in range(0, left, 32):
        for c in b[start : start + 32]:
            met = free & at.get(c, 0)
            free = (free + met) | (free - met)
        free &= full
        if n - free.bit_count() + max(left - start - 32, 0) < least:
            return False
    return n - free.bit_count() >= least


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel (Myers, 1999)."""
    if not a or not b:
        return len(a) + len(b)
    at = _places(a)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (full & ~(xh | up)), up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ((ph << 1) | 1) & full, (mh << 1) & full
        up, down = mh | (full & ~(xv | ph)), ph & xv
    return score


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """edit_distance() of many pairs at once: words of 64 rows, all pairs a column at a time (Hyyro, 2003)."""
    out = np.zeros(len(a), dtype=np.int64)
    short = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    size = np.array([(len(x), len(y)) for x, y in short], dtype=np.int64).reshape(-1, 2)
    out[size[:, 0] == 0] = size[size[:, 0] == 0, 1]
    for i in np.flatnonzero(size[:, 0] > _LONG_ROWS).tolist():
        out[i] = edit_distance(*short[i])
    rest = np.flatnonzero((size[:, 0] > 0) & (size[:, 0] <= _LONG_ROWS))
    rest = rest[np.argsort(-size[rest, 1], kind="stable")]
    at = 0
    while at < len(rest):
        n = max(1, min(512, 1_000_000 // int(size[rest[at], 1])))
        own = rest[at : at + n]
        out[own] = _columns([short[i] for i in own.tolist()], size[own, 0], size[own, 1])
        at += n
    return out


def _columns(pairs: list[tuple[str, str]], m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Distances of pairs in descending order of n, the lengths of the second strings; m, of the first, at least 1."""
    points = [np.frombuffer("".join(x[side] for x in pairs).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for side in (0, 1)]
    alphabet, codes = np.unique(np.concatenate(points), return_inverse=True)
    first, second = codes[: len(points[0])], codes[len(points[0]) :]
    words, rows = int(m.max() - 1) // 64 + 1, np.arange(len(pairs))
    one = np.uint64(1)
    places = np.arange(len(first)) - np.repeat(np.cumsum(m) - m, m)
    peq = np.zeros((words, len(pairs) * len(alphabet)), dtype=np.uint64)
    np.bitwise_or.at(peq, (places // 64, np.repeat(rows, m) * len(alphabet) + first), one << (places % 64).astype(np.uint64))
    up = np.full((words, len(pairs)), ~np.uint64(0))
    down = np.zeros((words, len(pairs)), dtype=np.uint64)
    score, top, bit = m.copy(), (m - 1) // 64, ((m - 1) % 64).astype(np.uint64)
    begins, alive = np.cumsum(n) - n, np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")
    for j in range(n[0]):
        k = alive[j]
        char = rows[:k] * len(alphabet) + second[begins[:k] + j]
        plus, minus = np.ones(k, dtype=np.uint64), np.zeros(k, dtype=np.uint64)  # from the row above: its value is j
        for w in range(words):
            pv, mv, eq = up[w, :k], down[w, :k], peq[w][char]
            xv = eq | mv
            eq = eq | minus
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            here = top[:k] == w
            if here.any():
                score[:k] += np.where(here, ((ph >> bit[:k]) & one).astype(np.int64) - ((mh >> bit[:k]) & one).astype(np.int64), 0)
            next_plus, next_minus = ph >> np.uint64(63), mh >> np.uint64(63)
            ph, mh = (ph << one) | plus, (mh << one) | minus
            up[w, :k], down[w, :k] = mh | ~(xv | ph), ph & xv
            plus, minus = next_plus, next_minus
    return score


def gram_counts(lines: list[str], bits: int = _CELL_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of 3-grams of code points by hash cell, 255 at most, and which lines have a cell beyond that."""
    cells_of = 1 << bits
    size = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    first = np.cumsum(size) - size
    count = np.maximum(size - _Q + 1, 0)
    at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    h = points[at]
    for k in range(1, _Q):
        h = (h * _GRAM32) ^ points[at + k]
    cell = ((h * _GRAM32) >> np.uint32(32 - bits)).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(count)))
    counts, full = np.empty((len(lines), cells_of), dtype=np.uint8), np.zeros(len(lines), dtype=bool)
    step = (1 << 15) // cells_of  # counters that stay in a CPU's cache
    for i in range(0, len(lines), step):
        n = len(counts[i : i + step])
        low, high = ends[i], ends[i + n]
        own = np.bincount(cell[low:high] + np.repeat(np.arange(n) * cells_of, count[i : i + n]), minlength=n * cells_of).reshape(n, cells_of)
        if count[i : i + n].max() > 255:
            full[i : i + n] = own.max(axis=1) > 255
            own = np.minimum(own, 255)
        counts[i : i + n] = own
    return counts, full


def least_common(size_a: np.ndarray, size_b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """3-grams that strings of these sizes have in common at the least if `most` edits lead from one to the other."""
    return np.maximum(size_a, size_b) - _Q + 1 - _Q * np.floor(most).astype(np.int64)


def _bound(a: str, b: str, most: float) -> int:
    """The edit distance or more, near it for texts that differ in few places; anything over `most` where it gives up.

    The texts are followed side by side. Where they differ, the next 8 code points of the first that follow in the second
    within reach go on, and what stands before them counts as edited.
    """
    x, y = (int.from_bytes(t.encode("utf-32-le", "surrogatepass"), "little") for t in (a, b))
    i = j = cost = 0
    while differs := x ^ y:
        same = ((differs & -differs).bit_length() - 1) >> 5
        i, j = i + same, j + same
        left = cost + max(len(a) - i, len(b) - j)
        if left <= most or i >= len(a) or j >= len(b):
            return left
        for skip in range(0, 48, 3):
            gram = a[i + skip : i + skip + 8]
            at = b.find(gram, j, j + skip + 40) if len(gram) == 8 else -1
            if at >= 0:
                break
        else:
            return left
        while skip and at > j and a[i + skip - 1] == b[at - 1]:
            skip, at = skip - 1, at - 1
        cost += max(skip, at - j)
        if cost > most:
            return cost
        x, y = x >> (32 * (same + skip)), y >> (32 * (same + at - j))
        i, j = i + skip, at
    return cost


def _close(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the edit distances are `most` at most. Long or few pairs go one by one: columns of few rows aren't worth it."""
    # Code points that aren't in common are edited.
    ask = [i for i, m in enumerate(most.tolist()) if _in_common(b[i], a[i], max(len(a[i]), len(b[i])) - m)]
    out = np.zeros(len(a), dtype=bool)
    short = [i for i in ask if min(len(a[i]), len(b[i])) <= 64]
    if len(short) >= _MANY:
        out[short] = edit_distances([a[i] for i in short], [b[i] for i in short]) <= most[short]
        ask = [i for i in ask if min(len(a[i]), len(b[i])) > 64]
    for i in ask:
        x, y = a[i], b[i]
        start = len(commonprefix((x, y)))
        x, y = x[start:], y[start:]
        end = len(commonprefix((x[::-1], y[::-1])))
        x, y = x[: len(x) - end], y[: len(y) - end]
        out[i] = max(len(x), len(y)) <= most[i] or edit_distance(x, y) <= most[i]
    return out


def _end_codes(lines: list[str], columns: int) -> np.ndarray:
    """Symbols of the first code points of each line, then of its last ones, backwards; a column per line and end.

    Beyond the line stands a symbol that no pattern has.
    """
    ends = [x[:columns] for x in lines] + [x[: -columns - 1 : -1] for x in lines]
    size = np.fromiter(map(len, ends), dtype=np.int64, count=len(ends))
    points = np.frombuffer("".join(x.ljust(columns) for x in ends).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = (points % np.uint32(_SYMBOLS)).astype(np.uint8).reshape(len(ends), columns).T
    return np.where(np.arange(columns)[:, None] < size, codes, np.uint8(_SYMBOLS)).astype(np.intp)


def end_bounds(lines: list[str], i: np.ndarray, j: np.ndarray, words: int) -> np.ndarray:
    """A lower bound of the edit distances between lines i and lines j, from 64 * words code points of either end of i.

    Its first and last code points (half of a shorter line each) take part in separate edits, each those to the nearest of all
    beginnings or ends of j. Bit-parallel, all pairs a column at a time; code points that share a symbol count as equal.
    """
    rows = 64 * words
    columns = int(_REACH * rows)
    (left, i), (right, j) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
    patterns, texts = [lines[k] for k in left.tolist()], _end_codes([lines[k] for k in right.tolist()], columns)
    codes, one = _end_codes(patterns, rows), np.uint64(1)
    base = np.arange(codes.shape[1]) * (_SYMBOLS + 1)
    peq = np.zeros((words, len(base) * (_SYMBOLS + 1)), dtype=np.uint64)
    for k in range(rows):
        peq[k // 64][base + codes[k]] |= one << np.uint64(k % 64)
    length = np.minimum(rows, np.fromiter(map(len, patterns), dtype=np.int64, count=len(patterns)) // 2)
    length = np.tile(length[i], 2)
    base, text = base[np.concatenate((i, i + len(left)))], np.concatenate((j, j + len(right)))
    bit, score, best = ((length - 1) % 64).astype(np.uint64), length.copy(), length.copy()
    up = [np.full(len(base), ~np.uint64(0)) for _ in range(words)]
    down = [np.zeros(len(base), dtype=np.uint64) for _ in range(words)]
    for column in texts:
        at = column.take(text)
        at += base
        plus, minus = one, None
        for w in range(words):
            eq, pv, mv = peq[w].take(at), up[w], down[w]
            xv = eq | mv
            if minus is not None:
                eq |= minus
            mh = eq & pv
            mh += pv
            mh ^= pv
            mh |= eq
            ph = mh | pv
            np.invert(ph, out=ph)
            ph |= mv
            mh &= pv
            if w == words - 1:
                score += ((ph >> bit) & one).view(np.int64)
                score -= ((mh >> bit) & one).view(np.int64)
                next_plus = next_minus = None
            else:
                next_plus, next_minus = ph >> np.uint64(63), mh >> np.uint64(63)
            ph <<= one
            ph |= plus
            mh <<= one
            if minus is not None:
                mh |= minus
            down[w] = ph & xv
            xv |= ph
            np.invert(xv, out=xv)
            xv |= mh
            up[w], plus, minus = xv, next_plus, next_minus
        np.minimum(best, score, out=best)
    # Beginnings beyond the columns are longer than the pattern by more than that.
    best = np.minimum(best, columns + 1 - length)
    best[length <= rows - 64] = 0  # their last row stands in another word
    return best[: len(i)] + best[len(i) :]


def _near_ends(lines: list[str], i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs of lines their ends let be `most` edits apart: of unlike lines the ends alone take more."""
    out = np.ones(len(i), dtype=bool)
    words = np.maximum(1, np.ceil(most / _END_EDITS)).astype(np.int64)
    for w in np.unique(words[words <= _END_WORDS]).tolist():
        own = np.flatnonzero(words == w)
        for at in range(0, len(own), _END_PAIRS):
            part = own[at : at + _END_PAIRS]
            if len(part) >= _FEW * w:
                out[part] = end_bounds(lines, i[part], j[part], w) <= most[part]
    return out


def _within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the edit distances are `most` at most; an edit changes three 3-grams at most."""
    out = np.fromiter((_bound(x, y, m) <= m for x, y, m in zip(a, b, most.tolist())), dtype=bool, count=len(a))
    ask = np.flatnonzero(~out)
    size = np.array([(len(x), len(y)) for x, y in zip(a, b)], dtype=np.int64).reshape(-1, 2)
    for bits in (_CELL_BITS - 3, _CELL_BITS):  # few cells do for most
        need, keep = least_common(size[ask, 0], size[ask, 1], most[ask]), []
        for at in range(0, len(ask), 1000):
            own, least = ask[at : at + 1000], need[at : at + 1000]
            (x, full_x), (y, full_y) = (gram_counts([side[i] for i in own.tolist()], bits) for side in (a, b))
            common = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            keep.append(own[(common >= least) | full_x | full_y])
        ask = np.concatenate(keep) if keep else ask
    if len(ask):
        out[ask] = _close([a[i] for i in ask.tolist()], [b[i] for i in ask.tolist()], most[ask])
    return out


def alike(a: list[str], b: list[str], similarity: float) -> np.ndarray:
    """Whether the edit similarity of each pair is `similarity` or more.

    Pairs whose lengths, ends or common 3-grams rule it out aren't compared further.
    """
    size = np.array([(len(x), len(y)) for x, y in zip(a, b)], dtype=np.int64).reshape(-1, 2)
    most = (1 - similarity) * size.max(axis=1, initial=0) + 1e-9
    out = size.max(axis=1, initial=0) <= most
    ask = np.flatnonzero(~out & (np.abs(size[:, 0] - size[:, 1]) <= most))
    ask = ask[_near_ends([*a, *b], ask, len(a) + ask, most[ask])]
    out[ask] = _within([a[i] for i in ask.tolist()], [b[i] for i in ask.tolist()], most[ask])
    return out


def _verified(similarity: float):
    @F.arrow_udf("boolean")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(alike(a.to_pylist(), b.to_pylist(), similarity))

    return run


def _forest(max_bits: int, similarity: float):
    """Spanning forest of the verified links between the lines of one tile of a hot bucket; lines of one root are linked already."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sim = table["sim"].to_numpy().view(np.uint64)
        hashes, norm, side = table["hash"].to_numpy(), table["norm"].to_pylist(), table["side"].to_numpy()
        group = np.unique(table["root"].to_numpy(), return_inverse=True)[1]
        size = np.fromiter(map(len, norm), dtype=np.int64, count=len(norm))
        out, step = [], max(1, _BLOCK_PAIRS // max(1, len(sim)))
        for low in range(0, len(sim), step):
            own = slice(low, low + step)
            ask = (np.bitwise_count(sim[own, None] ^ sim[low:]) <= max_bits) & ((side[own, None] | side[low:]) == 3) & (group[own, None] != group[low:])
            i, j = np.nonzero(np.triu(ask & (np.abs(size[own, None] - size[low:]) <= (1 - similarity) * np.maximum(size[own, None], size[low:]) + 1e-9), 1))
            i, j = i + low, j + low
            most = (1 - similarity) * np.maximum(size[i], size[j]) + 1e-9
            near = _near_ends(norm, i, j, most)
            i, j, most = i[near], j[near], most[near]
            # One pair of lines of two groups at a time, until none of them is left.
            while len(i):
                first = np.unique(group[i] * len(sim) + group[j], return_index=True)[1]
                good = _within([norm[x] for x in i[first].tolist()], [norm[x] for x in j[first].tolist()], most[first])
                for x, y in zip(i[first[good]].tolist(), j[first[good]].tolist()):
                    if group[x] != group[y]:
                        out.append((int(hashes[x]), int(hashes[y])))
                        group[group == group[y]] = group[x]
                rest = group[i] != group[j]
                rest[first] = False
                i, j, most = i[rest], j[rest], most[rest]
        return pa.table([[u for u, _ in out], [v for _, v in out]], schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return run


def links(texts: DataFrame, lines: int, max_bits: int, similarity: float, bucket_pairs: int, tile: int, bands: int = 0, scratch: list[str] | None = None) -> DataFrame:
    """Edges (u, v) between hashes of different lines (hash, norm, size; copies are fine); complete up to connectivity.

    A line sends its keys once per task that meets it, packed by part; a task drops the keys of single lines. Each bucket's
    lines are first compared with its smallest. Only buckets that this leaves in several components are compared pair by
    pair, and there only lines of different components: the others are linked already.
    """
    spark, by_key = texts.sparkSession, Window.partitionBy("key")
    parts = max(1, min(65535, -(-lines // _PART_LINES)))
    keyed = keyed_lines(texts, max_bits, bands, parts).groupBy("part").applyInArrow(_buckets(max_bits, similarity), _BUCKETS_DDL)
    short_lived: list[str] = []
    sized = stored(keyed, "blocks", short_lived)
    del keyed
    free_shuffles(spark)
    asked = sized.where("c > 2 or star").select(F.explode(F.array("hash", "least")).alias("hash"))
    texts = texts.select("hash", "norm").join(asked.distinct().hint("merge"), "hash", "left_semi")
    texts = stored(texts.groupBy("hash").agg(F.min("norm").alias("norm")), "texts", scratch)
    del asked
    free_shuffles(spark)

    def good(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        left, right = texts.toDF("u", "norm_u"), texts.toDF("v", "norm_v")
        return pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").where(_verified(similarity)("norm_u", "norm_v")).select("u", "v")

    stars = sized.where("star").select(F.col("least").alias("u"), F.col("hash").alias("v"))
    stars = stored(good(stars.distinct(), texts), "stars", scratch)
    free_shuffles(spark)
    roots = connected_components(stars).withColumnRenamed("node", "hash")
    # The one pair of a bucket of two is settled.
    left_over = sized.where("c > 2").join(roots.hint("merge"), "hash", "left").withColumn("root", F.coalesce("root", "hash"))
    left_over = left_over.withColumns({"low": F.min("root").over(by_key), "high": F.max("root").over(by_key)}).where("low <> high").drop("low", "high")
    left_over = stored(left_over, "open", scratch)
    forget_all(spark, short_lived)
    free_shuffles(spark)
    few, many = left_over.where(F.col("c") <= bucket_pairs), left_over.where(F.col("c") > bucket_pairs)
    a = few.select("key", *[F.col(x).alias(f"{x}_u") for x in ("hash", "sim", "root", "size")])
    b = few.select("key", "least", "star", *[F.col(x).alias(f"{x}_v") for x in ("hash", "sim", "root", "size")])
    pairs = a.join(b.hint("merge"), "key").where(f"hash_u < hash_v and root_u <> root_v and bit_count(sim_u ^ sim_v) <= {max_bits} and not (star and hash_u = least)")
    pairs = pairs.where(f"abs(size_u - size_v) <= {1 - similarity!r}D * greatest(size_u, size_v) + 1e-9D or greatest(size_u, size_v) >= {_MAX_SIZE}")
    pairs = stored(pairs.select(F.col("hash_u").alias("u"), F.col("hash_v").alias("v")).distinct(), "asked", scratch)
    free_shuffles(spark)
    # The texts that are still asked for are few; all of them move once more, not once per join.
    asked = pairs.select(F.explode(F.array("u", "v")).alias("hash")).unionByName(many.select("hash")).distinct()
    texts = stored(texts.join(asked.hint("merge"), "hash", "left_semi"), "texts", scratch)
    del asked
    free_shuffles(spark)
    pairs = stored(good(pairs, texts), "pairs", scratch)
    free_shuffles(spark)
    # Tiles of hot buckets: each line of part p goes to the tiles (p, q) and (q, p) of all parts q.
    parts = F.ceil(F.col("c") / tile).cast("int")
    own = F.pmod(F.xxhash64("hash"), parts).cast("int")
    tiled = many.withColumn("parts", parts).withColumn("p", own).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiled = tiled.select("hash", "sim", "root", "key", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), F.when(F.col("p") == F.col("q"), 3).when(F.col("p") < F.col("q"), 1).otherwise(2).alias("side"))
    hot = tiled.join(texts.hint("merge"), "hash").groupBy("key", "x", "y").applyInArrow(_forest(max_bits, similarity), "u long, v long")
    hot = stored(hot, "hot", scratch)
    free_shuffles(spark)
    return stars.unionByName(pairs).unionByName(hot).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, similarity: float = 0.8, bucket_pairs: int = 32, tile: int = 2000, bands: int = 0) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_removed, removed (line numbers from 0, ascending).

    Of each group of lines linked by edit similarity (1 - distance / longer length, of normalised lines, at least
    `similarity`) and fingerprint or, with `bands` (16 at most), a MinHash band, and of all copies of a line, the occurrence with the smallest (doc_id, row, line)
    stays. Lines are separated by newlines; a line without words is never removed. Null and empty texts have no lines. A
    null id comes after all others; rows that repeat an id are separate rows. No rows give no rows. Other columns are
    not read. A 64-bit hash stands for a normalised line.
    """
    scratch: list[str] = []
    seen = Observation()
    both = stored(parsed(docs, id_col, text_col).observe(seen, F.count("norm").alias("n")), "lines")
    own, texts = both.where("row is not null").select("row", "doc_id", "n_lines", "lines", "hashes"), both.where("row is null").select("hash", "norm", "size")
    lines = own.select("row", "doc_id", F.inline(F.arrays_zip(F.col("lines").alias("line"), F.col("hashes").alias("hash"))))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "line")
    distinct = stored(lines.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")), "distinct", scratch)
    roots = connected_components(links(texts, seen.get["n"], max_bits, similarity, bucket_pairs, tile, bands, scratch)).withColumnRenamed("node", "hash")
    # Lines that occur once and are linked to none stay anyway.
    rooted = distinct.join(roots, "hash", "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "hash"))
    least = rooted.groupBy("root").agg(F.min("first").alias("keep"))
    keep = stored(rooted.join(least, "root").select("hash", F.col("keep.row").alias("keep_row"), F.col("keep.line").alias("keep_line")), "kept")
    forget_all(docs.sparkSession, scratch)
    judged = lines.select("row", "line", "hash").join(keep.hint("merge"), "hash").where("keep_row <> row or keep_line <> line")
    gone = judged.groupBy("row").agg(F.array_sort(F.collect_list("line")).alias("removed"))
    out = own.select("row", "doc_id", "n_lines").join(gone.hint("merge"), "row", "left")
    removed = F.coalesce("removed", F.expr("cast(array() as array<int>)"))
    return out.select("doc_id", "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))
