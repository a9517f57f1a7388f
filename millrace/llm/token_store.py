"""Token ids in files coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over all ids, is shared by all shards. A shard holds the documents of one range of ids:

    magic, header length (u32), header (JSON), document index (i64 ids, u8 null flags, u32 counts), blocks

A block codes up to BLOCK ids on their own: LANES interleaved 64-bit states, id i in lane i mod LANES, 32-bit
renormalisation, words in reading order. It keeps its states at every CHECK_ROWS rows, so that decoding can start there,
and CRC-32s of its words and of its ids (little-endian u32). The header lists each block's place, ids and checkpoints.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import CHUNK_BYTES, bounded, chunks_of, forget, give_back, id_chunks, slices, workspace
from millrace.llm._files import RangeFile, write_file
from millrace.llm.encoder import Encoder, take

MAGIC = b"MRANS01\n"
SCALE_BITS, LANES, BLOCK, CHECK_ROWS = 20, 2048, 1 << 19, 128
_LOW = np.uint64(1 << 31)
#: Text bytes that are cut and looked up at once: the more, the fewer looks at the pieces remembered, and the more memory.
ENCODE_BYTES = 2_000_000
#: Bytes of an Arrow batch: workers hold a tokenizer and its pieces besides.
TOKEN_BATCH = 4 << 20


class Table:
    """Frequencies scaled to 2^SCALE_BITS; every counted id keeps at least 1."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)))[:-1].astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    @classmethod
    def counted(cls, counts: np.ndarray) -> Table:
        total, goal = int(counts.sum()), 1 << SCALE_BITS
        seen = counts > 0
        if seen.sum() > goal:
            raise ValueError(f"more than {goal} different ids")
        if not total:
            return cls(np.array([goal], dtype=np.int64))
        freq = np.where(seen, np.maximum(1, counts.astype(np.float64) * goal / total), 0).astype(np.int64)
        while (off := goal - int(freq.sum())) != 0:  # the largest take up the rounding
            top = np.argsort(-freq, kind="stable")[: max(1, int(seen.sum()) // 8 + 1)]
            room = np.full(len(top), off) if off > 0 else -(freq[top] - 1)
            step = np.zeros(len(top), dtype=np.int64)
            share = int(np.ceil(abs(off) / len(top)))
            left = abs(off)
            for i in range(len(top)):
                step[i] = min(share, left, abs(int(room[i])))
                left -= int(step[i])
                if not left:
                    break
            freq[top] += np.sign(off) * step
        return cls(freq)


def encode_block(ids: np.ndarray, table: Table) -> tuple[bytes, list[dict]]:
    """Words of one block; the checkpoints: row, word offset and states from which decoding goes on."""
    rows = -(-len(ids) // LANES)
    x = np.full(LANES, _LOW, dtype=np.uint64)
    freq, start = table.freq[ids], table.start[ids]
    shift, low = np.uint64(SCALE_BITS), np.uint64(32)
    limit = freq << np.uint64(63 - SCALE_BITS)
    out, checks, words = [], [], 0
    for r in range(rows - 1, -1, -1):
        a, b = r * LANES, min((r + 1) * LANES, len(ids))
        y, f = x[: b - a], freq[a:b]
        big = y >= limit[a:b]
        if big.any():
            out.append(y[big].astype(np.uint32))
            words += len(out[-1])
            y = np.where(big, y >> low, y)
        q = y // f
        x[: b - a] = (q << shift) + (y - q * f) + start[a:b]
        if r % CHECK_ROWS == 0:
            checks.append((r, words, x.copy()))
    stream = np.concatenate(out[::-1]) if out else np.zeros(0, dtype=np.uint32)
    marks = [{"row": r, "word": words - w, "states": s} for r, w, s in reversed(checks)]
    return stream.astype("<u4").tobytes(), marks


def decode_block(words: np.ndarray, n: int, table: Table, x: np.ndarray, row: int = 0, word: int = 0, end_row: int | None = None) -> np.ndarray:
    """Ids of rows row..end_row of a block of n ids, from the states and word offset of a checkpoint."""
    rows = -(-n // LANES) if end_row is None else end_row
    out = np.empty(max(0, min(rows * LANES, n) - row * LANES), dtype=np.uint32)
    x, mask, shift, low = x.copy(), np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    at, done = word, 0
    for r in range(row, rows):
        m = min(LANES, n - r * LANES)
        y = x[:m]
        slot = y & mask
        s = table.slot[slot]
        y = table.freq[s] * (y >> shift) + slot - table.start[s]
        small = np.flatnonzero(y < _LOW)
        if len(small):
            y[small] = (y[small] << low) | words[at : at + len(small)]
            at += len(small)
        x[:m] = y
        out[done : done + m] = s
        done += m
    return out


def shard_bytes(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray, start: int, table: Table) -> list[bytes]:
    blocks, body = [], []
    for at in range(0, len(ids), BLOCK):
        own = ids[at : at + BLOCK]
        words, marks = encode_block(own, table)
        states = b"".join(m["states"].astype("<u8").tobytes() for m in marks)
        blocks.append({"n": len(own), "states": len(states), "words": len(words), "rows": [m["row"] for m in marks], "offsets": [m["word"] for m in marks], "crc_words": zlib.crc32(states + words), "crc_ids": zlib.crc32(own.astype("<u4").tobytes())})
        body += [states, words]
    index = np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes() + np.array([x is None for x in doc_ids], dtype=np.uint8).tobytes() + counts.astype("<u4").tobytes()
    header = json.dumps({"scale_bits": SCALE_BITS, "lanes": LANES, "docs": len(doc_ids), "ids": len(ids), "start": start, "table_crc": table.crc, "index_crc": zlib.crc32(index), "blocks": blocks}).encode()
    return [MAGIC, struct.pack("<I", len(header)), header, index, *body]


class Shard:
    """Reads a shard: the index, whole blocks, or a range of ids from the nearest checkpoint."""

    def __init__(self, uri: str, table: Table) -> None:
        self.file, self.table = RangeFile(uri), table
        if self.file.read(0, 8) != MAGIC:
            raise ValueError(f"{uri}: not a shard")
        (n,) = struct.unpack("<I", self.file.read(8, 4))
        self.header = h = json.loads(self.file.read(12, n))
        if (h["scale_bits"], h["lanes"], h["table_crc"]) != (SCALE_BITS, LANES, table.crc):
            raise ValueError(f"{uri}: coded with another table")
        index = self.file.read(12 + n, 13 * h["docs"])
        if zlib.crc32(index) != h["index_crc"]:
            raise ValueError(f"{uri}: index is damaged")
        d = h["docs"]
        null = np.frombuffer(index, np.uint8, d, 8 * d)
        self.doc_ids = [None if z else i for i, z in zip(np.frombuffer(index, "<i8", d).tolist(), null.tolist())]
        self.counts = np.frombuffer(index, "<u4", d, 9 * d).astype(np.int64)
        sizes = np.array([b["states"] + b["words"] for b in h["blocks"]], dtype=np.int64)
        self.at = 12 + n + 13 * d + np.cumsum(sizes) - sizes

    def block(self, k: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids first..last of block k; a whole block is checked against its checksum."""
        b = self.header["blocks"][k]
        raw = self.file.read(int(self.at[k]), b["states"] + b["words"])
        if zlib.crc32(raw) != b["crc_words"]:
            raise ValueError(f"block {k} is damaged")
        states = np.frombuffer(raw, "<u8", b["states"] // 8).reshape(-1, LANES).astype(np.uint64)
        words = np.frombuffer(raw, "<u4", b["words"] // 4, b["states"]).astype(np.uint64)
        last = b["n"] if last is None else last
        mark = max(i for i, r in enumerate(b["rows"]) if r * LANES <= first) if b["n"] else 0
        row = b["rows"][mark]
        ids = decode_block(words, b["n"], self.table, states[mark], row, b["offsets"][mark], -(-last // LANES))
        if first == 0 and last == b["n"] and zlib.crc32(ids.astype("<u4").tobytes()) != b["crc_ids"]:
            raise ValueError(f"block {k} decodes to other ids")
        return ids[first - row * LANES : last - row * LANES]

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        last = self.header["ids"] if last is None else last
        parts = [self.block(k, max(0, first - k * BLOCK), min(b["n"], last - k * BLOCK)) for k, b in enumerate(self.header["blocks"]) if k * BLOCK < last and first < k * BLOCK + b["n"]]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


def _pack(ids: np.ndarray) -> bytes:
    """Ids in two bytes if they fit, else in four, byte plane by byte plane."""
    wide = 2 if ids.max(initial=0) < 1 << 16 else 4
    return bytes([wide]) + zstandard.compress(ids.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T.tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    wide = blob[0]
    raw = np.frombuffer(zstandard.decompress(memoryview(blob)[1:]), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(wide, -1).T).view(f"<u{wide}").ravel().astype(np.uint32)


_ROW = "chunk int, doc_ids array<bigint>, counts array<int>, n long, ids binary"


def _tokenize(path: str, end_id: int, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        try:
            for batch in batches:
                for part in slices(batch, "text", ENCODE_BYTES):
                    flat, counts = encoder.encode(part["text"])
                    flat = np.insert(flat, np.cumsum(counts), np.uint32(end_id))
                    counts = counts + 1
                    chunks = chunks_of(part["doc_id"].combine_chunks(), bounds)
                    order = np.argsort(chunks, kind="stable")
                    if (chunks[1:] < chunks[:-1]).any():
                        flat = take(flat, (np.cumsum(counts) - counts)[order], counts[order])
                    doc_ids, counts, ends = part["doc_id"].take(pa.array(order)).to_pylist(), counts[order], np.cumsum(counts[order])
                    met, first = np.unique(chunks[order], return_index=True)
                    rows = []
                    for c, a, b in zip(met.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
                        own = flat[ends[a] - counts[a] : ends[b - 1]]
                        rows.append({"chunk": c, "doc_ids": doc_ids[a:b], "counts": counts[a:b].tolist(), "n": len(own), "ids": _pack(own)})
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("chunk", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("n", pa.int64()), ("ids", pa.binary())]))
        finally:
            Encoder.release()
            give_back()

    return run


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for blob in batch["ids"]:
                total += np.bincount(_unpack(blob.as_py()), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    return run


_SHARD = pa.schema([("chunk", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])


def _write(folder: str, shared, starts) -> object:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        docs = []
        for doc_ids, counts, blob in zip(table["doc_ids"].to_pylist(), table["counts"].to_pylist(), table["ids"].to_pylist()):
            docs += zip(doc_ids, np.split(_unpack(blob), np.cumsum(counts)[:-1]))
        docs.sort(key=lambda x: (x[0] is None, x[0] or 0))
        docs = _ties(docs)
        ids = np.concatenate([x for _, x in docs])
        path = f"{folder}/shard-{chunk:08d}.mrans"
        size = write_file(path, shard_bytes(ids, [d for d, _ in docs], np.array([len(x) for _, x in docs]), starts.value[chunk], shared.value))
        return pa.table([[chunk], [path], [len(docs)], [len(ids)], [size]], schema=_SHARD)

    return run


def _ties(docs: list) -> list:
    """Rows of equal id in the order of their ids' bytes: reruns write the same file."""
    out, at = [], 0
    while at < len(docs):
        end = at + 1
        while end < len(docs) and docs[end][0] == docs[at][0]:
            end += 1
        out += docs[at:end] if end == at + 1 else sorted(docs[at:end], key=lambda x: x[1].tobytes())
        at = end
    return out


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, Table]:
    """Encode every text, append end_id, write shards in ascending order of ids; (manifest, frequency table).

    Null texts are empty (the end id alone); null ids come last; rows that repeat an id stand in the order of their ids'
    bytes. No rows write no shards. Texts pass the tokenizer once; ids wait in the shared folder while they are counted.
    The driver gets one count per id of the vocabulary and one sum per shard.
    """
    spark = docs.sparkSession
    rows = bounded(docs, TOKEN_BATCH).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bounds = id_chunks(rows, "doc_id", "text", chunk_bytes)
    held, folder = workspace(spark, "ids"), workspace(spark, "shards")
    rows.mapInArrow(_tokenize(tokenizer, end_id, bounds), _ROW).write.option("compression", "none").parquet(held)
    ids = spark.read.schema(_ROW).parquet(held)
    size = max(Encoder.of(tokenizer).size, end_id + 1)
    counts = np.zeros(size, dtype=np.int64)
    for row in ids.select("ids").mapInArrow(_count(size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    table = Table.counted(counts)
    sums = sorted((r["chunk"], r["n"]) for r in ids.groupBy("chunk").agg(F.sum("n").alias("n")).collect())
    starts = dict(zip([c for c, _ in sums], np.cumsum([0, *[n for _, n in sums]]).tolist()))
    sc = spark.sparkContext
    shards = ids.groupBy("chunk").applyInArrow(_write(folder, sc.broadcast(table), sc.broadcast(starts)), "chunk int, path string, docs long, ids long, bytes long")
    manifest = workspace(spark, "manifest")
    shards.write.parquet(manifest)
    forget(spark, held)
    return spark.read.schema(shards.schema).parquet(manifest), table


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_index(manifest: DataFrame, table: Table) -> DataFrame:
    """Decode every shard: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian u32) per document."""
    shared = bounded(manifest, TOKEN_BATCH).sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                shard = Shard(path, shared.value)
                raw = memoryview(shard.ids().astype("<u4").tobytes())
                ends = np.cumsum(shard.counts)
                starts = ends - shard.counts
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + shard.header["start"]), pa.array(shard.counts), pa.array(crcs, pa.int64())], schema=_READ)

    spread = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    paths = manifest.select("path").repartition(max(spread, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")
    return paths.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
