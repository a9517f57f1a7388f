"""WARC records in ZIP-packaged archives (stored members), written once and read by ranges.

An archive is a ZIP file with two members, both stored: archive/data.warc.gz (one gzip member per record) and
indexes/index.cdxj (one line per record: sort-friendly URL, time, JSON with offset, length, digest, page). A reader finds
the end record (and the ZIP64 one), parses the central directory, finds where members' data start, reads the index, and
then reads only the bytes of the records that it wants. Nothing is extracted.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import bounded, workspace
from millrace.llm._files import RangeFile, write_file

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF


class Member(NamedTuple):
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header_at: int


def zip_parts(members: list[tuple[str, list[bytes]]], zip64: bool = False) -> list[bytes]:
    """A ZIP file of stored members, as parts to write one after the other; ZIP64 fields where sizes need them or if asked."""
    out, directory, at = [], [], 0
    for name, parts in members:
        raw, size, crc = name.encode(), sum(map(len, parts)), 0
        for part in parts:
            crc = zlib.crc32(part, crc)
        big = zip64 or size >= _MAX32 or at >= _MAX32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        shown = _MAX32 if big else size
        head = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if big else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra))
        out += [head + raw + extra, *parts]
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
        directory.append(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, _MAX32 if big else at) + raw + extra)
        at += len(head) + len(raw) + len(struct.pack("<HHQQ", 1, 16, 0, 0) if big else b"") + size
    central = b"".join(directory)
    big = zip64 or at >= _MAX32 or len(members) >= _MAX16 or len(central) >= _MAX32
    end = b""
    if big:
        end = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, len(members), len(members), len(central), at)
        end += struct.pack("<4sIQI", b"PK\6\7", 0, at + len(central), 1)
    n = _MAX16 if big else len(members)
    end += struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, n, n, _MAX32 if big else len(central), _MAX32 if big else at, 0)
    return [*out, central, end]


def zip_directory(file: RangeFile) -> dict[str, Member]:
    """Members of a ZIP file, from its central directory alone; ValueError if there is none."""
    tail_at = max(0, file.size - 22 - _MAX16)
    tail = file.read(tail_at, file.size - tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, n, size, start, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
    if n == _MAX16 or size == _MAX32 or start == _MAX32:
        where = tail_at + at - 20
        sign, _, end64, _ = struct.unpack("<4sIQI", file.read(where, 20)) if where >= 0 else (b"", 0, 0, 0)
        if sign == b"PK\6\7":
            sign, _, _, _, _, _, _, n, size, start = struct.unpack("<4sQHHIIQQQQ", file.read(end64, 56))
            if sign != b"PK\6\6":
                raise ValueError("no ZIP64 end of central directory")
    raw, at, found = file.read(start, size), 0, {}
    for _ in range(n):
        sign, _, _, _, method, _, _, crc, packed, full, len_name, len_extra, len_note, _, _, _, head = struct.unpack_from("<4sHHHHHHIIIHHHHHII", raw, at)
        if sign != b"PK\1\2":
            raise ValueError("central directory is damaged")
        name = raw[at + 46 : at + 46 + len_name].decode()
        extra, k = raw[at + 46 + len_name : at + 46 + len_name + len_extra], 0
        while k + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{width // 8}Q", extra, k + 4))
                full = next(values) if full == _MAX32 else full
                packed = next(values) if packed == _MAX32 else packed
                head = next(values) if head == _MAX32 else head
            k += 4 + width
        found[name] = Member(name, method, crc, packed, full, head)
        at += 46 + len_name + len_extra + len_note
    return found


def data_start(file: RangeFile, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members have ranges")
    sign, len_name, len_extra = struct.unpack("<4s22xHH", file.read(member.header_at, 30))
    if sign != b"PK\3\4":
        raise ValueError(f"{member.name}: no local header")
    return member.header_at + 30 + len_name + len_extra


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def target(url: str | None, page_id: int | None) -> str:
    """A URI without blanks or line ends; a name made of the page's id for a null or empty URL."""
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"


def surt(uri: str) -> str:
    """Sort-friendly form; a URI that can't be taken apart stays as it is."""
    try:
        parts = urlsplit(uri)
    except ValueError:
        return uri
    if not parts.hostname:
        return uri
    return f"{','.join(reversed((parts.hostname or '').split('.')))}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first_id: int | None, first_url: str | None, date: str) -> bytes:
    """One response record, or a revisit record if first_id is given; not yet compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first_id is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first_id is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target(url, page_id)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if first_id is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first_id, digest)}", f"WARC-Refers-To-Target-URI: {target(first_url, first_id)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {first_id}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("record's length is wrong")
    return fields, rest[:n]


def with_first(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """page_id, url, payload (bytes; null: empty), digest, first_id, first_url: the record that a row revisits, else null.

    Of equal payloads of least_bytes or more, the rows with the smallest id are no revisits. A null id is larger than all
    others; rows of null ids alone revisit nothing. The join's hot digests are split by adaptive execution.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull())
    first = long.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"))
    out = rows.join(first, "digest", "left").withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first")))
    return out.select("page_id", "url", "payload", "digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))


_MANIFEST = "path string, records long, bytes long"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100, archive_bytes: int = 32_000_000, date: str = "2024-01-01T00:00:00Z", zip64: bool = False) -> DataFrame:
    """Write every row of pages as a WARC record; (path, records, bytes) per archive, itself a table in the shared folder.

    A task holds one archive of about archive_bytes compressed bytes at a time. A task that runs again writes other
    archives; the manifest names those of the tasks that were counted only. No rows write no archives. Repeated rows get
    a record each.
    """
    spark = bounded(pages).sparkSession
    folder, manifest = workspace(spark, "warc"), workspace(spark, "manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body: list[bytes] = []
        index: list[str] = []
        size = 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            n = write_file(path, zip_parts([(DATA, body), (INDEX, ["".join(sorted(index)).encode()])], zip64))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(index)]), pa.array([n])], ["path", "records", "bytes"])

        stamp = re.sub(r"\D", "", date)
        for batch in batches:
            for page_id, url, payload, digest, first_id, first_url in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "first_id", "first_url"))):
                data = gzip.compress(warc_record(page_id, url, payload, digest, first_id, first_url, date), 3, mtime=0)
                entry = {"url": url, "page": page_id, "digest": f"sha256:{digest}", "offset": size, "length": len(data), "filename": DATA}
                index.append(f"{surt(target(url, page_id))} {stamp} {json.dumps(entry)}\n")
                body.append(data)
                size += len(data)
                if size >= archive_bytes:
                    yield close()
                    body, index, size = [], [], 0
        if index:
            yield close()

    with_first(pages, id_col, url_col, payload_col, least_bytes).mapInArrow(run, _MANIFEST).write.parquet(manifest)
    return spark.read.schema(_MANIFEST).parquet(manifest)


class Archive:
    """Range reads from one archive."""

    def __init__(self, path: str) -> None:
        self.file = RangeFile(path)
        self.members = zip_directory(self.file)
        self.start = data_start(self.file, self.members[DATA])

    def index(self) -> list[dict]:
        """Entries of the index, in order of offset."""
        member = self.members[INDEX]
        raw = self.file.read(data_start(self.file, member), member.size)
        if zlib.crc32(raw) != member.crc:
            raise ValueError("index is damaged")
        entries = [json.loads(x.split(" ", 2)[2]) for x in raw.decode().split("\n") if x]
        return sorted(entries, key=lambda x: x["offset"])

    def records(self, entries: list[dict], most: int = 4_000_000) -> Iterator[tuple[dict[str, str], bytes]]:
        """Fields and block of each entry; neighbours are read together, `most` bytes at a time."""
        at = 0
        while at < len(entries):
            end, first = at + 1, entries[at]["offset"]
            while end < len(entries) and entries[end]["offset"] == entries[end - 1]["offset"] + entries[end - 1]["length"] and entries[end]["offset"] + entries[end]["length"] - first <= most:
                end += 1
            raw = self.file.read(self.start + first, entries[end - 1]["offset"] + entries[end - 1]["length"] - first)
            for e in entries[at:end]:
                yield parse_record(zlib.decompress(raw[e["offset"] - first : e["offset"] - first + e["length"]], 31))
            at = end


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(manifest: DataFrame, with_payload: bool = True, records_per_task: int = 4000) -> DataFrame:
    """Records of the archives named by `path`: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    payload is null for revisits, whose length and digest come from the record's own fields; a response's payload is
    checked against its digest. Large archives are read by several tasks, each from its own part of the index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, part, parts in zip(*(batch[c].to_pylist() for c in ("path", "part", "parts"))):
                archive = Archive(path)
                entries = archive.index()
                own = entries[len(entries) * part // parts : len(entries) * (part + 1) // parts]
                rows, size = [], 0
                for fields, block in archive.records(own):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                    n = int(re.search(rb"(?i)\ncontent-length: *(\d+)", http)[1])
                    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: payload of {fields['warc-record-id']} is damaged")
                    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                    held = payload if with_payload and kind == "response" else None
                    rows.append((page and int(page), fields["warc-target-uri"], n, digest, kind, refers and int(refers), held))
                    size += len(held or b"")
                    if size > 8_000_000 or len(rows) >= 2000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)
                archive.file.close()

    tasks = manifest.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("records") / records_per_task)).cast("int"))
    tasks = tasks.select("path", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts")
    n = max(manifest.sparkSession.sparkContext.defaultParallelism, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return tasks.repartition(n, "path", "part").mapInArrow(run, kind)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), _RECORD)], schema=_RECORD)
