import gzip
import hashlib
import io
import random
import zipfile

import pytest

from millrace.llm import archive
from millrace.llm._files import RangeFile, write_file

SCHEMA = "page_id long, url string, html string, first string, digest int"


def brute(rows):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        refers = first.get(data)
        refers = None if refers == i else refers
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


ROWS = [(i, f"http://host{i % 3}.example/p?q={i}", random.Random(i % 9).choice("aé<") * (i * 13 % 400)) for i in range(80)]


@pytest.mark.parametrize("zip64", [False, True])
def test_round_trip(spark, zip64):
    manifest = archive.write_archives(pages(spark, ROWS), archive_bytes=2000, zip64=zip64)
    got = archive.read_archives(manifest, records_per_task=5).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS)
    text = {i: (h or "").encode() for i, _, h in ROWS}
    assert all(bytes(r.payload) == text[r.page_id] for r in got if r.record_type == "response")


def test_edges(spark):
    big = "<p>long</p>" * 200000
    rows = [(1, None, None), (8, "http://[bad", "x"), (2, "", ""), (None, "http://a b/ü\r\nX: y", "z" * 150), (3, "http://x", "z" * 150), (3, "http://x", "z" * 150), (None, None, "q" * 99), (4, "http://x", big), (5, "http://y", big), (None, "n", "only null ids " * 10), (6, "u", "a" * 99), (7, "u", "a" * 99)]
    got = archive.read_archives(archive.write_archives(pages(spark, rows))).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    assert archive.read_archives(archive.write_archives(pages(spark, []))).collect() == []


def test_archives_are_plain_zip_and_warc(spark):
    path = archive.write_archives(pages(spark, ROWS[:20])).first()["path"].removeprefix("file://").removeprefix("file:")
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        assert z.namelist() == [archive.DATA, archive.INDEX]
        assert gzip.decompress(z.read(archive.DATA)).startswith(b"WARC/1.1\r\n")


def zip_of(parts, path):
    write_file(str(path), parts)
    return RangeFile(str(path))


def test_directory_of_foreign_zips(tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("packed.txt", "a" * 100)
        z.writestr(zipfile.ZipInfo("stored.txt"), "hello")
        with z.open(zipfile.ZipInfo("wide.txt"), "w", force_zip64=True) as f:
            f.write(b"wide")
        z.comment = b"PK\5\6 not the end"
    f = zip_of([buffer.getvalue()], tmp_path / "a.zip")
    members = archive.zip_directory(f)
    assert f.read(archive.data_start(f, members["stored.txt"]), 5) == b"hello"
    assert f.read(archive.data_start(f, members["wide.txt"]), 4) == b"wide"
    with pytest.raises(ValueError):
        archive.data_start(f, members["packed.txt"])


def test_damage_is_seen(tmp_path):
    with pytest.raises(ValueError):
        archive.zip_directory(zip_of([b"no zip at all"], tmp_path / "b"))
    with pytest.raises(ValueError):
        archive.parse_record(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc")
    with pytest.raises(ValueError):
        RangeFile(str(tmp_path / "b")).read(5, 100)


def test_zip64_fields(tmp_path):
    f = zip_of(archive.zip_parts([("one", [b"12", b"3"]), ("two", [b"xyz"])], zip64=True), tmp_path / "c")
    members = archive.zip_directory(f)
    assert [f.read(archive.data_start(f, members[n]), 3) for n in ("one", "two")] == [b"123", b"xyz"]
    with zipfile.ZipFile(str(tmp_path / "c")) as z:
        assert z.read("two") == b"xyz"
