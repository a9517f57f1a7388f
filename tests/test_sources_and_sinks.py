import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from millrace.operators.transforms import Filter
from millrace.plans import envelope
from millrace.sources.http import HttpSink, HttpSource
from millrace.sources.readers import Concat, CsvSource, DeadLetterSource, DeadLetterTable, FileSource, FnSource, JdbcSource, JsonSource, ParquetSource, SqlSource, TableSource, merge
from millrace.sources.sinks import CsvSink, DbApiSink, DeadLetterSink, FileSink, FnSink, JdbcSink, JsonSink, LedgerSink, LoggerSink, fan_out


def write(path, text):
    path.write_text(text)
    return str(path)


def values(source, spark):
    return [tuple(r) for r in source.read(spark).collect()]


def test_csv_by_header(spark, tmp_path):
    at = write(tmp_path / "a.csv", "age;NAME;junk\n30;Alice;x\nbad;Bob;y\n25\n")
    assert values(CsvSource(at, "Name string, Age int, Missing double", ";"), spark) == [("Alice", 30, None), ("Bob", None, None), (None, 25, None)]


@pytest.mark.parametrize(
    "text, want",
    [('[{"Value":"a"},null,{"Value":"b"}]', ["a", "b"]), ('\n\n{"Value":"a"}\n\nnull\n{"Value":"b"}\n', ["a", "b"]), ("", []), (" \n ", []), ("[]", [])],
)
def test_json_objects(spark, tmp_path, text, want):
    assert [v for (v,) in values(JsonSource(write(tmp_path / "a.json", text), "Value string"), spark)] == want


def test_json_scalars_and_errors(spark, tmp_path):
    assert values(JsonSource(write(tmp_path / "a", '["valid",null,"also valid"]'), "string"), spark) == [("valid",), ("also valid",)]
    assert values(JsonSource(write(tmp_path / "b", '"item1"\n\n"item2"'), "string"), spark) == [("item1",), ("item2",)]
    for name, text in (("c", "not json"), ("d", "[1,")):
        with pytest.raises(Exception):
            values(JsonSource(write(tmp_path / name, text), "Value string"), spark)
    with pytest.raises(ValueError):
        JsonSource("  ", "a int")


def test_sql_source(spark):
    df = spark.createDataFrame([(1, "One"), (2, None)], "Id long, Name string")
    assert values(SqlSource("SELECT Name FROM things WHERE Id = :id", {"id": 1}, {"things": df}), spark) == [("One",)]


def test_table_source_pushes_down(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id") * 2).write.parquet(str(tmp_path / "p"))
    df = TableSource(ParquetSource(str(tmp_path / "p"))).with_query(lambda d: d.where("id > 97").select("v")).read(spark)
    assert sorted(r.v for r in df.collect()) == [196, 198]
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,97)]" in df._jdf.queryExecution().toString()


def test_concat_skips_failing_sources(spark):
    a, b = FnSource(lambda s: s.range(2)), ParquetSource("/nowhere/at/all")
    assert Concat((a, b, a), "n", skip_failing=True).read(spark).count() == 4
    with pytest.raises(Exception):
        Concat((a, b)).read(spark)
    assert merge(spark.range(2), spark.range(3), spark.range(1)).count() == 6


DEAD = [{"Value": {"Id": 1}, "IsSuccess": False, "Error": {"Message": "x"}}, {"Value": {"Id": 2}, "IsSuccess": True}, {"IsSuccess": False}, {"Value": None}, {"value": {"id": 3}}]


@pytest.mark.parametrize("style", ["lines", "array", "pretty"])
def test_dead_letter_source(spark, tmp_path, style):
    text = {"lines": "\n".join(map(json.dumps, DEAD)), "array": json.dumps(DEAD), "pretty": json.dumps(DEAD[0], indent=1)}[style]
    got = values(DeadLetterSource(write(tmp_path / "d.json", text), "Id int"), spark)
    assert got[0] == (1,) and len(got) == (1 if style == "pretty" else 2)


def flow(spark):
    df = envelope.wrap(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, name string"), "id")
    df = envelope.fail_where(df, F.col("id") == 2, envelope.error("bad"))
    return Filter(F.col("id") != 3).apply(df)


def test_file_sinks_take_successes_only(spark, tmp_path):
    fan_out(flow(spark), [FileSink(str(tmp_path / "p")), CsvSink(str(tmp_path / "c"), ";"), JsonSink(str(tmp_path / "j")), JsonSink(str(tmp_path / "a"), as_array=True), LoggerSink()])
    assert values(ParquetSource(str(tmp_path / "p")), spark) == [(1, "a")]
    assert values(CsvSource(str(tmp_path / "c"), "id long, name string", ";"), spark) == [(1, "a")]
    assert values(FileSource("json", str(tmp_path / "j"), "id long, name string"), spark) == [(1, "a")]
    whole = "".join(p.read_text() for p in (tmp_path / "a").glob("part-*"))
    assert json.loads(whole) == [{"id": 1, "name": "a"}] and "\n" in whole.strip()


def test_dead_letters_keep_their_payload(spark, tmp_path):
    DeadLetterSink(str(tmp_path / "d")).write(flow(spark))
    assert values(DeadLetterSource(str(tmp_path / "d"), "id long, name string"), spark) == [(2, "b")]
    DeadLetterSink(str(tmp_path / "p"), "parquet").write(flow(spark))
    assert values(DeadLetterTable(str(tmp_path / "p")), spark) == [(2, "b")]


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    JdbcSink(url, "items", "overwrite", driver).write(flow(spark))
    assert values(JdbcSource(url, 'SELECT "id", "name" FROM items', options=driver), spark) == [(1, "a")]
    assert values(JdbcSource(url, 'SELECT "id", "name" FROM items', options=driver, partition=("\"id\"", 0, 10, 2)), spark) == [(1, "a")]


def test_db_api(spark, tmp_path):
    import sqlite3

    at = str(tmp_path / "s.db")
    with sqlite3.connect(at) as link:
        link.execute("CREATE TABLE items (id INTEGER PRIMARY KEY, name TEXT)")
    DbApiSink(lambda: sqlite3.connect(at, timeout=30), table="items").write(flow(spark).coalesce(1))
    assert sqlite3.connect(at).execute("SELECT * FROM items").fetchall() == [(1, "a")]


@pytest.fixture()
def server():
    posts = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def _send(self, code, body=b""):
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            bodies = {"/a": b'[{"Id": 1, "Name": "One"}, null]', "/b": b"null", "/c": b'[{"id": 2}]'}
            self._send(200 if self.path in bodies else 500, bodies.get(self.path, b""))

        def do_POST(self):
            posts.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self._send(500)

        def log_message(self, *args):
            pass

    run = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=run.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{run.server_port}", posts
    run.shutdown()


def test_http_source(spark, server):
    url, _ = server
    assert sorted(values(HttpSource((f"{url}/a", f"{url}/b", f"{url}/c"), "id int, name string"), spark), key=str) == [(1, "One"), (2, None)]
    with pytest.raises(Exception):
        values(HttpSource((f"{url}/broken",), "id int", retries=1), spark)


def test_http_sink(spark, server):
    url, posts = server
    HttpSink(f"{url}/x").write(flow(spark))
    assert posts == [{"id": 1, "name": "a"}]
    with pytest.raises(Exception):
        HttpSink(f"{url}/x", check_status=True).write(flow(spark))


def test_fan_out_order(spark):
    seen = []
    fan_out(flow(spark), [FnSink(lambda d: seen.append(("a", d.count()))), FnSink(lambda d: seen.append(("b", d.count())))])
    assert seen == [("a", 3), ("b", 3)]


def test_dead_letter_names_at_every_depth(spark, tmp_path):
    text = "\n".join(map(json.dumps, [
        {"Value": {"Name": "a", "id": 1}},
        {"value": {"id": 2, "Value": "x", "NAME": "b", "Inner": {"Deep": [{"A": 1}, {"a": 2}, None]}}},
        {"VALUE": {"isSuccess": "kept", "id": 3}, "ISSUCCESS": False},
        {"Value": {"id": 4}, "is_success": True},
        {"Value": {"id": None, "name": None}},
    ]))
    rows = DeadLetterSource(write(tmp_path / "d.json", text), "id int, name string, Value string, isSuccess string, inner struct<deep:array<struct<a:int>>>").read(spark).collect()
    assert [(r["id"], r["name"], r["Value"], r["isSuccess"]) for r in rows] == [(1, "a", None, None), (2, "b", "x", None), (3, None, None, "kept"), (None, None, None, None)]
    assert [x and x["a"] for x in rows[1]["inner"]["deep"]] == [1, 2, None] and rows[0]["inner"] is None


@pytest.mark.parametrize("text, want", [("", 0), (" \n", 0), ("[]", 0), ("null", 0), ('[{"Value":{"id":1}},null]', 1)])
def test_dead_letter_edges(spark, tmp_path, text, want):
    assert DeadLetterSource(write(tmp_path / "d.json", text), "id int").read(spark).count() == want


def test_malformed_dead_letters_raise(spark, tmp_path):
    with pytest.raises(Exception):
        DeadLetterSource(write(tmp_path / "d.json", '{"Value":{"id":1}}\n{"Value":'), "id int").read(spark).collect()


def test_skipped_sources_are_told(spark, caplog):
    told = []
    Concat((FnSource(lambda s: s.range(1)), ParquetSource("/nowhere/at/all")), skip_failing=True, on_skip=lambda i, e: told.append(i)).read(spark)
    assert told == [1] and "source 1 (ParquetSource) is left out" in caplog.text


def test_csv_files_with_other_headers_raise(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    write(folder / "a.csv", "Name,Age\nAlice,30\n")
    write(folder / "b.csv", "Name,Age\nBob,25\n")
    assert sorted(values(CsvSource(str(folder), "Name string, Age int"), spark)) == [("Alice", 30), ("Bob", 25)]
    assert sorted(values(CsvSource(str(folder), "Age int"), spark)) == [(25,), (30,)]
    write(folder / "c.csv", "Age,Name\n7,Eve\n")
    with pytest.raises(Exception):
        values(CsvSource(str(folder), "Name string, Age int"), spark)


def test_an_embedded_database_loads_and_unloads_files(spark, tmp_path):
    """Tasks of other processes can't open it, so none of them may: only files go between."""
    import datetime

    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    when = datetime.datetime(2024, 2, 29, 1, 2, 3, 456789)
    words = [None, "", " ", "a", ' "b", ', "c\nd", "e\\", "é世", "null", "'", "tail  "]
    rows = [(i, w, None if i == 3 else i / 3, i % 2 == 0, when) for i, w in enumerate(words)]
    df = envelope.wrap(spark.createDataFrame(rows, "id long, word string, x double, even boolean, t timestamp").repartition(3), "id")
    JdbcSink(url, "odd", "overwrite", driver, through=f"file://{tmp_path}/files").write(df)
    LedgerSink(url, "odd2", "s", driver, through=f"file://{tmp_path}/files").write_batch(df, 0)
    LedgerSink(url, "odd2", "s", driver, through=f"file://{tmp_path}/files").write_batch(df, 0)
    for name in ("odd", '"odd2"'):
        back = JdbcSource(url, f'SELECT "id", "word", "x", "even", "t" FROM {name}', options=driver, through=f"file://{tmp_path}/files").read(spark)
        assert sorted(tuple(r) for r in back.collect()) == rows
        assert "JDBC" not in back._jdf.queryExecution().toString().upper()
    with pytest.raises(ValueError):
        JdbcSink(url, "odd", "append", driver, through="hdfs://x/files").write(df)
