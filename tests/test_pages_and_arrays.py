import json
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from millrace.operators import sketches
from millrace.sources.json_arrays import JsonArraySource
from millrace.sources.pages import Pages
from millrace.streaming import metrics
from millrace.streaming.sampling import StreamSample


@pytest.fixture()
def pages(spark):
    spark.dataSource.register(Pages)
    return spark


def put(folder, n, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"p{n:03d}.json").write_text(json.dumps(rows))


def take(spark, folder, tmp, most=2, schema="k long, v string"):
    df = spark.readStream.format("millrace_pages").schema(schema).option("pages", most).load(str(folder))
    q = df.writeStream.format("parquet").option("path", str(tmp / "o")).option("checkpointLocation", str(tmp / "cp")).trigger(processingTime="0 seconds").start()
    try:
        end, seen = time.monotonic() + 60, -1
        while time.monotonic() < end:
            if q.exception():
                raise q.exception()
            there = spark.read.schema(schema).parquet(str(tmp / "o")).count() if (tmp / "o" / "_spark_metadata").exists() else 0
            if q.lastProgress and q.lastProgress.numInputRows == 0 and there == seen:
                break
            seen = there
            time.sleep(0.3)
    finally:
        q.stop()
    return sorted(map(tuple, spark.read.schema(schema).parquet(str(tmp / "o")).collect()), key=str)


def test_a_stream_of_pages_goes_on_where_it_stopped(pages, tmp_path):
    for n in range(5):
        put(tmp_path / "in", n, [{"K": n, "v": "x"}, None])
    assert take(pages, tmp_path / "in", tmp_path) == [(n, "x") for n in range(5)]
    for n in range(5, 8):
        put(tmp_path / "in", n, [{"k": n}])
    assert take(pages, tmp_path / "in", tmp_path) == sorted([(n, "x") for n in range(5)] + [(n, None) for n in range(5, 8)], key=str)


def test_pages_of_a_server(pages, tmp_path):
    names = ["a.json", "b.json"]
    body = {"/index.json": names, "/a.json": [{"k": 1, "v": "é"}], "/b.json": [{"k": 2, "v": None}]}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body[self.path]).encode())

        def log_message(self, *args): ...

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        df = pages.read.format("millrace_pages").schema("k long, v string").load(f"http://127.0.0.1:{server.server_port}")
        assert sorted(map(tuple, df.collect())) == [(1, "é"), (2, None)]
    finally:
        server.shutdown()


def test_writes_are_seen_whole_or_not_at_all(pages, tmp_path):
    path = str(tmp_path / "out")
    write = lambda df: df.write.format("millrace_pages").option("rows", 4).mode("append").save(path)
    write(pages.range(0, 10, 1, 3).select(F.col("id").alias("k")))
    with pytest.raises(Exception, match="half"):
        write(pages.range(10, 30, 1, 2).select(F.when(F.col("id") == 29, F.raise_error(F.lit("half"))).otherwise(F.col("id")).alias("k")))
    read = lambda: sorted(r.k for r in pages.read.format("millrace_pages").schema("k long").load(path).collect())
    assert read() == [*range(10)]
    write(pages.range(10, 12).select(F.col("id").alias("k")))
    assert read() == [*range(12)]
    with pytest.raises(Exception):
        pages.range(1).select(F.col("id").alias("k")).write.format("millrace_pages").mode("overwrite").save(path)


@pytest.mark.parametrize("size", [1, 3, 7, 64, 1 << 20])
def test_arrays_in_ranges_of_any_size(spark, tmp_path, size):
    rng = random.Random(size)
    texts = ['"', "\\", '\\"', "],[", "{", "é漢", "", ",", "\\\\", "plain"]
    make = lambda i: {"k": i, "v": "".join(rng.choices(texts, k=rng.randrange(6))), "deep": [{"a": [1, {"b": "]"}]}] * rng.randrange(3)}
    rows = [make(i) for i in range(12 if size < 3 else 60)]
    (tmp_path / "a.json").write_text(json.dumps(rows[:5], indent=rng.choice([None, 2]), ensure_ascii=False))
    (tmp_path / "b.json").write_text(" \n" + json.dumps(rows[5:8]) + "\n" + json.dumps(rows[8:], separators=(",", ":")) + "\n")
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text("")
    got = JsonArraySource(str(tmp_path), "k long, v string, deep array<struct<a:array<string>>>", size).read(spark).collect()
    assert sorted((r.k, r.v, len(r.deep)) for r in got) == [(r["k"], r["v"], len(r["deep"])) for r in rows]


def test_stream_sample_equals_the_batch_sample(spark, tmp_path):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"))
    want = sorted(map(tuple, sketches.bottom_k(df, "id", 7, "g").collect()))
    for name, cuts in (("a", [0, 500]), ("b", [0, 3, 200, 201, 500])):
        sample = StreamSample(str(tmp_path / name), "id", 7, ["g"])
        for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            for _ in range(2):
                sample.add(df.where((F.col("id") >= lo) & (F.col("id") < hi)), n)
        assert sorted(map(tuple, sample.rows(spark).collect())) == want


def test_latencies_add_up_over_batches():
    running = metrics.RunningLatency()
    first = running.add({"latency_10": 90, "items_processed": 3})
    assert first["items_processed"] == 3 and not any(k.startswith("latency_") for k in first)
    assert first["p50_latency_ms"] == first["p99_latency_ms"] == running.percentile(0.5)
    second = running.add({"latency_30": 10})
    assert second["p50_latency_ms"] == first["p50_latency_ms"] < second["p95_latency_ms"] == second["p99_latency_ms"]
    assert metrics.RunningLatency().add({"x": 1}) == {"x": 1}
    board = metrics.dashboard("Running", second | {"items_refused": 1})
    assert board["p99_latency_ms"] == second["p99_latency_ms"] and board["circuit_breaker"] == "Open"


class Meter:
    def __init__(self):
        self.made = {}

    def _add(self, name):
        def add(value, attributes):
            self.made.setdefault(name, []).append((value, attributes["pipeline"]))

        return type("Instrument", (), {"add": staticmethod(add), "record": staticmethod(add)})()

    def create_counter(self, name, unit, description):
        return self._add(name)

    create_histogram = create_counter


def flaky(row, attempt):
    if row["id"] % 4 == 0 and attempt == 1:
        raise ConnectionError("later")
    if row["id"] % 10 == 3:
        raise ValueError("never")
    return {}


def meters_of(p, run):
    from millrace.operators.resilience import RetryPolicy

    meter = Meter()
    run(p.keyed("id").attempt(flaky, policy=RetryPolicy(1), timed=True).options(meter=meter))
    return meter.made


def test_a_meter_sees_processed_failed_retries_and_latency(spark, tmp_path):
    from millrace.plans.pipeline import Pipeline
    from millrace.sources.readers import FnSource
    from millrace.sources.sinks import FileSink

    made = meters_of(Pipeline(name="m").source(FnSource(lambda s: s.range(40))), lambda p: p.to(spark, FileSink(str(tmp_path / "o"))))
    total = lambda name: sum(v for v, _ in made.get(name, []))
    assert (total("millrace.items.processed"), total("millrace.items.failed"), total("millrace.calls")) == (40, 4, 40)
    assert total("millrace.retries") == 10 and len(made["millrace.latency"]) == 40
    assert {a for values in made.values() for _, a in values} == {"m"}

    spark.range(40).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = FnSource(lambda s: s.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    made = meters_of(Pipeline(name="m").source(stream).sink(FileSink(str(tmp_path / "so"))), lambda p: p.stream(spark, str(tmp_path / "cp")).start().wait(120))
    end = time.monotonic() + 30
    while time.monotonic() < end and total("millrace.items.processed") < 40:
        time.sleep(0.1)
    assert (total("millrace.items.processed"), total("millrace.items.failed")) == (40, 4) and len(made["millrace.items.processed"]) == 2


def test_a_host_stops_a_stream_with_grace(spark, tmp_path):
    from millrace.plans.pipeline import Pipeline
    from millrace.sources.readers import FnSource
    from millrace.sources.sinks import FileSink, FnSink

    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = FnSource(lambda s: s.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    run = Pipeline().source(source).keyed("id").sink(FileSink(str(tmp_path / "o"))).stream(spark, str(tmp_path / "cp"), processingTime="50 milliseconds").start()
    run.stop(60)
    assert run.state == "Completed" and spark.read.parquet(str(tmp_path / "o")).count() == 30
    slow = Pipeline().source(source).keyed("id").sink(FnSink(lambda d: time.sleep(5))).stream(spark, str(tmp_path / "cp2"), processingTime="50 milliseconds").start()
    began = time.monotonic()
    slow.stop(0.5)
    assert slow.state == "Cancelled" and time.monotonic() - began < 30


def test_a_backlog_is_taken_by_shares_and_manifests_are_read_once(tmp_path):
    from millrace.sources.pages import _Stream

    (tmp_path / "_manifests").mkdir()
    for n in range(5):
        (tmp_path / "_manifests" / f"{n}.json").write_text(json.dumps([f"page-{n}-{i:04d}.json" for i in range(1000)]))
    stream = _Stream({"path": str(tmp_path), "pages": "2", "share": "0.03"}, ["k"])
    read, get = [], stream.place.get
    stream.place.get = lambda name: read.append(name) or get(name)
    at, names, batches = 0, [], 0
    while (end := stream.latestOffset()["page"]) > at:
        assert end - at >= min(2, 5000 - at)
        names += [x.name for x in stream.partitions({"page": at}, {"page": end})]
        at, batches = end, batches + 1
    assert names == [f"page-{n}-{i:04d}.json" for n in range(5) for i in range(1000)]
    assert batches < 250 and len(read) == 5
