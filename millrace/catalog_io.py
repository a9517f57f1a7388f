"""Registered queries of sources, sinks, failure handling, streams' lives and user functions: each does its work (writes,
reads back, runs) and returns rows that DuckDB answers alike."""

from __future__ import annotations

import http.server
import json
import threading
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import EVENTS, _settled, query, start, table
from millrace.functions import user
from millrace.operators import resilience
from millrace.operators.resilience import Attempted, RetryPolicy
from millrace.operators.udf import spread
from millrace.operators.transforms import Filter, Guarded, Middleware, Validation
from millrace.plans import envelope
from millrace.plans.pipeline import Pipeline
from millrace.plans.storage import workspace
from millrace.sources.http import HttpSink, HttpSource
from millrace.sources.readers import Concat, CsvSource, DeadLetterSource, FnSource, JdbcSource, JsonSource, ParquetSource
from millrace.sources.sinks import CsvSink, DeadLetterSink, FileSink, JdbcSink, JsonSink, fan_out
from millrace.streaming import metrics, runner

# Sources and sinks

_SUPPLIERS = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0"
_SUPPLIER_DDL = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Filter(F.col("s_acctbal") > 0).apply(start(spark, sf_dir, "supplier", "s_suppkey"))


@query(_SUPPLIERS)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = workspace(spark, "csv")
    CsvSink(at, ";").write(_suppliers(spark, sf_dir))
    return CsvSource(at, _SUPPLIER_DDL, ";").read(spark)


@query(_SUPPLIERS)
def json_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = workspace(spark, "json")
    JsonSink(at).write(_suppliers(spark, sf_dir))
    return JsonSource(at, _SUPPLIER_DDL).read(spark)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_array_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = workspace(spark, "array")
    JsonSink(at, as_array=True).write(start(spark, sf_dir, "nation", "n_nationkey"))
    return JsonSource(at, "n_nationkey int, n_name string, n_regionkey int").read(spark)


@query("SELECT s_suppkey, s_name FROM supplier")
def partitioned_file_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = workspace(spark, "orc")
    FileSink(at, "orc", partition_by=("s_nationkey",)).write(start(spark, sf_dir, "supplier", "s_suppkey"))
    return spark.read.orc(at).select("s_suppkey", "s_name")


@query(_SUPPLIERS)
def jdbc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a database embedded in the driver, which loads and unloads files of the shared folder: tasks can't open it."""
    url = f"jdbc:derby:{workspace(spark, 'derby').removeprefix('file://')};create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    files = workspace(spark, "files")
    JdbcSink(url, "suppliers", "overwrite", driver, through=files).write(_suppliers(spark, sf_dir))
    names = ", ".join(f'"{x.split()[0]}"' for x in _SUPPLIER_DDL.split(", "))
    rows = JdbcSource(url, f"SELECT {names} FROM suppliers", options=driver, through=files).read(spark)
    return rows.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in _SUPPLIER_DDL.split(", ")])


class _Server:
    """Gives pages of rows by GET and keeps what is posted."""

    def __init__(self, pages: dict[str, list[dict]]) -> None:
        self.posts: list[dict] = []
        me = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def _send(self, code: int, body: bytes = b"") -> None:
                self.send_response(code)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def do_GET(self) -> None:
                self._send(200, json.dumps(pages[self.path]).encode()) if self.path in pages else self._send(404)

            def do_POST(self) -> None:
                me.posts.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
                self._send(200)

            def log_message(self, *args: object) -> None: ...

        self._http = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self._http.server_port}"
        threading.Thread(target=self._http.serve_forever, daemon=True).start()


@query("SELECT n_nationkey, n_name FROM nation")
def http_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a loopback server, one a partition; names in another case, a null among the rows."""
    rows = [{"N_NationKey": r.n_nationkey, "N_NAME": r.n_name} for r in table(sf_dir, "nation").read(spark).collect()]
    server = _Server({f"/{i}": [None, *rows[i::4]] for i in range(4)})
    return HttpSource(tuple(f"{server.url}/{i}" for i in range(4)), "n_nationkey int, n_name string").read(spark)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0")
def http_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    server = _Server({})
    df = Filter(F.col("n_nationkey") % 2 == 0).apply(start(spark, sf_dir, "nation", "n_nationkey"))
    HttpSink(server.url, check_status=True).write(df.drop("n_regionkey"))
    return spark.createDataFrame([(p["n_nationkey"], p["n_name"]) for p in server.posts], "n_nationkey int, n_name string").distinct()


_BAD_ORDERS = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 10000"


@query(_BAD_ORDERS)
def dead_letter_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures to JSON lines and back under names in another case."""
    at = workspace(spark, "dead")
    df = Validation().require(F.col("o_totalprice") >= 10000, "too small").apply(start(spark, sf_dir, "orders", "o_orderkey"))
    DeadLetterSink(at).write(Filter(F.col("o_orderstatus") != "P").apply(df))
    return DeadLetterSource(at, "O_ORDERKEY long, O_TotalPrice double").read(spark).toDF("o_orderkey", "o_totalprice")


@query("SELECT 0 AS ord, count(*) AS n FROM region UNION ALL SELECT 2, count(*) FROM nation")
def failing_source_is_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = Concat((table(sf_dir, "region"), ParquetSource(f"{sf_dir}/no_such_table.parquet"), table(sf_dir, "nation")), "ord", skip_failing=True)
    return parts.read(spark).groupBy("ord").agg(F.count("*").alias("n"))


class _Evens:
    """A source of one's own: orders with even keys."""

    def __init__(self, sf_dir: str) -> None:
        self.sf_dir = sf_dir

    def read(self, spark: SparkSession) -> DataFrame:
        return table(self.sf_dir, "orders").read(spark).where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"))


class _Totals:
    """A sink of one's own."""

    def __init__(self) -> None:
        self.total = 0

    def write(self, df: DataFrame) -> None:
        self.total = envelope.succeeded(df).agg(F.sum("k")).first()[0]


@query("SELECT CAST(sum(o_orderkey) AS BIGINT) AS total, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0")
def own_source_and_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink = _Totals()
    out = Pipeline().source(_Evens(sf_dir)).keyed("k").transform(Middleware({})).to(spark, sink)
    return spark.createDataFrame([(sink.total, out.figures["items_processed"])], "total long, n long")


@query("SELECT r_regionkey, upper(r_name) AS r_name FROM region")
def function_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = FnSource(lambda s: s.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", F.upper("r_name").alias("r_name")))
    return envelope.succeeded(Pipeline().source(source).keyed("r_regionkey").plan(spark))


# Pipelines: options, figures, single rows, background, time limits


def _lines(sf_dir: str) -> Pipeline:
    return Pipeline(name="lines").source(table(sf_dir, "lineitem")).keyed("l_orderkey").transform(Validation().require(F.col("l_quantity") <= 45, "qty>45"), Filter(F.col("l_tax") < 0.08))


_LINE_COUNTS = {"items_processed": "count(*)", "items_succeeded": "count(*) FILTER (WHERE l_quantity <= 45 AND l_tax < 0.08)", "items_failed": "count(*) FILTER (WHERE l_quantity > 45)", "items_filtered": "count(*) FILTER (WHERE l_quantity <= 45 AND l_tax >= 0.08)"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS figure, {v} AS n FROM lineitem" for k, v in _LINE_COUNTS.items()))
def background_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline in the background; its figures when it is done."""
    out = _lines(sf_dir).sink(FileSink(workspace(spark, "background"))).run_background(spark).result()
    return spark.createDataFrame([(k, out.figures[k]) for k in _LINE_COUNTS], "figure string, n long")


@query("SELECT (SELECT count(*) FROM customer) AS items_processed, (SELECT count(*) FROM customer) AS duplicates_filtered, CAST((SELECT count(*) FROM customer WHERE c_custkey % 3 > 0) AS BIGINT) AS retries, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 2) AS items_failed, 1 AS sources_failed")
def pipeline_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources alike and one that isn't there; customers fail custkey mod 3 times, one retry is allowed by the options."""

    def flaky(row: dict, attempt: int) -> dict:
        if attempt <= row["c_custkey"] % 3:
            raise ConnectionError("later")
        return {}

    customers = table(sf_dir, "customer")
    p = Pipeline().source(customers).source(customers).source(ParquetSource(f"{sf_dir}/no_such_table.parquet")).keyed("c_custkey").attempt(flaky)
    out = p.options(retry=RetryPolicy(1), dedup_keys=("c_custkey",)).to(spark, FileSink(workspace(spark, "figures"))).figures
    return spark.createDataFrame([(out["items_processed"], out["duplicates_filtered"], out["retries"], out["items_failed"], out["sources_failed"])], "items_processed long, duplicates_filtered long, retries long, items_failed long, sources_failed int")


@query("SELECT r_regionkey, r_regionkey <> 3 AS is_success, CASE WHEN r_regionkey <> 3 THEN lower(r_name) END AS r_name, CASE WHEN r_regionkey = 3 THEN 'not three' END AS message FROM region")
def process_one_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline().keyed("r_regionkey").transform(Validation().require(F.col("r_regionkey") != 3, "not three"), Middleware({"r_name": F.lower("r_name")}))
    rows = []
    for r in table(sf_dir, "region").read(spark).collect():
        one = p.process_one(spark, r.asDict(), "r_regionkey int, r_name string")
        rows.append((r.r_regionkey, one["is_success"], one["value"] and one["value"]["r_name"], one["error"] and one["error"]["message"]))
    return spark.createDataFrame(rows, "r_regionkey int, is_success boolean, r_name string, message string")


@query("SELECT 'Faulted' AS state")
def total_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    def slow(row: dict, attempt: int) -> dict:
        time.sleep(1)
        return {}

    p = Pipeline().source(FnSource(lambda s: table(sf_dir, "orders").read(s).repartition(4))).attempt(slow).options(total_timeout_s=1.5)
    return spark.createDataFrame([(p.to(spark, FileSink(workspace(spark, "late"))).state,)], "state string")


@query("SELECT 'plan' AS name, CAST(NULL AS VARCHAR) AS sink, false AS failed UNION ALL SELECT 'sink', 'FileSink', false")
def run_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans: list[dict] = []
    _lines(sf_dir).options(on_span=spans.append).to(spark, FileSink(workspace(spark, "spans")))
    return spark.createDataFrame([(s["name"], s.get("sink"), s["error"] is not None) for s in spans], "name string, sink string, failed boolean")


@query("SELECT 'Healthy' AS live, 'Unhealthy' AS paused, 'Running' AS state, 'N/A' AS breaker, CAST(count(*) AS BIGINT) AS current, 'millrace_items_failed ' || count(*) FILTER (WHERE l_quantity > 45) AS line FROM lineitem")
def health_and_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = _lines(sf_dir).to(spark, FileSink(workspace(spark, "health"))).figures
    board = metrics.dashboard("Running", json.loads(metrics.to_json(figures)))
    line = metrics.to_prometheus(figures).split("\n")[2]
    row = (metrics.liveness(False), metrics.liveness(True), board["state"], board["circuit_breaker"], board["current"], line)
    return spark.createDataFrame([row], "live string, paused string, state string, breaker string, current long, line string")


# Failure handling

_KINDS = "CASE CAST(s_suppkey % 5 AS INTEGER) WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN {} WHEN 3 THEN {} END"


@query(f"SELECT s_suppkey, {_KINDS.format(*(repr(x) for x in ('Transient', 'Transient', 'Permanent', 'Transient')))} AS type, {_KINDS.format(*(repr(x) for x in ('Timeout', 'IO', 'TransformError', 'IO')))} AS category, {_KINDS.format(*(repr(x) for x in ('TimeoutError', 'ConnectionError', 'ValueError', 'OSError')))} AS exception FROM supplier")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fn(row: dict, attempt: int) -> dict:
        kinds = {0: TimeoutError("t"), 1: ConnectionError("c"), 2: ValueError("v"), 3: OSError("o")}
        if row["s_suppkey"] % 5 in kinds:
            raise kinds[row["s_suppkey"] % 5]
        return {}

    done = Attempted(fn, RetryPolicy(1)).apply(start(spark, sf_dir, "supplier", "s_suppkey"))
    return done.select("s_suppkey", "_error.type", "_error.category", "_error.exception")


@query("SELECT n_nationkey, n_nationkey % 10 <> 4 AS is_success, CASE WHEN n_nationkey % 10 = 4 THEN 'Timed out after 0.4s' END AS message FROM nation")
def attempt_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slow rows between good ones: only the slow ones fail."""

    def fn(row: dict, attempt: int) -> dict:
        if row["n_nationkey"] % 10 == 4:
            time.sleep(1.5)
        return {}

    df = start(spark, sf_dir, "nation", "n_nationkey").coalesce(1)
    done = Attempted(fn, RetryPolicy(1, retry_on=lambda _: False), timeout_s=0.4).apply(df)
    return done.select("n_nationkey", envelope.ok().alias("is_success"), "_error.message")


@query("SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 4 = 3 THEN 1 ELSE least(s_suppkey % 4 + 1, CASE WHEN s_suppkey % 2 = 0 THEN 4 ELSE 2 END) END AS INTEGER) AS attempts, s_suppkey % 4 <> 3 AND s_suppkey % 4 <= CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 1 END AS is_success FROM supplier")
def own_retry_rule_and_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """retry_on decides by the message; every second row has a budget of its own."""

    def fn(row: dict, attempt: int) -> dict:
        if row["s_suppkey"] % 4 == 3:
            raise ValueError("hopeless")
        if attempt <= row["s_suppkey"] % 4:
            raise ValueError("again")
        return {}

    df = start(spark, sf_dir, "supplier", "s_suppkey").withColumn("most", F.when(F.col("s_suppkey") % 2 == 0, -1).otherwise(1))
    done = Attempted(fn, RetryPolicy(3, retry_on=lambda e: e["message"] == "again"), budget_col="most").apply(df)
    return done.select("s_suppkey", "attempts", envelope.ok().alias("is_success"))


@query("SELECT true AS within, true AS varied")
def retry_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(sf_dir, "lineitem").read(spark).select(resilience.jittered(F.lit(100.0), 7).alias("d"))
    return d.agg(F.every((F.col("d") >= 75) & (F.col("d") <= 100)).alias("within"), (F.count_distinct("d") > 50).alias("varied"))


@query("SELECT n_nationkey, n_regionkey <> 2 AS is_success, CASE WHEN n_regionkey = 2 THEN 'CircuitBreaker' END AS category, CASE WHEN n_regionkey <> 2 THEN lower(n_name) ELSE n_name END AS n_name FROM nation")
def guarded_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = Guarded(Middleware({"n_name": F.lower("n_name")}), F.col("n_regionkey") == 2).apply(start(spark, sf_dir, "nation", "n_nationkey"))
    return done.select("n_nationkey", envelope.ok().alias("is_success"), "_error.category", "n_name")


@query("SELECT CAST(5 AS BIGINT) AS called, count(*) - 5 AS refused FROM customer")
def breaker_in_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls fail: one task's breaker opens at its least throughput and refuses the rest."""

    def bad(row: dict, attempt: int) -> dict:
        raise ValueError("no")

    df = start(spark, sf_dir, "customer", "c_custkey").coalesce(1)
    done = Attempted(bad, RetryPolicy(1), breaker={"least": 5, "failure_ratio": 0.7, "break_s": 3600}).apply(df)
    return done.agg(F.count_if(F.col("attempts") > 0).alias("called"), F.count_if(F.col("_error.category") == "CircuitBreaker").alias("refused"))


# Streams


def _batches(spark: SparkSession, sf_dir: str, n: int = 4) -> tuple[str, DataFrame]:
    """The events in n files, which a stream takes one at a time; event_id mod n tells the file."""
    at = workspace(spark, "arrivals")
    events = table(sf_dir, "events").read(spark)
    for i in range(n):
        events.where(F.col("event_id") % n == i).coalesce(1).write.mode("append").parquet(at)
    return at, spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(at)


@query("SELECT CASE WHEN event_type = 'error' THEN 'dead' ELSE 'out' END AS place, count(*) AS n FROM events GROUP BY 1")
def stream_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several micro-batches to a file sink and to dead letters; all of them stay."""
    _, arrivals = _batches(spark, sf_dir)
    out, dead = workspace(spark, "out"), workspace(spark, "dead")
    p = Pipeline().source(FnSource(lambda s: arrivals)).keyed("event_id").transform(Validation().require(F.col("event_type") != "error", "error"))
    p.options(dead_letter=DeadLetterSink(dead)).sink(FileSink(out)).stream(spark, workspace(spark, "marks")).start().wait()
    good, bad = spark.read.parquet(out).select(F.lit("out").alias("place")), spark.read.json(dead).select(F.lit("dead").alias("place"))
    return good.unionByName(bad).groupBy("place").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events")
def stream_batch_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each micro-batch is written twice, as after a failure: it replaces itself."""
    _, arrivals = _batches(spark, sf_dir)
    sink = FileSink(workspace(spark, "out"))

    def twice(batch: DataFrame, n: int) -> None:
        for _ in range(2):
            fan_out(envelope.wrap(batch, "event_id"), [sink], batch=n)

    arrivals.writeStream.foreachBatch(twice).option("checkpointLocation", workspace(spark, "marks")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink.path).select("event_id")


@query("SELECT * FROM (VALUES (1, 'NotStarted', 'Running'), (2, 'Running', 'Paused'), (3, 'Paused', 'Running'), (4, 'Running', 'Completed')) t(step, was, became)")
def stream_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, arrivals = _batches(spark, sf_dir, 2)
    steps: list[tuple[str, str]] = []
    p = Pipeline().source(FnSource(lambda s: arrivals)).keyed("event_id").transform(Middleware({})).options(on_state=lambda a, b: steps.append((a, b)))
    run = p.sink(FileSink(workspace(spark, "out"))).stream(spark, workspace(spark, "marks"), processingTime="100 milliseconds").start()
    run.pause()
    run.resume()
    run.drain()
    return spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(steps)], "step int, was string, became string")


@query("SELECT event_id, CAST(event_id % 3 + 1 AS INTEGER) AS attempt FROM events WHERE event_id % 3 < 2")
def stream_retry_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events fail event_id mod 3 times; one retry is allowed and waits in a table until the next micro-batch."""
    arrivals, out, held, marks = workspace(spark, "arrivals"), workspace(spark, "out"), workspace(spark, "retries"), workspace(spark, "marks")

    spread(table(sf_dir, "events").read(spark)).write.parquet(arrivals)

    def flaky(row: dict, _: int) -> dict:
        if row["attempt"] <= row["event_id"] % 3:
            raise ConnectionError("later")
        return {}

    for n in range(2):
        if n:  # a file without rows: the next batch
            table(sf_dir, "events").read(spark).limit(0).coalesce(1).write.mode("append").parquet(arrivals)
            time.sleep(0.05)
        source = FnSource(lambda s: s.readStream.schema(EVENTS).parquet(arrivals))
        p = Pipeline().source(source).keyed("event_id").attempt(flaky, policy=RetryPolicy(1, retry_on=lambda _: False))
        p = p.options(retry=RetryPolicy(1, delay_ms=1), retry_table=held).sink(FileSink(out))
        p.stream(spark, marks).start().wait()
    return spark.read.parquet(out).select("event_id", "attempt")


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are admitted once over all micro-batches."""
    _, arrivals = _batches(spark, sf_dir)
    seen, out = runner.DedupSet(workspace(spark, "seen"), ["user_id"]), workspace(spark, "out")
    write = lambda batch, n: seen.admit(batch, n).select("user_id").write.mode("overwrite").parquet(f"{out}/batch_id={n}")
    arrivals.writeStream.foreachBatch(write).option("checkpointLocation", workspace(spark, "marks")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("user_id")


@query("SELECT e.event_id, p.event_id AS purchase_id FROM events e JOIN events p ON e.user_id = p.user_id AND e.event_type = 'error' AND p.event_type = 'purchase' AND p.ts BETWEEN e.ts - INTERVAL 2 HOUR AND e.ts")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of a user in the two hours before each of their errors, both as streams."""
    at = f"{sf_dir}/events.parque[t]"
    read = lambda kind: spark.readStream.schema(EVENTS).parquet(at).where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    joined = runner.interval_join(read("error"), read("purchase"), ["user_id"], "ts", "ts", "1 hour", "2 hours")
    return _settled(joined.select("event_id", F.col("right_event_id").alias("purchase_id")), "append").select("event_id", "purchase_id")


# User functions


class _Spread:
    """Largest less smallest."""

    def zero(self) -> tuple:
        return (float("inf"), float("-inf"))

    def add(self, state: tuple, rows: pd.DataFrame) -> tuple:
        x = rows.iloc[:, 0]
        return self.merge(state, (x.min(), x.max()))

    def merge(self, a: tuple, b: tuple) -> tuple:
        return (min(a[0], b[0]), max(a[1], b[1]))

    def finish(self, state: tuple) -> dict:
        return {"spread": state[1] - state[0]}


@query("SELECT l_returnflag, l_linestatus, max(l_extendedprice) - min(l_extendedprice) AS spread FROM lineitem GROUP BY ALL")
def user_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user.aggregate(table(sf_dir, "lineitem").read(spark), ["l_returnflag", "l_linestatus"], ["l_extendedprice"], _Spread(), "spread double")


def _letters(name: str) -> Iterator[tuple]:
    for i, c in enumerate(name or ""):
        yield i, c


@query("SELECT n_nationkey, CAST(i - 1 AS INTEGER) AS position, n_name[i] AS letter FROM nation, unnest(range(1, len(n_name) + 1)) t(i)")
def user_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    user.register_table_function(spark, "letters_of", _letters, "position int, letter string")
    table(sf_dir, "nation").read(spark).createOrReplaceTempView("nations_lettered")
    return spark.sql("SELECT n_nationkey, position, letter FROM nations_lettered, LATERAL letters_of(n_name)")


@query("SELECT p_partkey, p_size * 2.0::DOUBLE + 1 AS v FROM part")
def user_scalar_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    def line(x: pd.Series) -> pd.Series:
        return x * 2.0 + 1

    return table(sf_dir, "part").read(spark).select("p_partkey", user.scalar(line, "double")("p_size").alias("v"))

