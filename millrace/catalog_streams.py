"""Registered queries of event-time state, tables that outlive batches, exactly-once writes, range joins and damaged inputs."""

from __future__ import annotations

import sqlite3
import threading
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import EVENTS, ORACLE_SQL, SQL, query, table
from millrace.catalog_io import _batches
from millrace.operators import resilience
from millrace.operators.intervals import interval_pairs, interval_sums
from millrace.operators.resilience import Attempted, RetryPolicy
from millrace.operators.transforms import Validation
from millrace.plans import envelope
from millrace.plans.pipeline import Pipeline
from millrace.plans.storage import workspace
from millrace.sources.isolated import FAILURE, IsolatedFiles
from millrace.sources.json_arrays import JsonArraySource
from millrace.sources.pages import Pages
from millrace.sources.readers import FnSource, JdbcSource
from millrace.sources.sinks import DbApiSink, FileSink, JsonSink, LedgerSink
from millrace.streaming import metrics, runner, state
from millrace.streaming.retries import RetryTable
from millrace.streaming.sampling import StreamSample

#: Events arrive up to six hours after their time, in four files; every 97th comes with the last file, however old it is.
_LAST = 3
_ARRIVAL = f"""
b AS (SELECT min(ts) AS t0, max(ts) AS t1 FROM events),
a AS (SELECT e.*, CASE WHEN event_id % 97 = 0 THEN {_LAST} ELSE CAST(least({_LAST}, floor(({{seconds}}(ts - t0) + event_id % 7 * 3600) * {_LAST + 1} / ({{seconds}}(t1 - t0) + 21601))) AS INTEGER) END AS f FROM events e, b)"""


@query(f"""WITH {_ARRIVAL.replace("{seconds}", "epoch")},
w AS (SELECT max(ts) - INTERVAL 8 HOUR AS late FROM a WHERE f < {_LAST - 1}),
k AS (SELECT event_id, user_id, ts, value FROM a, w WHERE (f < {_LAST} OR ts > late) AND ts <= (SELECT max(ts) - INTERVAL 8 HOUR FROM a)),
g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 24 HOUR AS fresh FROM k),
s AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM g)
SELECT user_id, event_id, count(*) OVER o AS n, round(sum(value) OVER o, 6) AS total FROM s WINDOW o AS (PARTITION BY user_id, part ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def stream_ordered_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events out of order and late ones: running count and sum of each user's visit, which a day without events ends.

    What is late for a batch goes by the watermark of the batch before it.
    """
    events = table(sf_dir, "events").read(spark)
    ends = events.select(F.unix_micros(F.min(F.col("ts").cast("timestamp"))).alias("t0"), F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("t1"))
    seconds = lambda x: x / 1_000_000
    placed = (seconds(F.unix_micros(F.col("ts").cast("timestamp")) - F.col("t0")) + F.col("event_id") % 7 * 3600) * (_LAST + 1) / (seconds(F.col("t1") - F.col("t0")) + 21601)
    file = F.when(F.col("event_id") % 97 == 0, _LAST).otherwise(F.least(F.lit(_LAST), F.floor(placed)).cast("int"))
    at = workspace(spark, "arrivals")
    for i in range(_LAST + 1):
        events.join(ends).where(file == i).select(*events.columns).coalesce(1).write.mode("append").parquet(at)
        time.sleep(0.01)  # a stream takes files by their time
    arrivals = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(at)
    step = lambda s, event, x: ((s[0] + 1, s[1] + x), (event, s[0] + 1, s[1] + x))
    columns = {"event": F.col("event_id"), "x": F.coalesce("value", F.lit(0.0))}
    df = state.ordered_fold(arrivals, "user_id", "ts", "8 hours", ["event_id"], columns, "n long, total double", lambda: (0, 0.0), step, "event_id long, n long, total double", 86400.0)
    out = workspace(spark, "out")
    with state.rocksdb(spark):
        run = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", workspace(spark, "marks")).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(df.schema).parquet(out).select("user_id", "event_id", "n", F.round("total", 6).alias("total"))


_NULLED = "CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END"


@query(f"SELECT DISTINCT {_NULLED} AS user_id FROM events WHERE event_id % 4 < 3 UNION ALL SELECT DISTINCT {_NULLED} FROM events WHERE event_id % 4 = 3")
def stream_dedup_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, a fifth of them null, are admitted once over three batches, each of which runs twice; all are given back before the last."""
    events = table(sf_dir, "events").read(spark).withColumn("user_id", F.expr(_NULLED))
    seen, out = runner.DedupSet(workspace(spark, "seen"), ["user_id"]), workspace(spark, "out")
    for n in range(3):
        for _ in range(2):
            seen.admit(events.where(F.col("event_id") % 4 == n), n).select("user_id").write.mode("overwrite").parquet(f"{out}/batch={n}")
    seen.remove(events, 3)
    seen.admit(events.where("event_id % 4 = 3"), 4).select("user_id").write.parquet(f"{out}/batch=4")
    return spark.read.parquet(out).select("user_id")


@query("SELECT event_id, CAST(event_id % 3 + 1 AS INTEGER) AS attempt, event_id % 3 < 2 AS is_success FROM events")
def stream_retry_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose trace ids are null or repeat fail event_id mod 3 times; two retries wait in a table, the last fails for good."""
    held, out = RetryTable(workspace(spark, "retries"), RetryPolicy(2, delay_ms=1, backoff="fixed")), workspace(spark, "out")

    def flaky(df: DataFrame) -> DataFrame:
        stubborn = F.when(F.col("event_id") % 3 == 2, 3).otherwise(F.col("event_id") % 3)
        return envelope.fail_where(df, F.col("attempt") <= stubborn, envelope.error("later", envelope.TRANSIENT))

    wrap = lambda df: envelope.wrap(df, F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 10))
    events = table(sf_dir, "events").read(spark).select("event_id")
    for n in range(3):
        done = held.run(events if n == 0 else events.limit(0), n, flaky, wrap)
        done.select("event_id", "attempt", envelope.ok().alias("is_success")).write.parquet(f"{out}/batch={n}")
        time.sleep(0.05)
    return spark.read.parquet(out).select("event_id", "attempt", "is_success")


@query("SELECT event_id, user_id, value FROM events")
def stream_jdbc_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four micro-batches to a database, each run twice, as after a failure: every row is there once. (The database is
    embedded in the driver, and loads and unloads files of the shared folder.)"""
    _, arrivals = _batches(spark, sf_dir)
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    url, files = f"jdbc:derby:{workspace(spark, 'derby').removeprefix('file://')};create=true", workspace(spark, "files")
    sink = LedgerSink(url, "events", "events", driver, through=files)

    def twice(batch: DataFrame, n: int) -> None:
        for _ in range(2):
            sink.write_batch(envelope.wrap(batch.select("event_id", "user_id", "value"), "event_id"), n)

    arrivals.writeStream.foreachBatch(twice).option("checkpointLocation", workspace(spark, "marks")).trigger(availableNow=True).start().awaitTermination()
    return JdbcSource(url, 'SELECT "event_id", "user_id", "value" FROM "events"', options=driver, through=files).read(spark)


@query(SQL["sql_range_join"][0])
def interval_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of the same user lie in the day before each event, without pairs."""
    events = table(sf_dir, "events").read(spark).select("event_id", "user_id", "ts")
    return interval_sums(events, events.select("user_id", "ts"), ["user_id"], ["event_id"], "ts", "ts", 86400, count="near").select("event_id", "near")


@query("SELECT e.event_id, p.event_id AS purchase_id FROM events e JOIN events p ON e.user_id = p.user_id AND e.event_type = 'error' AND p.event_type = 'purchase' AND p.ts BETWEEN e.ts - INTERVAL 2 HOUR AND e.ts + INTERVAL 30 MINUTE")
def interval_join_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of a user around each of their errors, joined by bins of time."""
    events = table(sf_dir, "events").read(spark)
    of = lambda kind: events.where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    return interval_pairs(of("error"), of("purchase"), ["user_id"], "ts", "ts", 7200, 1800).select("event_id", F.col("right_event_id").alias("purchase_id"))


@query("""SELECT event_id, count(*) OVER w AS window_total, count(*) FILTER (WHERE event_type = 'error') OVER w AS window_failures, round((count(*) FILTER (WHERE event_type = 'error') OVER w) / (count(*) OVER w)::DOUBLE, 9) AS failure_ratio
FROM events WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)""")
def failure_ratio_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failure ratio of the last six hours over all events: no key, and no task that gets them all."""
    df = table(sf_dir, "events").read(spark).withColumn("ok", F.col("event_type") != "error")
    out = resilience.failure_ratio(df, "ok", "ts", 6 * 3600, row_key=("event_id",))
    return out.select("event_id", "window_total", "window_failures", F.round("failure_ratio", 9).alias("failure_ratio"))


@query("SELECT o_orderkey, o_totalprice, false AS failed FROM orders UNION ALL SELECT NULL, NULL, true")
def damaged_file_is_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as Parquet beside one file that isn't Parquet: all rows, and one recorded failure."""
    at = workspace(spark, "mixed")
    table(sf_dir, "orders").read(spark).repartition(4, "o_orderkey").write.parquet(f"{at}/good")
    table(sf_dir, "region").read(spark).select("r_name").coalesce(1).write.text(f"{at}/bad")
    rows = IsolatedFiles(at, "o_orderkey long, o_totalprice double").read(spark)
    return rows.select("o_orderkey", "o_totalprice", F.col(FAILURE).isNotNull().alias("failed"))


@query("SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT NULL, NULL")
def damaged_lines_are_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON lines with one line that isn't an object, as envelopes; the failure is the row without a key."""
    at = workspace(spark, "lines")
    JsonSink(f"{at}/good").write(envelope.wrap(table(sf_dir, "customer").read(spark).select("c_custkey", "c_acctbal"), "c_custkey"))
    table(sf_dir, "region").read(spark).where("r_regionkey = 0").select("r_name").coalesce(1).write.text(f"{at}/bad")
    return IsolatedFiles(at, "c_custkey long, c_acctbal double", "json").enveloped(spark, "c_custkey").select("c_custkey", "c_acctbal")


@query("SELECT n_nationkey, n_nationkey % 10 <> 4 AS is_success, CASE WHEN n_nationkey % 10 = 4 THEN 'Timed out after 0.4s' END AS message FROM nation")
def attempt_is_killed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that never come back are killed with their process; the rows after them go on."""

    def fn(row: dict, attempt: int) -> dict:
        while row["n_nationkey"] % 10 == 4:
            pass
        return {}

    df = envelope.wrap(table(sf_dir, "nation").read(spark), "n_nationkey").coalesce(1)
    done = Attempted(fn, RetryPolicy(1, retry_on=lambda _: False), timeout_s=0.4, isolate=True).apply(df)
    return done.select("n_nationkey", envelope.ok().alias("is_success"), "_error.message")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as committed pages by a streaming writer, then read by a stream that stops and resumes: two pages at a time,
    or three in a hundred of those that wait, if that is more."""
    spark.dataSource.register(Pages)
    feed, out, marks = workspace(spark, "feed"), workspace(spark, "out"), workspace(spark, "marks")
    _, arrivals = _batches(spark, sf_dir)
    rows = arrivals.select("event_id", "user_id", "event_type")
    rows.writeStream.format("millrace_pages").option("path", feed).option("rows", 2000).option("checkpointLocation", workspace(spark, "written")).trigger(availableNow=True).start().awaitTermination()
    schema = "event_id long, user_id long, event_type string"
    pages = spark.readStream.format("millrace_pages").schema(schema).option("pages", 2).option("share", 0.03).load(feed)

    first = runner.StreamRun(envelope.wrap(pages, "event_id"), [FileSink(out)], marks, processingTime="0 seconds").start()
    while not first.query.recentProgress:
        time.sleep(0.05)
    first.pause()  # between any two batches
    first.resume()
    first.drain()
    return spark.read.parquet(out).select("event_id", "user_id", "event_type")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def json_array_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON arrays, read in ranges much smaller than the files."""
    at = workspace(spark, "array")
    rows = table(sf_dir, "orders").read(spark).select("o_orderkey", "o_custkey", "o_totalprice")
    body = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*rows.columns))), ",\n"), F.lit("]"))
    part = F.floor(F.col("o_orderkey") / 5000)  # orders of an array
    rows.groupBy(part.alias("array")).agg(body.alias("value")).repartition(2, "array").select("value").write.text(at)
    return JsonArraySource(at, "o_orderkey long, o_custkey long, o_totalprice double", 20_000).read(spark)


@query(ORACLE_SQL["reservoir_by_group"])
def stream_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty events of each type by the smallest hashes, gathered over four micro-batches that each run twice."""
    _, arrivals = _batches(spark, sf_dir)
    sample = StreamSample(workspace(spark, "sample"), "event_id", 20, ["event_type"])

    def twice(batch: DataFrame, n: int) -> None:
        for _ in range(2):
            sample.add(batch, n)

    arrivals.writeStream.foreachBatch(twice).option("checkpointLocation", workspace(spark, "marks")).trigger(availableNow=True).start().awaitTermination()
    return sample.rows(spark).select("event_type", "event_id")


@query("SELECT count(*) AS counted, true AS ordered, 'Open' AS breaker, count(*) FILTER (WHERE s_suppkey % 10 > 4) > 0 AS some_refused FROM supplier")
def running_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run counts its latencies by buckets; a dashboard gets p99 and the breaker's state from its figures."""

    def fails(row: dict, attempt: int) -> dict:
        raise ConnectionError("down")

    p = Pipeline().source(table(sf_dir, "supplier")).keyed("s_suppkey").attempt(fails, policy=RetryPolicy(1, retry_on=lambda _: False), timed=True, breaker={"least": 2, "break_s": 3600})
    out = p.to(spark, FileSink(workspace(spark, "out"))).figures
    board = metrics.dashboard("Completed", out)
    ordered = 0 < out["p50_latency_ms"] <= out["p95_latency_ms"] <= board["p99_latency_ms"]
    return spark.createDataFrame([(out["items_processed"], ordered, board["circuit_breaker"], out["items_refused"] > 0)], "counted long, ordered boolean, breaker string, some_refused boolean")


@query("SELECT CAST(event_id % 4 AS BIGINT) AS batch, count(*) AS items_processed, count(*) FILTER (WHERE event_type = 'error') AS items_failed FROM events GROUP BY 1")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each micro-batch's own figures, as a listener gets them."""
    _, arrivals = _batches(spark, sf_dir)
    seen: list[dict] = []
    all_in = threading.Event()

    def note(figures: dict) -> None:
        seen.append(figures)
        if len([f for f in seen if f["items_processed"]]) == 4:
            all_in.set()

    p = Pipeline().source(FnSource(lambda s: arrivals)).keyed("event_id").transform(Validation().require(F.col("event_type") != "error", "error"))
    p.options(on_metrics=note).sink(FileSink(workspace(spark, "out"))).stream(spark, workspace(spark, "marks")).start().wait()
    all_in.wait(60)  # listeners hear of a batch a little later
    rows = [(f["batch"], f["items_processed"], f["items_failed"]) for f in seen if f["items_processed"]]
    return spark.createDataFrame(rows, "batch long, items_processed long, items_failed long")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def db_api_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers from several tasks into a database file by its DB-API module, read back by one task. (One machine: the file is local.)"""
    at = f"{workspace(spark, 'sqlite').removeprefix('file://')}.db"
    rows = envelope.wrap(table(sf_dir, "customer").read(spark).select("c_custkey", "c_acctbal"), "c_custkey")
    spark.createDataFrame([(0,)], "x int").write.parquet(at.rpartition("/")[0] + "/made")  # makes the folder
    with sqlite3.connect(at) as link:
        link.execute("CREATE TABLE customers (c_custkey INTEGER, c_acctbal REAL)")

    def connect() -> sqlite3.Connection:
        return sqlite3.connect(at, timeout=120)

    DbApiSink(connect, table="customers").write(envelope.fail_where(rows, ~(F.col("c_acctbal") > 0), envelope.error("in debt")).repartition(3))

    def read(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with sqlite3.connect(at) as link:
            cursor = link.execute("SELECT c_custkey, c_acctbal FROM customers")
            while part := cursor.fetchmany(10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.int64(), pa.float64()))], ["c_custkey", "c_acctbal"])

    return spark.range(0, 1, 1, 1).mapInArrow(read, "c_custkey long, c_acctbal double")
