import datetime as dt
import threading
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators.transforms import Filter, Middleware, PythonMiddleware, Validation
from millrace.plans import envelope
from millrace.plans.pipeline import Pipeline
from millrace.sources.readers import FnSource, ParquetSource
from millrace.sources.sinks import DeadLetterSink, FileSink, FnSink
from millrace.streaming import metrics, runner


def numbers(n=10):
    return FnSource(lambda s: s.range(n).withColumn("v", F.col("id") * 1.0))


def base():
    return Pipeline(name="t").source(numbers()).keyed("id").transform(Validation().require(F.col("id") != 3, "no threes"), Filter(F.col("id") < 8), Middleware({"v": F.col("v") + 1}))


def test_all_transforms_run_and_metrics_count(spark, tmp_path):
    states, figures = [], []
    p = base().options(dead_letter=DeadLetterSink(str(tmp_path / "d")), on_state=lambda a, b: states.append((a, b)), on_metrics=figures.append)
    out = p.to(spark, FileSink(str(tmp_path / "o")))
    assert out.state == "Completed"
    assert {k: out.figures[k] for k in ("items_processed", "items_succeeded", "items_failed", "items_filtered")} == {"items_processed": 10, "items_succeeded": 7, "items_failed": 1, "items_filtered": 2}
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [1, 2, 3, 5, 6, 7, 8]
    assert [r.trace_id for r in spark.read.json(str(tmp_path / "d")).collect()] == [3]
    assert states == [("NotStarted", "Running"), ("Running", "Completed")] and figures == [out.figures]


def test_needs_all_parts(spark):
    for p in (Pipeline(), base(), Pipeline().source(numbers()).sink(FnSink(print))):
        with pytest.raises(ValueError):
            p.run(spark)


def test_pipelines_are_immutable():
    p = Pipeline()
    p.source(numbers()).options(capacity=5)
    assert p.sources == () and p.settings.capacity == 1000
    with pytest.raises(ValueError):
        p.options(capacity=0)


def test_dedup_option(spark):
    p = Pipeline().source(numbers(3)).source(numbers(5)).keyed("id").transform(Middleware({})).options(dedup_keys=("id",))
    assert p.plan(spark).count() == 5


def test_fail_fast(spark, tmp_path):
    with pytest.raises(Exception, match="pipeline stopped: no threes"):
        base().options(continue_on_error=False).to(spark, FileSink(str(tmp_path / "o")))


def test_total_timeout(spark, tmp_path):
    def slow(row):
        time.sleep(1)
        return {}

    p = Pipeline().source(numbers(200)).transform(PythonMiddleware(slow)).options(total_timeout_s=2.0)
    began = time.monotonic()
    assert p.to(spark, FileSink(str(tmp_path / "o"))).state == "Faulted"
    assert time.monotonic() - began < 40


def test_process_one_and_rows(spark):
    p = base()
    assert p.process_one(spark, {"id": 1, "v": 1.0}, "id long, v double")["value"]["v"] == 2.0
    assert p.process_one(spark, {"id": 3, "v": 1.0}, "id long, v double")["error"]["message"] == "no threes"
    assert Pipeline().process_one(spark, {"id": 1}, "id long")["is_success"] is False
    assert sum(r.is_success for r in p.rows(spark)) == 7


def test_compact_plan_reaches_the_scan(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id") * 1.0).withColumn("unused", F.lit(1)).write.parquet(str(tmp_path / "p"))
    p = Pipeline().source(ParquetSource(str(tmp_path / "p"))).keyed("id").options(compact=True).transform(Filter(F.col("id") > 97))
    df = p.plan(spark).select("v")
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThan(id,97)" in plan and "unused" not in plan.split("ReadSchema")[-1]


def test_negations_and_rules_reach_the_scan(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else float(i)) for i in range(100)]
    spark.createDataFrame(rows, "id long, v double").write.parquet(str(tmp_path / "p"))
    base = Pipeline().source(ParquetSource(str(tmp_path / "p"))).keyed("id").options(compact=True)
    for keep, pushed, want in (
        (~Filter(F.col("v") > 50), "Or(LessThanOrEqual(v,50.0),IsNull(v))", [i for i, v in rows if not (v is not None and v > 50)]),
        (Validation().require(F.col("v") > 50, "small").require(F.col("id") < 90, "late").to_filter(), "GreaterThan(v,50.0)", [i for i, v in rows if v is not None and v > 50 and i < 90]),
    ):
        df = base.transform(keep).plan(spark)
        assert pushed in df._jdf.queryExecution().toString()
        assert sorted(r.id for r in df.collect()) == want


def test_background(spark, tmp_path):
    base().sink(FileSink(str(tmp_path / "o"))).run_background(spark).join(60)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 7


def test_exports():
    figures = {"items_processed": 5, "items_failed": 1}
    assert metrics.to_prometheus(figures).startswith("millrace_items_processed 5\n")
    assert '"items_failed": 1' in metrics.to_json(figures)
    assert metrics.dashboard("Running", figures)["circuit_breaker"] == "N/A"
    assert metrics.liveness(True) == "Unhealthy" and metrics.liveness(False) == "Healthy"


# Streams

T0 = dt.datetime(2024, 1, 1)


def events(spark, path, rows):
    data = [(k, T0 + dt.timedelta(seconds=s), float(v), ok) for k, s, v, ok in rows]
    spark.createDataFrame(data, "k long, ts timestamp, v double, ok boolean").coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema("k long, ts timestamp, v double, ok boolean").option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


ROWS = [(i % 3, i, 10 + i, i % 4 != 0) for i in range(30)]


def test_stream_dedup(spark, tmp_path):
    events(spark, tmp_path / "e", ROWS)
    df = events(spark, tmp_path / "e", ROWS)
    assert drain(runner.stream_dedup(df, ["k", "ts"], "ts", "1 hour"), "dd").count() == 30


def test_stream_windows(spark, tmp_path):
    df = events(spark, tmp_path / "e", ROWS)
    got = drain(runner.tumbling(df, "ts", "0 seconds", "10 seconds", ["k"], F.count("*").alias("n")), "tw", "complete")
    assert got.count() == 9 and got.agg(F.sum("n")).first()[0] == 30
    got = drain(runner.sessions(df, "ts", "0 seconds", "5 seconds", ["k"], F.count("*").alias("n")), "sw", "complete")
    assert sorted(r.n for r in got.collect()) == [10, 10, 10]


def test_stream_state_equals_batch(spark, tmp_path):
    from millrace.operators import controllers

    rows = ROWS + [(r[0], r[1], r[2] + 3, r[3]) for r in ROWS[:9]]  # ties go by value
    df = events(spark, tmp_path / "e", rows)
    got = {r.k: r for r in drain(runner.stream_ema(df, "k", "ts", "v"), "se", "update").collect()}
    want = {r.k: r for r in controllers.ema(spark.read.parquet(str(tmp_path / "e")).withColumn("w", F.col("v")), "k", ["ts", "w"], "v").collect()}
    assert set(got) == {0, 1, 2}
    for k in got:
        assert got[k].n == 13 and abs(got[k].level - want[k].level) < 1e-9 and abs(got[k].velocity - want[k].velocity) < 1e-9


def test_stream_breaker(spark, tmp_path):
    df = events(spark, tmp_path / "e", [(1, i, 0, False) for i in range(20)])
    got = drain(runner.stream_breaker(df, "k", "ts", "ok", least=5), "sb", "update").first()
    assert got.seen == 20 and got.cb_state == "Open" and got.refused > 0


def test_stream_pipeline_life(spark, tmp_path):
    events(spark, tmp_path / "e", ROWS)
    source = FnSource(lambda s: s.readStream.schema("k long, ts timestamp, v double, ok boolean").parquet(str(tmp_path / "e")))
    states = []
    p = Pipeline().source(source).keyed("k").transform(Filter(F.col("ok"))).options(on_state=lambda a, b: states.append(b))
    p = p.sink(FileSink(str(tmp_path / "o"), mode="append"))
    run = p.stream(spark, str(tmp_path / "cp"), processingTime="200 milliseconds").start()
    settle(run.query)
    run.pause()
    assert run.state == "Paused"
    events(spark, tmp_path / "e", ROWS[:6])
    run.resume()
    run.drain()
    assert run.state == "Completed" and states == ["Running", "Paused", "Running", "Completed"]
    good = sum(r[3] for r in ROWS) + sum(r[3] for r in ROWS[:6])
    assert spark.read.parquet(str(tmp_path / "o")).count() == good
    run.cancel()
    assert run.state == "Cancelled"


def test_settings_are_given_back(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    seen = []
    p = base().options(parallelism=3, capacity=7).sink(FnSink(lambda d: (seen.append([spark.conf.get(k) for k in before]), d.count())))
    p.run(spark)
    with pytest.raises(Exception):
        base().options(parallelism=3).sink(FnSink(lambda d: 1 / 0)).run(spark)
    assert seen == [["3", "7"]] and before == {k: spark.conf.get(k) for k in before}


def test_options_reach_attempts_and_metrics(spark, tmp_path):
    from millrace.operators.resilience import RetryPolicy

    def flaky(row, attempt):
        if row["id"] == 5:
            time.sleep(1)
        if attempt <= row["id"] % 3:
            raise ConnectionError("later")
        return {}

    figures = []
    p = Pipeline().source(numbers(6)).source(numbers(3)).source(ParquetSource("/nowhere/at/all")).keyed("id").attempt(flaky, timed=True)
    p = p.options(retry=RetryPolicy(1), attempt_timeout_s=0.3, dedup_keys=("id",), on_metrics=figures.append)
    out = p.to(spark, FileSink(str(tmp_path / "o"))).figures
    assert out["items_processed"] == 6 and out["duplicates_filtered"] == 3 and out["sources_failed"] == 1
    assert out["items_failed"] == 2 and out["retries"] == 4 and out["avg_latency_ms"] > 0  # 2 and 5 fail, 1 and 4 after a retry don't
    one = p.process_one(spark, {"id": 5, "v": 1.0}, "id long, v double")
    assert one["error"]["message"] == "Timed out after 0.3s" and figures[-1]["items_failed"] == 1


def test_breaker_in_a_task(spark):
    from millrace.operators.resilience import Attempted, RetryPolicy
    from millrace.plans import envelope

    def bad(row, attempt):
        raise ValueError("no")

    df = envelope.wrap(numbers(50).read(spark).coalesce(1), "id")
    rows = Attempted(bad, RetryPolicy(1), breaker={"least": 5}).apply(df).groupBy("_error.category").count().collect()
    got = {r["category"]: r["count"] for r in rows}
    assert got["TransformError"] <= 5 and got["CircuitBreaker"] >= 45


def test_background_outcome_and_error(spark, tmp_path):
    run = base().sink(FileSink(str(tmp_path / "o"))).run_background(spark)
    assert run.result(60).state == "Completed"
    with pytest.raises(ZeroDivisionError):
        base().sink(FnSink(lambda d: 1 / 0)).run_background(spark).result(60)


def test_spans(spark, tmp_path):
    spans = []
    base().options(on_span=spans.append).to(spark, FileSink(str(tmp_path / "o")))
    with pytest.raises(ZeroDivisionError):
        base().options(on_span=spans.append).to(spark, FnSink(lambda d: 1 / 0))
    assert [(s["name"], s["error"] is None) for s in spans] == [("plan", True), ("sink", True), ("plan", True), ("sink", False)]
    assert spans[1]["sink"] == "FileSink" and spans[1]["pipeline"] == "t"


def test_streams_keep_every_batch_once(spark, tmp_path):
    for at in range(3):
        events(spark, tmp_path / "e", ROWS[at * 10 : at * 10 + 10])
    source = FnSource(lambda s: s.readStream.schema("k long, ts timestamp, v double, ok boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e")))
    p = Pipeline().source(source).keyed("k").transform(Validation().require(F.col("ok"), "not ok")).options(dead_letter=DeadLetterSink(str(tmp_path / "d")))
    run = p.sink(FileSink(str(tmp_path / "o"))).stream(spark, str(tmp_path / "cp")).start()
    assert run.wait(120)
    good = sum(r[3] for r in ROWS)
    out = spark.read.parquet(str(tmp_path / "o"))
    assert out.count() == good and out.select("batch_id").distinct().count() == 3
    assert spark.read.json(str(tmp_path / "d")).count() == len(ROWS) - good
    # A batch that is run again replaces itself.
    from millrace.plans import envelope
    from millrace.sources.sinks import fan_out

    again = envelope.wrap(out.where("batch_id = 1").drop("batch_id"), "k").cache()
    again.count()
    for _ in range(2):
        fan_out(again, [FileSink(str(tmp_path / "o"))], batch=1)
    assert spark.read.parquet(str(tmp_path / "o")).count() == good


def test_retry_table(spark, tmp_path):
    from millrace.operators.resilience import RetryPolicy

    spark.range(10).withColumn("v", F.col("id") * 1.0).coalesce(1).write.parquet(str(tmp_path / "e"))
    source = FnSource(lambda s: s.readStream.schema("id long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e")))

    def flaky(row, _):
        if row["attempt"] <= row["id"] % 4:
            raise ConnectionError("later")
        return {"v": row["v"] + 100}

    # The function itself is tried once a batch; the table brings its row back.
    p = Pipeline().source(source).keyed("id").attempt(flaky, policy=RetryPolicy(1, retry_on=lambda _: False))
    p = p.options(retry=RetryPolicy(2, delay_ms=1), retry_table=str(tmp_path / "r"), dead_letter=DeadLetterSink(str(tmp_path / "d"))).sink(FileSink(str(tmp_path / "o")))
    for n in range(4):
        if n:
            spark.createDataFrame([(100 + 4 * n, 0.0)], "id long, v double").write.mode("append").parquet(str(tmp_path / "e"))
            time.sleep(0.05)
        assert p.stream(spark, str(tmp_path / "cp")).start().wait(120)
    out = {r.id: r for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert sorted(out) == [0, 1, 2, 4, 5, 6, 8, 9, 104, 108, 112]
    assert all(r.attempt == r.id % 4 + 1 and r.v == (r.id + 100.0 if r.id < 100 else 100.0) for r in out.values())
    dead = spark.read.json(str(tmp_path / "d")).collect()
    assert sorted(r.trace_id for r in dead) == [3, 7]
    from millrace.streaming.retries import RetryTable

    assert RetryTable(str(tmp_path / "r")).pending(spark).count() == 0


def test_dedup_set_gives_keys_back(spark, tmp_path):
    keys = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "k long, v string")
    seen = runner.DedupSet(str(tmp_path / "s"), ["k"])
    admitted = lambda n, *ids: sorted(r.k for r in seen.admit(keys(*ids), n).collect())
    assert admitted(0, 1, 2, 2, 3) == [1, 2, 3]
    assert admitted(1, 2, 4) == [4]
    assert admitted(1, 2, 4) == [4]  # the same batch again
    seen.remove(keys(2), 2)
    assert admitted(3, 1, 2, 4) == [2]


def test_interval_join(spark, tmp_path):
    left = events(spark, tmp_path / "a", [(1, 10, 1, True), (1, 100, 2, True), (2, 10, 3, True)])
    right = events(spark, tmp_path / "b", [(1, 5, 10, True), (1, 11, 20, True), (1, 95, 30, True), (2, 200, 40, True)])
    got = drain(runner.interval_join(left, right, ["k"], "ts", "ts", "1 minute", "10 seconds"), "ij")
    assert sorted((r.v, r.right_v) for r in got.collect()) == [(1.0, 10.0), (2.0, 30.0)]


def settle(q, seconds=120):
    """Wait until a running stream has nothing more to do, by its progress, and give up in time."""
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        if q.exception():
            raise q.exception()
        status = q.status
        if q.lastProgress and not status["isDataAvailable"] and not status["isTriggerActive"]:
            return
        time.sleep(0.1)
    raise TimeoutError("the stream doesn't settle")


def test_state_expires_by_event_time(spark, tmp_path):
    """Keys start anew after a gap of their own, whatever the batches, and streams with expiry end."""
    rows = [(1, 0, 10, True), (1, 5, 10, True), (2, 5, 7, True), (1, 30, 10, True), (1, 500, 10, True), (2, 501, 7, True)]
    for at in ((0, 3), (3, 4), (4, 6)):
        df = events(spark, tmp_path / "e", rows[slice(*at)])
        time.sleep(0.05)
    got = drain(runner.stream_ema(df, "k", "ts", "v", expire_s=60, delay="10 seconds"), "sx", "update").collect()
    assert sorted((r.k, r.n) for r in got) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 1)]
    got = drain(runner.stream_breaker(df, "k", "ts", "ok", expire_s=60, delay="10 seconds", least=5), "sbx", "update").collect()
    assert sorted((r.k, r.seen) for r in got) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 1)]


def test_drain_returns_on_a_stream_that_expires(spark, tmp_path):
    df = runner.stream_ema(events(spark, tmp_path / "e", ROWS), "k", "ts", "v", expire_s=5)
    df = df.select(F.col("k"), F.col("n"))
    run = runner.StreamRun(df, [FnSink(lambda d: d.count())], str(tmp_path / "cp"), prepare=lambda batch, n: __import__("millrace.plans.envelope", fromlist=["wrap"]).wrap(batch, "k"), mode="update", processingTime="100 milliseconds").start()
    done = threading.Thread(target=run.drain, daemon=True)
    done.start()
    done.join(120)
    try:
        assert not done.is_alive() and run.state == "Completed"
    finally:
        run.query.stop()


def fold_of(df, expire_s=60):
    from millrace.streaming import state

    step = lambda s, x: ((s[0] + 1, s[1] + x), (s[0] + 1, s[1] + x, x))
    return state.ordered_fold(df, "k", "ts", "30 seconds", ["v"], {"x": F.col("v")}, "n long, total double", lambda: (0, 0.0), step, "n long, total double, x double", expire_s)


def reference_fold(rows, expire_s=60):
    out, states = [], {}
    for k, s, v, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        n, total, last = states.get(k, (0, 0.0, None))
        if last is not None and s - last > expire_s:
            n, total = 0, 0.0
        states[k] = (n + 1, total + v, s)
        out.append((k, n + 1, total + v, float(v)))
    return sorted(out, key=lambda r: (str(r[0]), r[1:]))


def test_ordered_fold_goes_by_event_time_and_restarts(spark, tmp_path):
    """Rows out of order within the delay, a late one, a null key, a restart from the checkpoint between batches."""
    from millrace.streaming import state

    batches = [[(1, 10, 1, True), (1, 5, 2, True), (2, 7, 3, True), (None, 8, 9, True)], [(1, 20, 4, True), (1, 12, 5, True), (2, 300, 1, True)], [(1, 25, 7, True), (1, 310, 8, True), (2, 1000, 0, True)]]
    with state.rocksdb(spark):
        for batch in batches:
            df = fold_of(events(spark, tmp_path / "e", batch))
            q = df.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
            try:
                assert q.awaitTermination(120)
            finally:
                q.stop()
    got = sorted(((r.k, r.n, r.total, r.x) for r in spark.read.parquet(str(tmp_path / "o")).collect()), key=lambda r: (str(r[0]), r[1:]))
    on_time = [r for b in batches for r in b if r not in [(1, 25, 7, True), (2, 1000, 0, True)]]  # one is late, one still waits
    assert got == reference_fold(on_time)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


class _Counting:
    """Refuses a batch with a negative number; each call leaves its size."""

    def open(self):
        self.sizes = []

    def apply(self, batch):
        self.sizes.append(len(batch))
        if (batch["x"] < 0).any():
            raise ValueError("negative")
        return batch.assign(x=batch["x"] + 0 * len(self.sizes), calls=len(self.sizes))

    def close(self): ...


def test_a_batch_that_raises_is_halved(spark):
    from millrace.operators.udf import PartitionTransform

    for bad in ([], [0], [4999], [7, 8, 9, 2500], list(range(0, 5000, 11)), list(range(5000))):
        df = spark.range(0, 5000, 1, 1).withColumns({"x": F.when(F.col("id").isin(bad), -1).otherwise(F.col("id")), "calls": F.lit(0).cast("long")})
        got = PartitionTransform(_Counting).apply(envelope.wrap(df, "id")).select("id", "x", "calls", "_error.message").collect()
        assert [r.id for r in got] == [*range(5000)]
        assert [r.id for r in got if r.message == "negative"] == bad and all(r.x == (-1 if r.message else r.id) for r in got)
        assert max(r.calls for r in got) <= 1 + 16 * len(bad) and max(r.calls for r in got) < 4000


class _Handle:
    """State of one key, whose calls are counted."""

    def __init__(self):
        self.calls, self.timers, self.kept = [], [], []

    def __getattr__(self, name):
        def call(*given):
            self.calls.append(name)
            if name == "registerTimer":
                self.timers.append(given[0])
            elif name == "appendList":
                self.kept.extend(given[0])
            return self if name.startswith("get") else list(self.timers) if name == "listTimers" else bool(self.kept)

        return call


def test_rows_that_arrive_cost_three_state_calls():
    import pandas as pd

    from millrace.streaming.state import _Ordered

    fold = _Ordered("k", ["v"], ["x"], ["n"], "_us long, v long, x double", "n long", lambda: (0,), None, None)
    fold.init(handle := _Handle())
    handle.calls.clear()
    frame = pd.DataFrame([[None, "+a", 2, 0.5, 7000], [None, "+a", 1, None, 5000]])
    assert list(fold.handleInputRows(("+a",), iter([frame]), None)) == []  # no frame for a key without rows
    assert handle.calls == ["listTimers", "appendList", "registerTimer"] and handle.timers == [5]
    assert handle.kept == [(7000, 2, 0.5), (5000, 1, None)]
