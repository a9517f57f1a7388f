import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators.resilience import Attempted, Isolated, RetryPolicy, within
from millrace.plans import envelope
from millrace.streaming.keytable import FAN, KeyTable, folders
from millrace.streaming.retries import RetryTable
from millrace.streaming.runner import DedupSet


def rows(spark, *keys):
    return spark.createDataFrame([(k, "x") for k in keys], "k long, v string")


def admitted(spark, seen, n, *keys):
    return sorted((r.k for r in seen.admit(rows(spark, *keys), n).collect()), key=str)


def test_dedup_set_knows_null_keys(spark, tmp_path):
    seen = DedupSet(str(tmp_path / "s"), ["k"], buckets=4)
    assert admitted(spark, seen, 0, None, None, 1) == [1, None]
    assert admitted(spark, seen, 1, None, 1, 2) == [2]
    assert admitted(spark, seen, 1, None, 1, 2) == [2]  # the same batch again
    seen.remove(rows(spark, None), 2)
    assert admitted(spark, seen, 3, None, 2) == [None]
    assert admitted(spark, seen, 4) == []


def test_dedup_set_by_two_columns(spark, tmp_path):
    seen = DedupSet(str(tmp_path / "s"), ["a", "b"])
    make = lambda *r: spark.createDataFrame(list(r), "a long, b string")
    got = lambda n, *r: sorted(map(tuple, seen.admit(make(*r), n).collect()), key=str)
    assert got(0, (1, None), (None, "x"), (1, "y")) == [(1, "y"), (1, None), (None, "x")]
    assert got(1, (1, None), (None, "x"), (None, None)) == [(None, None)]


def test_segments_merge_by_level_and_keep_their_keys(spark, tmp_path):
    table = KeyTable(str(tmp_path / "t"), ["k"], buckets=2)
    for n in range(2 * FAN + 2):
        new = table.without(rows(spark, n, n - 1, 100 + n % 3), n).select("k")
        table.put(new, n)
    names = folders(spark, table.path)
    assert len(names) < FAN + 4 and sorted(r.k for r in table.alive(spark).collect()) == [*range(-1, 2 * FAN + 2), 100, 101, 102]
    assert table.without(rows(spark, 5, 777), 2 * FAN + 2).count() == 1


def test_a_batch_reads_its_buckets_alone(spark, tmp_path):
    table = KeyTable(str(tmp_path / "t"), ["k"], buckets=16)
    table.put(spark.range(1000).withColumnRenamed("id", "k"), 0)
    plan = table.without(rows(spark, 3), 1)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*_bucket#\d+ = \d+", plan)


def keyed(spark, table, n, data, tries=1):
    """One batch: rows fail while their attempt is at most v."""

    def fn(row, _):
        if row["attempt"] <= row["v"]:
            raise ConnectionError("later")
        return {}

    transform = Attempted(fn, RetryPolicy(1, retry_on=lambda _: False))
    batch = spark.createDataFrame(data, "k long, v long")
    out = table.run(batch, n, transform.apply, lambda df: envelope.wrap(df, "k"))
    return sorted(((r.k, r.attempt, r._error is None) for r in out.collect()), key=str)


def test_retries_keep_rows_without_and_with_repeated_keys(spark, tmp_path):
    table = RetryTable(str(tmp_path / "r"), RetryPolicy(2, delay_ms=1, backoff="fixed"))
    assert keyed(spark, table, 0, [(None, 1), (5, 2), (5, 0), (5, 0), (None, 0)]) == [(5, 1, True), (5, 1, True), (None, 1, True)]
    assert table.pending(spark).count() == 2
    time.sleep(0.05)
    first = keyed(spark, table, 1, [(7, 9)])
    assert first == [(None, 2, True)]
    assert keyed(spark, table, 1, [(7, 9)]) == first  # the same batch again
    time.sleep(0.05)
    assert keyed(spark, table, 2, []) == [(5, 3, True)]
    time.sleep(0.05)
    assert keyed(spark, table, 3, []) == [(7, 3, False)]
    assert table.pending(spark).count() == 0 and keyed(spark, table, 4, []) == []


def test_rows_wait_until_they_are_due(spark, tmp_path):
    table = RetryTable(str(tmp_path / "r"), RetryPolicy(3, delay_ms=10_000, backoff="fixed"))
    at = lambda s: F.lit(f"2024-01-01 00:00:{s:02d}").cast("timestamp")
    fails = lambda df: envelope.fail_where(df, F.col("attempt") < 3, envelope.error("no", envelope.TRANSIENT))
    run = lambda n, s, *k: sorted(r.k for r in table.run(rows(spark, *k), n, fails, lambda df: envelope.wrap(df, "k"), at(s)).collect())
    assert run(0, 0, 1) == [] and run(1, 5, 2) == [] and run(2, 9) == []
    assert run(3, 10) == [] and run(4, 16) == []  # second attempts of 1, then 2
    assert run(5, 19) == [] and run(6, 20) == [1] and run(7, 30) == [2]
    assert table.pending(spark).count() == 0 and len(folders(spark, str(tmp_path / "r" / "waits"))) < 5


def test_metadata_is_given_back(spark, tmp_path):
    table = RetryTable(str(tmp_path / "r"))
    wrap = lambda df: envelope.wrap(df, "k", source="s")
    assert table.run(rows(spark, 1), 0, lambda df: df, wrap).first()["_metadata"] == {"lineage_source": "s"}
    table = RetryTable(str(tmp_path / "q"))
    assert table.run(rows(spark, 1), 0, lambda df: df, lambda df: envelope.wrap(df, "k")).first()["_metadata"] is None


def test_an_alarm_ends_a_call_and_leaves_no_thread():
    before, began = threading.active_count(), time.monotonic()

    def hangs():
        try:
            time.sleep(60)
        except Exception:
            time.sleep(60)

    for _ in range(20):
        with pytest.raises(TimeoutError, match="Timed out after 0.0s"):
            within(hangs, 0.01)
    assert threading.active_count() == before and time.monotonic() - began < 5
    assert within(lambda x: x + 1, 5, 1) == 2
    with pytest.raises(ZeroDivisionError):
        within(lambda: 1 / 0, 5)


def test_a_helper_thread_serves_many_calls():
    found = []

    def other():
        start = threading.active_count()
        found.append([within(lambda x: x, 5, i) for i in range(200)])
        with pytest.raises(TimeoutError):
            within(time.sleep, 0.05, 0.5)
        found.append(within(lambda: "on", 5))
        found.append(threading.active_count() - start)

    thread = threading.Thread(target=other)
    thread.start()
    thread.join(30)
    assert found[0] == list(range(200)) and found[1] == "on" and found[2] <= 2


def test_isolated_calls_are_killed():
    import os

    def fn(kind):
        if kind == "hang":
            while True:
                pass
        if kind == "die":
            os._exit(3)
        if kind == "bad":
            raise ValueError("no")
        return (kind, os.getpid())

    call = Isolated(fn)
    try:
        kind, pid = call(5, "fine")
        assert kind == "fine" and pid != os.getpid() and call(5, "fine") == ("fine", pid)
        with pytest.raises(TimeoutError):
            call(0.1, "hang")
        assert call(5, "fine")[1] != pid
        with pytest.raises(RuntimeError, match="died"):
            call(5, "die")
        with pytest.raises(ValueError, match="no"):
            call(5, "bad")
        with pytest.raises(RuntimeError):
            Isolated(lambda: threading.Lock())(5)
    finally:
        call.close()


def test_isolated_attempts_in_tasks(spark):
    def fn(row, attempt):
        if row["id"] % 5 == 2:
            while True:
                pass
        return {"id": row["id"] + 100}

    df = envelope.wrap(spark.range(0, 20, 1, 2), "id")
    got = Attempted(fn, RetryPolicy(1, retry_on=lambda _: False), timeout_s=0.3, isolate=True).apply(df).collect()
    assert {r.id for r in got if r._error is None} == {100 + i for i in range(20) if i % 5 != 2}
    assert {r._error.category for r in got if r._error} == {"Timeout"}


def test_rows_due_in_one_second_are_written_by_several_tasks(spark, tmp_path):
    held = RetryTable(str(tmp_path), RetryPolicy(1, delay_ms=1))
    fails = lambda df: envelope.fail_where(df, F.lit(True), envelope.error("later", envelope.TRANSIENT))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held.run(spark.range(1000), 0, fails, lambda df: envelope.wrap(df, "id"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = [*tmp_path.glob("waits/batch=0/_slot=*/*.parquet")]
    assert len(files) > len({f.parent for f in files})
    assert sorted(r.id for r in held.pending(spark).collect()) == [*range(1000)]
