import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import resilience
from millrace.operators.resilience import Attempted, CircuitBreaker, RetryPolicy
from millrace.plans import envelope


def test_delays():
    assert [RetryPolicy(backoff="fixed").delay(n) for n in (0, 1, 5)] == [0, 1000, 1000]
    assert [RetryPolicy(backoff="linear").delay(n) for n in (1, 2, 40)] == [1000, 2000, 30000]
    assert [RetryPolicy().delay(n) for n in (1, 2, 3, 6, 500)] == [1000, 2000, 4000, 30000, 30000]
    with pytest.raises(ValueError):
        RetryPolicy(0)


@given(st.integers(1, 200), st.floats(0.0, 1e5), st.sampled_from(["fixed", "linear", "exponential"]))
def test_delays_grow_and_are_bounded(n, base, kind):
    policy = RetryPolicy(delay_ms=base, backoff=kind)
    assert 0 < policy.delay(n) <= policy.delay(n + 1) <= policy.max_delay_ms


def test_delay_column_equals_python(spark):
    for kind in ("fixed", "linear", "exponential"):
        policy = RetryPolicy(backoff=kind)
        rows = spark.range(0, 80).select("id", policy.delay_column(F.col("id")).alias("d")).collect()
        assert all(r.d == policy.delay(r.id) for r in rows)


def test_jitter(spark):
    rows = spark.range(2000).select(resilience.jittered(F.lit(100.0), 3).alias("d")).collect()
    assert 75 <= min(r.d for r in rows) < 77 and 98 < max(r.d for r in rows) <= 100


def failing(spark, n=6):
    return envelope.wrap(spark.range(n).select(F.col("id"), F.col("id").alias("v")), "id")


def test_attempts_until_success_or_budget(spark):
    def flaky(row, attempt):
        if attempt <= row["id"]:
            raise TimeoutError("later")
        return {"v": row["v"] * 10}

    rows = {r.id: r for r in Attempted(flaky, RetryPolicy(3)).apply(failing(spark)).collect()}
    assert [rows[i].attempts for i in range(6)] == [1, 2, 3, 4, 4, 4]
    assert [rows[i]["_error"] is None for i in range(6)] == [True] * 4 + [False] * 2
    assert rows[3].v == 30 and rows[5]["_error"]["type"] == "Transient"


def test_permanent_errors_are_not_retried(spark):
    def bad(row, attempt):
        raise ValueError("no")

    row = Attempted(bad).apply(failing(spark, 1)).first()
    assert row.attempts == 1 and row["_error"]["category"] == "TransformError" and row["_error"]["exception"] == "ValueError"


def test_attempt_timeout(spark):
    def slow(row, attempt):
        time.sleep(0.5)
        return {}

    row = Attempted(slow, RetryPolicy(1), timeout_s=0.1).apply(failing(spark, 1)).first()
    assert row["_error"]["message"] == "Timed out after 0.1s" and row["_error"]["type"] == "Transient"


def test_routing_and_replay(spark):
    df = failing(spark)
    df = envelope.fail_where(df, F.col("id") == 1, envelope.error("t", envelope.TRANSIENT))
    df = envelope.fail_where(df, F.col("id") == 2, envelope.error("p"))
    df = envelope.fail_where(df, F.col("id") == 3, envelope.error("f", category=envelope.FILTERED))
    assert {r.id: r.route for r in resilience.route(df).collect()} == {0: "sink", 1: "retry", 2: "dead_letter", 3: "filtered", 4: "sink", 5: "sink"}
    letters = resilience.dead_letters(df)
    assert sorted(r.trace_id for r in letters.collect()) == [1, 2]
    assert sorted(r.v for r in resilience.replay(letters).collect()) == [1, 2]


def test_breaker_opens_probes_and_closes():
    b = CircuitBreaker(least=5)
    for t in range(4):  # from the third failure on the early warning counts each twice
        assert b.allow(t)
        b.record(t, False)
    assert b.state == "Open" and not b.allow(20)
    assert b.allow(34) and b.state == "HalfOpen"
    b.record(34, True)
    assert b.allow(35)
    b.record(35, True)
    assert b.state == "Closed" and b.ewma == 0.0
    b.isolate()
    assert not b.allow(99)
    b.reset()
    assert b.allow(99) and b.metrics(99)["cb_failure_ratio"] == 0.0


def test_breaker_needs_throughput_and_forgets():
    b = CircuitBreaker(least=100)
    for t in range(7):
        b.record(t, False)
    assert b.state == "Closed"
    b = CircuitBreaker(least=4, sampling_s=10)
    for t in (0, 1):
        b.record(t, False)
    b.record(50, False)
    assert b.state == "Closed" and len(b.window) <= 2


def test_half_open_admits_few():
    b = CircuitBreaker(least=2, half_open=3)
    b.record(0, False)
    b.record(0, False)
    assert b.state == "Open"
    assert [b.allow(31) for _ in range(5)] == [True, True, True, False, False]
    b.record(31, False)
    assert b.state == "Open"


def test_breaker_replay(spark):
    rows = [("a", i, float(i), i >= 12) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i long, t double, ok boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = resilience.breaker_replay(df, "k", "ts", "i", "ok", least=5).orderBy("i").collect()
    b, want = CircuitBreaker(least=5), []
    for _, i, t, ok in rows:
        allowed = b.allow(t)
        if allowed:
            b.record(t, ok)
        want.append((i, allowed, b.state))
    assert [(r.i, r.allowed, r.cb_state) for r in got] == want
    assert {"Closed", "Open"} <= {r.cb_state for r in got}


def test_a_hung_row_holds_up_no_other(spark):
    import pathlib
    import tempfile

    calls = pathlib.Path(tempfile.mkdtemp())

    def fn(row, attempt):
        (calls / f"{row['id']}-{attempt}").touch()
        if row["id"] == 0:
            time.sleep(1.2)
        return {"v": row["v"] + 1}

    df = failing(spark, 4).coalesce(1)
    rows = {r.id: r for r in Attempted(fn, RetryPolicy(1, retry_on=lambda _: False), timeout_s=0.4).apply(df).collect()}
    assert rows[0]["_error"]["message"] == "Timed out after 0.4s"
    assert [rows[i].v for i in range(4)] == [0, 2, 3, 4] and all(rows[i]["_error"] is None for i in (1, 2, 3))
    assert sorted(p.name for p in calls.iterdir()) == ["0-1", "1-1", "2-1", "3-1"]


def test_a_rows_own_budget(spark):
    def never(row, attempt):
        raise TimeoutError("no")

    df = failing(spark, 4).withColumn("budget", F.expr("case id when 0 then 0 when 1 then 5 when 2 then -1 end"))
    rows = {r.id: r for r in Attempted(never, RetryPolicy(2), budget_col="budget", timed=True).apply(df).collect()}
    assert [rows[i].attempts for i in range(4)] == [1, 6, 3, 3] and all(r.elapsed_ms >= 0 for r in rows.values())


def test_failed_rows_are_not_attempted(spark):
    df = envelope.fail_where(failing(spark), F.col("id") < 3, envelope.error("before"))
    rows = {r.id: r for r in Attempted(lambda row, _: {"v": None, "unknown": 1}).apply(df).collect()}
    assert [rows[i].attempts for i in range(6)] == [0, 0, 0, 1, 1, 1]
    assert [rows[i].v for i in range(6)] == [0, 1, 2, None, None, None] and rows[0]["_error"]["message"] == "before"


def test_half_open_is_left_in_the_end():
    b = CircuitBreaker(least=10, break_s=5, sampling_s=5)
    for t in range(10):
        b.record(0.0, False)
    assert b.state == "Open" and b.allow(6)
    for t, good in ((6, False), (6.5, True), (7, False)):
        b.record(t, good)
    assert b.state == "HalfOpen"
    assert [b.allow(t) for t in (7, 8, 9)] == [True, True, False]
    assert b.allow(11.5)  # renewed probes
    b.record(11.5, True)
    b.allow(12)
    b.record(12, True)
    assert b.state == "Closed"
