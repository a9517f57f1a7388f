import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import hashing, secrets
from millrace.operators import controllers, sketches


def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


@given(st.integers(0, 2**64 - 1), st.integers(1, 1000))
@settings(max_examples=200, deadline=None)
def test_jump_hash(key, n):
    got = hashing.jump_array(np.array([key], dtype=np.uint64), n)[0]
    assert got == slow_jump(key, n) and 0 <= got < n


def test_one_step_of_the_generator():
    assert (np.array([2**64 - 1], dtype=np.uint64) * np.uint64(hashing.JUMP_STEP) + np.uint64(1))[0] == 15583810517931609860


def test_few_keys_move_when_a_bucket_is_added():
    keys = np.arange(20000, dtype=np.uint64)
    a, b = hashing.jump_array(keys, 10), hashing.jump_array(keys, 11)
    assert (a != b).mean() < 0.12 and set(b[a != b]) == {10}


def test_null_keys(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "k long")
    got = df.select(hashing.jump_hash("k", 7).alias("j"), hashing.mix64("k").alias("m"), hashing.fnv1a64("k").alias("f")).collect()
    assert got[1].j is None and got[1].m is None and got[1].f is None
    assert got[2].j == slow_jump(2**64 - 1, 7)
    with pytest.raises(ValueError):
        hashing.jump_hash("k", 0)


@pytest.mark.parametrize("p, want", [(12, 9948.726101550952), (14, 9991.039137937058)])
def test_hll_exact_values(spark, p, want):
    got = sketches.hll_estimate(sketches.hll_registers(spark.range(10000), "id", p), p).first().estimate
    assert got == pytest.approx(want, rel=1e-12)


def test_hll_merge_equals_direct(spark):
    a, b = sketches.hll_registers(spark.range(0, 5000), "id"), sketches.hll_registers(spark.range(4000, 9000), "id")
    both = sketches.hll_estimate(sketches.hll_merge(a, b)).first().estimate
    assert both == sketches.hll_estimate(sketches.hll_registers(spark.range(9000), "id")).first().estimate
    assert abs(both - 9000) < 0.05 * 9000
    with pytest.raises(ValueError):
        sketches.hll_registers(spark.range(1), "id", 3)


def test_native_distinct_count(spark):
    df = spark.range(6000).withColumn("g", F.col("id") % 2)
    assert all(abs(r.estimate - 3000) < 150 for r in sketches.distinct_count(df, "id", "g").collect())


def test_histogram(spark):
    h = sketches.LogHistogram()
    assert h.base == pytest.approx(1.1481536214968828)
    df = spark.createDataFrame([(500.0,)] * 1000 + [(0.0,), (-1.0,), (None,)], "v double")
    got = h.percentiles(df, "v").first()
    assert got.p50 == pytest.approx(10**2.67) and got.p99 == got.p50
    one = spark.createDataFrame([(500.0,)], "v double")
    assert h.percentiles(one, "v", (0.5,), compat=False).first().p50 == pytest.approx(10**2.67)
    assert h.percentiles(df.where("v < 0"), "v").first().p50 == 0.0


def test_bloom_sizes():
    assert [sketches.bloom_size(n, p) for n, p in ((10**6, 0.001), (1000, 0.001), (100, 0.01))] == [(14377587, 9), (14377, 9), (958, 6)]


def test_samples(spark):
    df = spark.range(1000)
    assert sketches.uniform_sample(df, 30, 1).count() == 30
    assert sketches.uniform_sample(df, 3000, 1).count() == 1000
    a = sorted(r.id for r in sketches.bottom_k(df, "id", 40).collect())
    x = hashing.mix64_array(np.arange(1000, dtype=np.uint64))
    assert a == sorted(np.argsort(x, kind="stable")[:40].tolist())


def test_dedup_and_removal(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert sorted(r.v for r in sketches.dedup(df, ["k"], [F.col("v").desc()]).collect()) == ["b", "c"]
    assert sketches.dedup(df, ["k"]).count() == 2
    assert [r.k for r in sketches.remove_keys(df, df.where("k = 1"), ["k"]).collect()] == [2]


def test_reshard_puts_shard_i_in_partition_i(spark):
    df = sketches.reshard(spark.range(500), "id", 5).withColumn("p", F.spark_partition_id())
    rows = df.collect()
    assert len(rows) == 500 and all(r.p == slow_jump(r.id, 5) for r in rows)


def test_ema(spark):
    df = spark.createDataFrame([("a", 1, 100.0), ("a", 2, 101.0), ("b", 1, 10.0), ("b", 2, 100.0)], "k string, t int, v double")
    got = {r.k: r for r in controllers.ema(df, "k", ["t"], "v").collect()}
    assert got["a"].level == pytest.approx(100.2)
    assert got["a"].velocity == pytest.approx(0.1 * 0.2 + 0.9 * 100)
    assert got["b"].level == pytest.approx(0.8 * 100 + 0.2 * 10)


@given(st.lists(st.floats(0, 500), min_size=1, max_size=30))
def test_parallelism_formula(values):
    now, low, high = 8, 2, 32
    for x in values:
        e = 10 - x
        if abs(e) < 5 or (now >= high and e > 0) or (now <= low and e < 0):
            continue
        now = min(high, max(low, now + (1 if e > 0 else -1) * max(1, min(3, int(abs(e) / 20)))))
    assert low <= now <= high


def test_parallelism_limits(spark):
    df = spark.createDataFrame([("slow", i, 400.0) for i in range(40)] + [("fast", i, 0.0) for i in range(40)] + [("calm", i, 11.0) for i in range(5)], "k string, t int, v double")
    got = {r.k: r.parallelism for r in controllers.parallelism(df, "k", ["t"], "v", cpu=4, low=32, high=2).collect()}
    assert got == {"slow": 2, "fast": 16, "calm": 4}


def test_backpressure(spark):
    cases = [(0.5, 500.0, 0.0, 0.0), (0.9, 500.0, 0.0, 20.0), (0.9, 2000.0, 0.0, 40.0), (0.9, 50.0, 0.0, 5.0), (0.9, 500.0, 60.0, 30.0), (9.0, 500.0, 0.0, 200.0), (0.705, 500.0, 0.0, 0.0)]
    df = spark.createDataFrame(cases, "f double, tp double, lat double, want double")
    rows = df.withColumn("got", controllers.backpressure_delay(F.col("f"), F.col("tp"), F.col("lat"))).collect()
    assert all(r.got == pytest.approx(r.want) for r in rows)


def test_secrets(spark):
    import base64
    import urllib.parse

    key = "api_key: 'sk-" + "secret-value'"
    layered = base64.b64encode(urllib.parse.quote(key).encode()).decode()
    texts = {
        "plain": key, "aws": "id AKIA" + "B2C3" * 4, "github": "ghp_" + "a1B2" * 9, "jwt": "eyJ" + "a" * 10 + ".b" + "c" * 10 + "." + "d" * 12,
        "url": urllib.parse.quote(key, safe=""), "base64": base64.b64encode(key.encode()).decode(), "both": layered,
        "hex": "commit " + "0123456789abcdef" * 3, "benign": "lorem ipsum " * 1000, "bad": "%zz @@@ " + "QUJD" * 8,
    }
    df = spark.createDataFrame([*texts.items(), ("null", None)], "n string, t string")
    got = {r.n: r.s for r in df.select("n", secrets.has_secrets(F.col("t")).alias("s")).collect()}
    assert {n for n, s in got.items() if s} == {"plain", "aws", "github", "jwt", "url", "base64", "both"}
    red = {r.n: r.s for r in df.select("n", secrets.redact(F.col("t")).alias("s")).collect()}
    assert "secret-value" not in red["plain"] and red["benign"] == texts["benign"] and red["null"] is None


def test_stray_percent_signs_hide_no_secret(spark):
    coded = "password%3D" + "hunter22x"
    texts = ["50% off " + coded, coded + " 100%", "%zz %4 " + coded.replace("%", "%25"), "50% off, %zz %4", "100%25 done"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = [r.s for r in df.select("n", secrets.has_secrets(F.col("t")).alias("s")).orderBy("n").collect()]
    assert got == [True, True, True, False, False]


def test_log_of_base():
    assert math.trunc(math.log(500) / math.log(sketches.LogHistogram().base)) == 44


@given(st.integers(0, 2**64 - 1))
def test_fnv(key):
    h = 0xCBF29CE484222325
    for b in key.to_bytes(8, "little"):
        h = (h ^ b) * 0x100000001B3 % 2**64
    assert int(hashing.fnv_array(np.array([key], dtype=np.uint64))[0]) == h


def test_a_layer_of_coding_is_made_once(spark):
    df = spark.createDataFrame([(1, "x")], "n int, t string")
    plan = df.select(secrets.has_secrets(F.col("t")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= secrets.DEPTH
    nested = df.select(secrets.has_secrets(F.col("t"), patterns={"line": "^\n$"}).alias("s"))
    assert [r.s for r in nested.collect()] == [True]  # as ever: a layer without coding is a line end
