import datetime as dt
import gzip
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.operators.intervals import interval_pairs, interval_sums
from millrace.plans import envelope
from millrace.sources.isolated import IsolatedFiles
from millrace.sources.readers import JdbcSource
from millrace.sources.sinks import LedgerSink

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, k string, ts timestamp, x long"


def events(rng, n, keys=("a", "b", None), span=400):
    return [(i, rng.choice(keys), None if rng.random() < 0.05 else T0 + dt.timedelta(seconds=rng.randrange(span) / rng.choice([1, 2])), rng.randrange(9)) for i in range(n)]


@pytest.mark.parametrize(("before", "after", "bins", "block"), [(20, 0, 4, 1024), (7, 13, 1, 2), (0, 0, 4, 3), (1000, 1000, 8, 1)])
@pytest.mark.parametrize("keys", [["k"], []])
def test_sums_and_pairs_against_all_pairs(spark, before, after, bins, block, keys):
    rng = random.Random(before + after)
    left, right = events(rng, 60), events(rng, 90)
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    fits = lambda p, q: None not in (p[2], q[2]) and (not keys or (p[1] is not None and p[1] == q[1])) and -before <= (q[2] - p[2]).total_seconds() <= after
    pairs = [(p, q) for p in left for q in right if fits(p, q)]
    got = interval_sums(a, b, keys, ["id"], "ts", "ts", before, after, {"total": F.col("x")}, bins_per_range=bins, block=block)
    want = {p[0]: (0, 0) for p in left}
    for p, q in pairs:
        want[p[0]] = (want[p[0]][0] + 1, want[p[0]][1] + q[3])
    assert {r.id: (r.n, r.total) for r in got.collect()} == want and got.columns == ["id", "k", "ts", "x", "n", "total"]
    if keys:
        joined = interval_pairs(a, b, keys, "ts", "ts", before, after)
        assert sorted((r.id, r.right_id) for r in joined.collect()) == sorted((p[0], q[0]) for p, q in pairs)


def test_no_window_without_a_partition(spark):
    a = spark.createDataFrame(events(random.Random(1), 20), SCHEMA)
    plan = interval_sums(a, a, [], ["id"], "ts", "ts", 10)._jdf.queryExecution().executedPlan().toString()
    single = [x for x in plan.split("\n") if "SinglePartition" in x]
    assert len(single) <= 1  # the sums of blocks alone


def test_a_damaged_file_costs_its_own_rows(spark, tmp_path):
    for i in range(3):
        pq.write_table(pa.table({"k": list(range(i * 10, i * 10 + 10)), "v": ["x"] * 10}), tmp_path / f"{i}.parquet", row_group_size=4)
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 this is not one PAR1")
    raw = bytearray((tmp_path / "2.parquet").read_bytes())
    at = pq.ParquetFile(tmp_path / "2.parquet").metadata.row_group(1).column(0)
    start = at.dictionary_page_offset or at.data_page_offset
    raw[start : start + 12] = b"\xff" * 12
    (tmp_path / "2.parquet").write_bytes(bytes(raw))
    got = IsolatedFiles(str(tmp_path), "k long, v string, more double").read(spark).collect()
    assert sorted(r.k for r in got if r._failure is None) == [*range(24), 28, 29]
    assert sorted((r._failure.path.split("/")[-1], r._failure.part) for r in got if r._failure) == [("2.parquet", 1), ("bad.parquet", -1)]
    assert all(r.more is None for r in got)


def test_text_keeps_what_was_read_before_it_broke_off(spark, tmp_path):
    lines = [json.dumps({"k": i, "v": "é" * 40 + str(random.random())}) for i in range(20_000)]
    lines[5], lines[7], lines[9] = "{", '{"k": "text"}', "[1]"
    whole = gzip.compress("\n".join(lines).encode())
    (tmp_path / "a.json.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "b.json").write_text('{"k": 1}\n\n{"k": 2, "z": 3}')
    got = IsolatedFiles(str(tmp_path), "k long, v string", "json").read(spark).collect()
    failed = sorted((r._failure.part for r in got if r._failure), key=lambda x: x)
    assert failed[:3] == [5, 7, 9] and len(failed) == 4 and 5000 < failed[3] < 20_000
    good = sorted(r.k for r in got if r._failure is None)
    assert good == sorted([1, 2, *(i for i in range(failed[3]) if i not in (5, 7, 9))])


def test_failures_become_rows_for_dead_letters(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "p"))
    (tmp_path / "p" / "x.parquet").write_bytes(b"no")
    rows = IsolatedFiles(str(tmp_path / "p"), "id long").enveloped(spark, "id")
    assert envelope.succeeded(rows).count() == 5
    (bad,) = envelope.failed(rows).collect()
    assert bad._error.category == "Source" and "x.parquet" in bad._error.message
    with pytest.raises(ValueError):
        IsolatedFiles("x", "id long", "orc")


def test_a_batch_reaches_a_database_once(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    sink = LedgerSink(url, "events", "s1", options)
    batch = lambda lo, hi: envelope.wrap(spark.range(lo, hi, 1, 3).withColumnRenamed("id", "k").withColumn("v", F.lit(0.5)), "k")
    for n, (lo, hi) in enumerate([(0, 10), (10, 12), (12, 30)]):
        for _ in range(2):
            sink.write_batch(batch(lo, hi), n)
    broken = batch(30, 40).withColumn("v", F.when(F.col("k") == 35, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        sink.write_batch(broken, 3)
    sink.write_batch(batch(30, 40), 3)
    sink.write_batch(envelope.fail_where(batch(40, 50), F.col("k") > 44, envelope.error("no")), 4)
    read = lambda: sorted(r.k for r in JdbcSource(url, 'SELECT "k" FROM "events"', options=options).read(spark).collect())
    assert read() == [*range(45)]
    LedgerSink(url, "events", "s2", options).write_batch(batch(100, 101), 0)  # another stream counts by itself
    assert read() == [*range(45), 100]
