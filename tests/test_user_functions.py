import pandas as pd

from millrace.functions import user
from millrace.operators.ordered import fold
from pyspark.sql import functions as F


class Total:
    def zero(self):
        return (0, 0.0)

    def add(self, state, rows):
        x = rows["v"].dropna()
        return (state[0] + len(rows), state[1] + float(x.sum()))

    def merge(self, a, b):
        return (a[0] + b[0], a[1] + b[1])

    def finish(self, state):
        return {"n": state[0], "total": state[1]}


def test_aggregate_merges_partial_states(spark):
    rows = [(i % 3 if i % 5 else None, "a", float(i) if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, s string, v double").repartition(6)
    got = {r.k: (r.n, r.total) for r in user.aggregate(df, ["k", "s"], ["v"], Total(), "n long, total double").collect()}
    want = {}
    for k, _, v in rows:
        n, total = want.get(k, (0, 0.0))
        want[k] = (n + 1, total + (v or 0.0))
    assert got == want
    assert user.aggregate(df.where("false"), ["k"], ["v"], Total(), "n long, total double").collect() == []


def test_table_function(spark):
    user.register_table_function(spark, "two_of", lambda x: [(x, 0), (x, 1)] if x else [], "x long, i int")
    rows = spark.sql("SELECT t.id, u.i FROM range(3) t, LATERAL two_of(t.id) u").collect()
    assert sorted((r.id, r.i) for r in rows) == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_scalar_function(spark):
    double = user.scalar(lambda x: pd.Series(x) * 2, "long")
    assert [r.d for r in spark.range(3).select(double("id").alias("d")).orderBy("d").collect()] == [0, 2, 4]


def test_fold_in_order_with_null_keys_and_batches(spark):
    rows = [(None if i % 4 == 0 else i % 3, -i, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # keys go over several batches
    try:
        got = {r.k: (r.n, r.text) for r in fold(df, "k", ["o"], [F.col("v")], lambda: (0, ""), lambda s, v: (s[0] + 1, f"{s[1]},{v}"), "n int, text string", lambda s: s).collect()}
        each = fold(df, "k", ["o"], [F.col("v")], lambda: 0, lambda s, v: (s + v, (s + v,)), "run long", kept=["o"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, runs = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        n, text = want.get(k, (0, ""))
        want[k] = (n + 1, f"{text},{v}")
        runs[k, o] = sum(x for kk, oo, x in rows if kk == k and oo <= o)
    assert got == want
    assert {(r.k, r.o): r.run for r in each} == runs
    assert fold(df.where("false"), "k", ["o"], [F.col("v")], lambda: 0, lambda s, v: s, "n int", lambda s: (s,)).collect() == []
