import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.transforms import Composite, Compress, Conditional, CsvReshape, Filter, Guarded, JsonReshape, MapFields, Middleware, PythonMiddleware, Validation, gunzip
from millrace.plans import envelope


@pytest.fixture()
def people(spark):
    rows = [(1, "Alice", 30), (2, "Bob", 16), (3, "", 0), (4, None, None)]
    return envelope.wrap(spark.createDataFrame(rows, "id long, name string, age int"), "id")


def errors(df):
    return {r["_trace_id"]: r["_error"] and (r["_error"]["message"], r["_error"]["type"], r["_error"]["category"]) for r in df.collect()}


def test_trace_id_from_key_and_from_content(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert len({r["_trace_id"] for r in envelope.wrap(df).collect()}) == 2
    assert len({r["_trace_id"] for r in envelope.wrap(df, "k").collect()}) == 2
    assert [r["_trace_id"] for r in envelope.wrap(df, "v").collect()] == [1, 1, 2]


def test_middleware(spark):
    df = envelope.wrap(spark.createDataFrame([(1,), (2,), (3,)], "v int"), "v")
    assert sorted(r.v for r in envelope.succeeded(Middleware({"v": F.col("v") * 2}).apply(df)).collect()) == [2, 4, 6]


def test_python_middleware_turns_exceptions_into_errors(people):
    def shout(row):
        return {"name": row["name"].upper()}

    df = PythonMiddleware(shout).apply(people)
    assert errors(df)[4][1:] == ("Permanent", "Middleware")
    assert {r.id: r.name for r in envelope.succeeded(df).collect()} == {1: "ALICE", 2: "BOB", 3: ""}


def test_filter_algebra_is_two_valued(people):
    adult, named = Filter(F.col("age") >= 18), Filter(F.length("name") > 0)
    ids = lambda f: sorted(r.id for r in envelope.succeeded(f.apply(people)).collect())
    assert ids(adult) == [1]
    assert ids(~adult) == [2, 3, 4]
    assert ids(adult | named) == [1, 2]
    assert ids(named & ~adult) == [2]
    assert ids(~(named & ~adult)) == [1, 3, 4]
    assert errors(adult.apply(people))[2] == ("Filtered out", "Permanent", "Filtered")
    assert envelope.failed(adult.apply(people)).count() == 0
    assert envelope.failed(adult.apply(people), with_filtered=True).count() == 3


def test_validation_collects_messages(people):
    rules = Validation().required("name").within("age", 1, 100).require(F.col("age") >= 18, "adults only")
    got = errors(rules.apply(people))
    assert got[1] is None
    assert got[2] == ("adults only", "Permanent", "Validation")
    assert got[3][0] == "The name field is required.; The field age must be between 1 and 100.; adults only"
    assert got[4][0] == "The name field is required.; adults only"
    assert [r.id for r in rules.to_filter().compact(people).collect()] == [1]


def test_conditional(spark):
    df = envelope.wrap(spark.createDataFrame([(10,), (3,)], "v int"), "v")
    assert sorted(r.v for r in Conditional(F.col("v") > 5, {"v": F.col("v") * 2}).apply(df).collect()) == [3, 20]


def test_composite_stops_at_the_first_failure(people):
    steps = [Filter(F.col("age") >= 18), Validation().require(F.lit(False), "never"), Middleware({"age": F.raise_error("not reached").cast("int")})]
    got = errors(Composite(steps[:2]).apply(people))
    assert got[1][0] == "never" and got[2][0] == "Filtered out"
    assert set(got) == {1, 2, 3, 4}


def test_json_reshape(spark):
    df = envelope.wrap(spark.createDataFrame([(1, "x", 5)], "ID long, Name string, extra int"), "ID")
    shape = T.StructType().add("id", T.LongType()).add("name", T.StringType()).add("other", T.DoubleType())
    assert [tuple(r) for r in envelope.succeeded(JsonReshape(shape).apply(df)).collect()] == [(1, "x", None)]


def test_json_column_with_bad_rows(spark):
    df = envelope.wrap(spark.createDataFrame([(1, '{"k": 3}'), (2, "{bad"), (3, None)], "id long, body string"), "id")
    out = JsonReshape(T.StructType().add("k", T.IntegerType()), "body").apply(df)
    assert errors(out) == {1: None, 2: ("Unreadable JSON", "Permanent", "Serialization"), 3: ("Unreadable JSON", "Permanent", "Serialization")}


def test_csv_reshape_binds_by_name(spark):
    df = envelope.wrap(spark.createDataFrame([("Te,st", 42)], "Name string, Value int"), "Value")
    shape = T.StructType().add("value", T.LongType()).add("name", T.StringType())
    assert [tuple(r) for r in envelope.succeeded(CsvReshape(shape).apply(df)).collect()] == [(42, "Te,st")]


def test_map_fields(spark):
    df = envelope.wrap(spark.createDataFrame([(1, "7"), (2, "x"), (3, None)], "id long, n string"), "id")
    out = MapFields({"key": ("id", None), "n": ("n", "int"), "twice": (F.col("id") * 2, "string")}).apply(df)
    assert errors(out)[2] == ("Cannot map n", "Permanent", "Mapping")
    assert sorted(tuple(r) for r in envelope.succeeded(out).fillna(0).collect()) == [(1, 7, "2"), (3, 0, "6")]


def test_compress(spark):
    df = envelope.wrap(spark.createDataFrame([(1, b"some bytes " * 50), (2, None)], "id long, data binary"), "id")
    out = Compress("data", "gzip").apply(df)
    packed = {r.id: r.data and bytes(r.data) for r in out.collect()}
    assert gzip.decompress(packed[1]) == b"some bytes " * 50 and packed[2] is None
    assert bytes(out.select(gunzip("data").alias("d")).first().d) == b"some bytes " * 50
    with pytest.raises(NotImplementedError):
        Compress("data", "zip").apply(df)
    try:
        import brotli  # noqa: F401
    except ImportError:
        with pytest.raises(NotImplementedError):
            Compress("data").apply(df)


def test_guarded_rows_fail_as_transient(people):
    got = errors(Guarded(Middleware({}), F.col("id") == 2).apply(people))
    assert got[2] == ("Circuit breaker is open", "Transient", "CircuitBreaker") and got[1] is None


def test_lineage_and_description(people):
    df = envelope.lineage(envelope.lineage(people, a="1", b="2"), b="3")
    assert df.first()["_metadata"] == {"a": "1", "b": "3"}
    bad = envelope.fail_where(people, F.lit(True), envelope.error("m"))
    assert bad.select(envelope.describe(F.col("_error")).alias("t")).first().t == "Type: Permanent, Category: N/A, Message: m"


def test_as_result(people):
    rows = {r.trace_id: r for r in envelope.as_result(Filter(F.col("age") >= 18).apply(people)).collect()}
    assert rows[1].is_success and rows[1].value.name == "Alice" and rows[1].error is None
    assert not rows[2].is_success and rows[2].value is None


def test_python_code_keeps_large_numbers_beside_nulls(spark):
    from millrace.operators.udf import PartitionTransform

    class Odd:
        def open(self):
            self.calls = 0

        def apply(self, batch):
            if (batch["id"] % 2 == 0).any():
                raise OSError("even")
            return batch.assign(name=batch["name"] + "!")

        def close(self):
            pass

    rows = [(1, 2**60 + 1, "a"), (2, None, "b"), (3, None, "c"), (4, 2**60 + 3, None)]
    df = envelope.wrap(spark.createDataFrame(rows, "id long, big long, name string"), "id")
    df = envelope.fail_where(df, F.col("id") == 3, envelope.error("earlier"))
    out = {r.id: (r.big, r.name, r["_error"] and (r["_error"]["message"], r["_error"]["type"])) for r in PartitionTransform(Odd).apply(df).collect()}
    assert out == {1: (2**60 + 1, "a!", None), 2: (None, "b", ("even", "Transient")), 3: (None, "c", ("earlier", "Permanent")), 4: (2**60 + 3, None, ("even", "Transient"))}
    same = {r.id: r.big for r in PythonMiddleware(lambda row: {"name": "x"}).apply(df).collect()}
    assert same == {1: 2**60 + 1, 2: None, 3: None, 4: 2**60 + 3}


def test_compress_bounds_its_batches(spark):
    from millrace.operators.transforms import Compress, gunzip

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(1 << 30))
    try:
        df = envelope.wrap(spark.range(3).select("id", F.encode(F.lit("ab"), "utf-8").alias("data")), "id")
        back = Compress("data", "gzip").apply(df).select(gunzip("data").alias("data"))
        assert int(spark.conf.get(name).rstrip("b")) <= 16 << 20
        assert [bytes(r.data) for r in back.collect()] == [b"ab"] * 3
    finally:
        spark.conf.set(name, before)
