"""The registered queries of the pipeline operators, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import secrets
from millrace.functions.hashing import fnv1a64, mix64
from millrace.operators import controllers, resilience, sketches
from millrace.operators.resilience import Attempted, RetryPolicy
from millrace.operators.transforms import Composite, Compress, Conditional, CsvReshape, Filter, JsonReshape, MapFields, Middleware, PythonMiddleware, Validation, gunzip
from millrace.operators.udf import PartitionTransform, spread
from millrace.plans import envelope
from millrace.plans.pipeline import Pipeline
from millrace.plans.storage import workspace
from millrace.sources.readers import Concat, ParquetSource, SqlSource, TableSource, merge
from millrace.streaming import metrics, runner

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(sf_dir: str, name: str) -> ParquetSource:
    return ParquetSource(f"{sf_dir}/{name}.parquet")


def start(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    return envelope.wrap(table(sf_dir, name).read(spark), key)


def net() -> Column:
    return F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)


LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# Projections, filters and row transforms


@query("SELECT l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS line, l_quantity AS quantity FROM lineitem")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"order_key": ("l_orderkey", None), "line": ("l_linenumber", "bigint"), "quantity": ("l_quantity", None)}
    return envelope.succeeded(MapFields(fields).apply(start(spark, sf_dir, "lineitem", "l_orderkey")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def middleware_net_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Middleware({"net": net()}).apply(start(spark, sf_dir, "lineitem", "l_orderkey"))
    return envelope.succeeded(df).select(*LINE, "net")


def big() -> Filter:
    return Filter(F.col("l_quantity") > 30)


def cheap() -> Filter:
    return Filter(F.col("l_extendedprice") < 20000)


def _filtered(spark: SparkSession, sf_dir: str, keep: Filter) -> DataFrame:
    return Pipeline().source(table(sf_dir, "lineitem")).options(compact=True).transform(keep).plan(spark).select(*LINE, "l_quantity", "l_extendedprice")


_FILTER = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem WHERE "


@query(_FILTER + "l_quantity > 30 AND l_extendedprice < 20000")
def filter_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, big() & cheap())


@query(_FILTER + "l_quantity > 30 OR l_extendedprice < 20000")
def filter_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, big() | cheap())


@query(_FILTER + "NOT coalesce(l_quantity > 30, false)")
def filter_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, ~big())


@query("SELECT coalesce(CASE WHEN o_totalprice > 100000 THEN NULL ELSE 'Filtered' END, 'none') AS category, count(*) AS n FROM orders GROUP BY 1")
def filter_envelope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Filter(F.col("o_totalprice") > 100000).apply(start(spark, sf_dir, "orders", "o_orderkey"))
    return df.groupBy(F.coalesce(F.col("_error.category"), F.lit("none")).alias("category")).agg(F.count("*").alias("n"))


def rules() -> Validation:
    return Validation().require(F.col("c_acctbal") >= 0, "negative balance").require(F.col("c_mktsegment") != "BUILDING", "wrong segment").within("c_nationkey", 0, 20)


_MESSAGES = "concat_ws('; ', CASE WHEN NOT coalesce(c_acctbal >= 0, false) THEN 'negative balance' END, CASE WHEN NOT coalesce(c_mktsegment <> 'BUILDING', false) THEN 'wrong segment' END, CASE WHEN NOT (c_nationkey IS NULL OR c_nationkey BETWEEN 0 AND 20) THEN 'The field c_nationkey must be between 0 and 20.' END)"


@query(f"SELECT c_custkey, {_MESSAGES} = '' AS is_success, nullif({_MESSAGES}, '') AS message FROM customer")
def validation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rules().apply(start(spark, sf_dir, "customer", "c_custkey"))
    return df.select("c_custkey", envelope.ok().alias("is_success"), F.col("_error.message").alias("message"))


@query(f"SELECT c_custkey, c_name FROM customer WHERE {_MESSAGES} = ''")
def validation_to_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.succeeded(rules().to_filter().compact(start(spark, sf_dir, "customer", "c_custkey"))).select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_quantity > 40 THEN l_discount + 0.05 ELSE l_discount END, 4) AS l_discount FROM lineitem")
def conditional_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Conditional(F.col("l_quantity") > 40, {"l_discount": F.col("l_discount") + 0.05}).apply(start(spark, sf_dir, "lineitem", "l_orderkey"))
    return envelope.succeeded(df).select(*LINE, F.round("l_discount", 4).alias("l_discount"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice <= 50000 THEN 'too small' WHEN o_orderstatus = 'F' THEN 'finished' END AS message, CASE WHEN o_totalprice > 50000 AND o_orderstatus <> 'F' THEN round(o_totalprice * 2, 2) END AS doubled FROM orders")
def composite_short_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [Validation().require(F.col("o_totalprice") > 50000, "too small"), Validation().require(F.col("o_orderstatus") != "F", "finished"), Middleware({"doubled": F.round(F.col("o_totalprice") * 2, 2)})]
    df = Composite(steps).apply(start(spark, sf_dir, "orders", "o_orderkey"))
    return df.select("o_orderkey", F.col("_error.message").alias("message"), "doubled")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = start(spark, sf_dir, "events", "event_id").drop("ts", "user_id", "event_type", "value")
    return envelope.succeeded(JsonReshape(T.StructType().add("k", T.IntegerType()), "props").apply(df)).select("event_id", "k")


@query("SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier")
def csv_reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = T.StructType().add("s_suppkey", "long").add("s_name", "string").add("s_nationkey", "long")
    return envelope.succeeded(CsvReshape(shape).apply(start(spark, sf_dir, "supplier", "s_suppkey")))


@query("SELECT s_suppkey AS id, upper(s_name) AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def map_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"id": ("s_suppkey", "bigint"), "name": (F.upper("s_name"), None), "nation": ("s_nationkey", "string")}
    return envelope.succeeded(MapFields(fields).apply(start(spark, sf_dir, "supplier", "s_suppkey")))


@query("SELECT p_partkey, NOT (p_size % 7 = 0) AS is_success, CASE WHEN p_size % 7 = 0 THEN 'Middleware' END AS category, CASE WHEN p_size % 7 <> 0 THEN p_size * 2 ELSE p_size END AS p_size FROM part")
def python_middleware(spark: SparkSession, sf_dir: str) -> DataFrame:
    def double(row: dict) -> dict:
        if row["p_size"] % 7 == 0:
            raise ValueError("a multiple of seven")
        return {"p_size": row["p_size"] * 2}

    df = start(spark, sf_dir, "part", "p_partkey").select("p_partkey", "p_size", *envelope.ENVELOPE)
    return PythonMiddleware(double).apply(df).select("p_partkey", envelope.ok().alias("is_success"), F.col("_error.category").alias("category"), "p_size")


@query("SELECT doc_id, strlen(text) AS n_bytes, sha256(text) AS digest FROM documents")
def compress_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = start(spark, sf_dir, "documents", "doc_id").select("doc_id", F.col("text").cast("binary").alias("data"), *envelope.ENVELOPE)
    back = Compress("data", "gzip").apply(df).select("doc_id", gunzip("data").alias("data"))
    return back.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("digest"))


# Sources


@query("SELECT 0 AS ord, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier")
def multi_source_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = TableSource(table(sf_dir, "customer")).with_query(lambda d: d.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    b = TableSource(table(sf_dir, "supplier")).with_query(lambda d: d.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    return Concat((a, b), "ord").read(spark)


@query("SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def merge_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(sf_dir, "customer").read(spark).select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = table(sf_dir, "supplier").read(spark).select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return merge(a, b, b)


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY 1")
def table_source_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = TableSource(table(sf_dir, "orders")).with_query(lambda d: d.where("o_totalprice > 150000").groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    return source.read(spark)


# Dedup, shards and sketches


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def dedup_lineitem_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(sf_dir, "lineitem").read(spark)
    return sketches.dedup(df, ("l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def dedup_documents_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(sf_dir, "documents").read(spark).select("doc_id", F.sha2("text", 256).alias("key"), F.md5(F.col("text").cast("binary")).alias("digest"))
    return df.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("digest").alias("digest")).select("doc_id", "digest")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id % 3 = 0)")
def dedup_remove_readd(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(sf_dir, "events").read(spark)
    return sketches.remove_keys(df, df.where("event_type = 'error' AND user_id % 3 = 0"), ["user_id"]).select("event_id", "user_id")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def merge_dedup_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(sf_dir, "customer").read(spark).select(F.col("c_nationkey").alias("k"))
    return sketches.merge_keys(a, table(sf_dir, "supplier").read(spark).select(F.col("s_nationkey").alias("k")))


_JUMP = """WITH RECURSIVE j(o_orderkey, key, b, j) AS (
  SELECT o_orderkey, CAST(o_orderkey AS UBIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT DISTINCT o_orderkey FROM orders)
  UNION ALL
  SELECT o_orderkey, k2, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST((k2 >> 33) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT o_orderkey, j, CAST((CAST(key AS UHUGEINT) * 2862933555777941757 + 1) % 18446744073709551616 AS UBIGINT) AS k2 FROM j WHERE j < 10))
SELECT o.o_orderkey, CAST(s.b AS INTEGER) AS shard FROM orders o JOIN (SELECT o_orderkey, max(b) AS b FROM j GROUP BY o_orderkey) s USING (o_orderkey)"""


@query(_JUMP)
def jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.shards(table(sf_dir, "orders").read(spark).select("o_orderkey"), "o_orderkey", 10)


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM orders")
def shard_repartition(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sketches.reshard(table(sf_dir, "orders").read(spark).select("o_orderkey"), "o_orderkey", 8)
    return df.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))




def _hll_sql(source: str, group: str = "") -> str:
    g, on = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    mod = "18446744073709551616"
    return f"""WITH k AS ({source}),
a AS (SELECT {g}CAST((CAST(xor(x, x >> 33) AS UHUGEINT) * 18397679294719823053) % {mod} AS UBIGINT) AS x FROM k),
b AS (SELECT {g}CAST((CAST(xor(x, x >> 33) AS UHUGEINT) * 14181476777654086739) % {mod} AS UBIGINT) AS x FROM a),
c AS (SELECT {g}xor(x, x >> 33) AS h FROM b),
r AS (SELECT {g}h & 4095 AS idx, max(CASE WHEN h >> 12 = 0 THEN 64 ELSE 64 - length(ltrim(bin(h >> 12), '0')) END - 12 + 1) AS rank FROM c GROUP BY {g}idx),
e AS (SELECT {g}4096 - count(*) AS zeros, (0.7213 / (1 + 1.079 / 4096::DOUBLE)) * 16777216::DOUBLE / (4096 - count(*) + sum(pow(2.0::DOUBLE, -rank))) AS raw FROM r {on})
SELECT {g}round(CASE WHEN raw <= 10240 AND zeros > 0 THEN 4096::DOUBLE * ln(4096::DOUBLE / zeros) ELSE raw END, 6) AS estimate FROM e"""


@query(_hll_sql("SELECT event_type, CAST(user_id * 1000003 + event_id AS UBIGINT) AS x FROM events", "event_type"))
def hll_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(sf_dir, "events").read(spark).select("event_type", (F.col("user_id") * 1000003 + F.col("event_id")).alias("x"))
    out = sketches.hll_estimate(sketches.hll_registers(df, "x", 12, "event_type"), 12, "event_type")
    return out.select("event_type", F.round("estimate", 6).alias("estimate"))


@query(_hll_sql("SELECT CAST(l_orderkey AS UBIGINT) AS x FROM lineitem UNION ALL SELECT CAST(o_orderkey AS UBIGINT) FROM orders"))
def hll_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = sketches.hll_registers(table(sf_dir, "lineitem").read(spark), "l_orderkey")
    b = sketches.hll_registers(table(sf_dir, "orders").read(spark), "o_orderkey")
    return sketches.hll_estimate(sketches.hll_merge(a, b)).select(F.round("estimate", 6).alias("estimate"))


@query("SELECT event_type, true AS close FROM events GROUP BY 1")
def hll_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sketch's count is within 5 per cent of the exact one, per type."""
    df = table(sf_dir, "events").read(spark)
    sketch = sketches.distinct_count(df, "event_id", "event_type")
    exact = df.groupBy("event_type").agg(F.count_distinct("event_id").alias("exact"))
    return sketch.join(exact, "event_type").select("event_type", (F.abs(F.col("estimate") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


@query("""WITH b AS (SELECT event_type, least(greatest(CAST(trunc(ln(value) / ln(pow(1000000.0::DOUBLE, 0.01))) AS INTEGER), 0), 99) AS b, count(*) AS n FROM events WHERE value > 0 GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY b) AS run, sum(n) OVER (PARTITION BY event_type) AS total FROM b),
m AS (SELECT event_type, min(CASE WHEN run >= floor(total * 0.5::DOUBLE) THEN b END) AS a, min(CASE WHEN run >= floor(total * 0.95::DOUBLE) THEN b END) AS c, min(CASE WHEN run >= floor(total * 0.99::DOUBLE) THEN b END) AS d FROM r GROUP BY 1)
SELECT event_type, round(pow(pow(1000000.0::DOUBLE, 0.01), a + 0.5), 6) AS p50, round(pow(pow(1000000.0::DOUBLE, 0.01), c + 0.5), 6) AS p95, round(pow(pow(1000000.0::DOUBLE, 0.01), d + 0.5), 6) AS p99 FROM m""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sketches.LogHistogram().percentiles(table(sf_dir, "events").read(spark), "value", by="event_type")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query("""WITH k AS (SELECT event_id, CAST(event_id AS UBIGINT) AS x FROM events),
a AS (SELECT event_id, CAST((CAST(xor(x, x >> 33) AS UHUGEINT) * 18397679294719823053) % 18446744073709551616 AS UBIGINT) AS x FROM k),
b AS (SELECT event_id, CAST((CAST(xor(x, x >> 33) AS UHUGEINT) * 14181476777654086739) % 18446744073709551616 AS UBIGINT) AS x FROM a)
SELECT event_id FROM b ORDER BY xor(x, x >> 33), event_id LIMIT 50""")
def reservoir_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.bottom_k(table(sf_dir, "events").read(spark).select("event_id"), "event_id", 50)


@query("""WITH k AS (SELECT event_type, event_id, CAST(event_id AS UBIGINT) AS x FROM events),
a AS (SELECT event_type, event_id, CAST((CAST(xor(x, x >> 33) AS UHUGEINT) * 18397679294719823053) % 18446744073709551616 AS UBIGINT) AS x FROM k),
b AS (SELECT event_type, event_id, CAST((CAST(xor(x, x >> 33) AS UHUGEINT) * 14181476777654086739) % 18446744073709551616 AS UBIGINT) AS x FROM a)
SELECT event_type, event_id FROM b QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY xor(x, x >> 33), event_id) <= 20""")
def reservoir_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.bottom_k(table(sf_dir, "events").read(spark).select("event_type", "event_id"), "event_id", 20, "event_type")


@query("SELECT 50 AS n, 50 AS n_distinct, true AS all_members")
def reservoir_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any uniform sample of 50 events: its size, no repeats, members only."""
    df = table(sf_dir, "events").read(spark).select("event_id")
    s = sketches.uniform_sample(df, 50, seed=7)
    found = s.join(df.withColumn("there", F.lit(True)), "event_id", "left")
    return found.agg(F.count("*").cast("int").alias("n"), F.count_distinct("event_id").cast("int").alias("n_distinct"), F.every(F.coalesce("there", F.lit(False))).alias("all_members"))


@query("""WITH k AS (SELECT s_suppkey, CAST(s_suppkey AS UBIGINT) AS x FROM supplier), a AS (SELECT s_suppkey, CAST((CAST(xor(x, x >> 33) AS UHUGEINT) * 18397679294719823053) % 18446744073709551616 AS UBIGINT) AS x FROM k),
b AS (SELECT s_suppkey, CAST((CAST(xor(x, x >> 33) AS UHUGEINT) * 14181476777654086739) % 18446744073709551616 AS UBIGINT) AS x FROM a) SELECT s_suppkey, upper(lpad(hex(xor(x, x >> 33)), 16, '0')) AS mixed FROM b""")
def mix64_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(sf_dir, "supplier").read(spark).select("s_suppkey", F.lpad(F.hex(mix64("s_suppkey")), 16, "0").alias("mixed"))


@query("""SELECT s_suppkey, upper(lpad(hex(list_reduce([14695981039346656037::UBIGINT] || [CAST((s_suppkey >> (8 * i)) & 255 AS UBIGINT) FOR i IN range(8)], lambda h, b: CAST((CAST(xor(h, b) AS UHUGEINT) * 1099511628211) % 18446744073709551616 AS UBIGINT))), 16, '0')) AS fnv FROM supplier""")
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(sf_dir, "supplier").read(spark).select("s_suppkey", F.lpad(F.hex(fnv1a64("s_suppkey")), 16, "0").alias("fnv"))


# Ordered recurrences

_EMA = """WITH RECURSIVE o AS (SELECT user_id, CAST(value AS DOUBLE) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, i, CASE WHEN 0 < 0.001 THEN x END AS level, x AS velocity FROM o WHERE i = 1
UNION ALL
SELECT user_id, i, new, CASE WHEN velocity < 0.001 THEN new - level ELSE 0.1::DOUBLE * (new - level) + 0.9::DOUBLE * velocity END FROM
(SELECT f.user_id, o.i, f.level, f.velocity, CASE WHEN f.level < 0.001 THEN o.x WHEN f.level > 0.001 AND o.x > 3 * f.level THEN 0.8::DOUBLE * o.x + 0.2::DOUBLE * f.level ELSE 0.2::DOUBLE * o.x + 0.8::DOUBLE * f.level END AS new
 FROM f JOIN o ON f.user_id = o.user_id AND o.i = f.i + 1))
SELECT user_id, i AS n, round(level, 6) AS level, round(velocity, 6) AS velocity, round(greatest(0, level + velocity), 6) AS prediction FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1"""


@query(f"SELECT user_id, level FROM ({_EMA})")
def ema_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = controllers.ema(table(sf_dir, "events").read(spark), "user_id", ["ts", "event_id"], "value")
    return out.select("user_id", F.round("level", 6).alias("level"))


@query(_EMA)
def ema_velocity_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = controllers.ema(table(sf_dir, "events").read(spark), "user_id", ["ts", "event_id"], "value")
    return out.select("user_id", F.col("n").cast("long").alias("n"), *[F.round(c, 6).alias(c) for c in ("level", "velocity", "prediction")])


@query("""WITH RECURSIVE o AS (SELECT user_id, epoch(ts) - lag(epoch(ts)) OVER w AS gap, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT user_id, i, 0.0::DOUBLE AS tp FROM o WHERE i = 1 UNION ALL
SELECT f.user_id, o.i, CASE WHEN o.gap > 0 THEN CASE WHEN f.tp < 0.001 THEN 1.0::DOUBLE / o.gap ELSE 0.2::DOUBLE * (1.0::DOUBLE / o.gap) + 0.8::DOUBLE * f.tp END ELSE f.tp END FROM f JOIN o ON f.user_id = o.user_id AND o.i = f.i + 1)
SELECT user_id, round(tp, 8) AS throughput FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def throughput_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = controllers.throughput(table(sf_dir, "events").read(spark), "user_id", ["ts", "event_id"], "ts")
    return out.select("user_id", F.round("throughput", 8).alias("throughput"))


@query("""WITH RECURSIVE o AS (SELECT user_id, CAST(value AS DOUBLE) / 10 AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, 8 AS p FROM (SELECT DISTINCT user_id FROM events) UNION ALL
SELECT f.user_id, o.i, CASE WHEN abs(10 - o.x) < 5 OR (f.p >= 32 AND 10 - o.x > 0) OR (f.p <= 2 AND 10 - o.x < 0) THEN f.p
 ELSE greatest(2, least(32, f.p + CASE WHEN 10 - o.x > 0 THEN 1 ELSE -1 END * greatest(1, least(3, CAST(trunc(abs(10 - o.x) / 20) AS INTEGER))))) END FROM f JOIN o ON f.user_id = o.user_id AND o.i = f.i + 1)
SELECT user_id, i AS n, p AS parallelism FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def parallelism_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(sf_dir, "events").read(spark).withColumn("ms", F.col("value") / 10)
    return controllers.parallelism(df, "user_id", ["ts", "event_id"], "ms", cpu=8).withColumn("n", F.col("n").cast("long"))


@query("""WITH t AS (SELECT event_id, (event_id % 100) / 100.0::DOUBLE AS fill, CAST(user_id * 10 AS DOUBLE) AS tp, CAST(value AS DOUBLE) AS lat FROM events),
g AS (SELECT *, CASE WHEN tp > 1000 THEN 0.50::DOUBLE WHEN tp < 100 THEN 0.85::DOUBLE ELSE 0.70::DOUBLE END AS base FROM t),
d AS (SELECT event_id, least(greatest(100.0::DOUBLE * (fill - CASE WHEN lat > 50 THEN greatest(0.30::DOUBLE, base - 0.10::DOUBLE) ELSE base END), 0), 200) AS d FROM g)
SELECT event_id, round(CASE WHEN d > 1 THEN d ELSE 0 END, 6) AS delay_ms FROM d""")
def backpressure_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(sf_dir, "events").read(spark)
    delay = controllers.backpressure_delay((F.col("event_id") % 100) / F.lit(100.0), (F.col("user_id") * 10).cast("double"), F.col("value"))
    return df.select("event_id", F.round(delay, 6).alias("delay_ms"))


# Failure handling


@query("""SELECT p.name AS policy, o_orderkey, a.i AS attempt, least(greatest(CASE p.name WHEN 'fixed' THEN 1000 WHEN 'linear' THEN 1000 * a.i ELSE 1000 * pow(2.0::DOUBLE, a.i - 1) END, 0.0001), 30000)::DOUBLE AS delay_ms, a.i <= CASE WHEN a.i % 2 = 0 THEN 4 ELSE 3 END AS allowed
FROM (VALUES ('fixed'), ('linear'), ('exponential')) p(name), (SELECT o_orderkey, o_orderkey % 10 + 1 AS i FROM orders) a""")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt = F.col("o_orderkey") % 10 + 1
    base = table(sf_dir, "orders").read(spark).select("o_orderkey", attempt.alias("attempt"), F.when(attempt % 2 == 0, 4).otherwise(-1).alias("budget"))
    parts = [resilience.schedule(base, "attempt", RetryPolicy(backoff=b), "budget").withColumn("policy", F.lit(b)) for b in ("fixed", "linear", "exponential")]
    return merge(*parts).drop("budget")


def _orders_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = start(spark, sf_dir, "orders", "o_orderkey")
    df = envelope.fail_where(df, F.col("o_orderstatus") == "P", envelope.error("still pending", envelope.TRANSIENT, "Timeout"))
    df = envelope.fail_where(df, F.col("o_totalprice") < 10000, envelope.error("too small", envelope.PERMANENT, "Validation"))
    return Filter(F.col("o_orderpriority") != "5-LOW").apply(df)


_JUDGED = "CASE WHEN o_orderstatus = 'P' THEN 'retry' WHEN o_totalprice < 10000 THEN 'dead_letter' WHEN o_orderpriority <> '5-LOW' THEN 'sink' ELSE 'filtered' END"


@query(f"SELECT {_JUDGED} AS route, count(*) AS n FROM orders GROUP BY 1")
def error_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resilience.route(_orders_judged(spark, sf_dir)).groupBy("route").agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey AS trace_id, o_totalprice, CASE {_JUDGED} WHEN 'retry' THEN 'still pending' ELSE 'too small' END AS message, CASE {_JUDGED} WHEN 'retry' THEN 'Transient' ELSE 'Permanent' END AS type FROM orders WHERE {_JUDGED} IN ('retry', 'dead_letter')")
def dead_letter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = resilience.dead_letters(_orders_judged(spark, sf_dir))
    return letters.select("trace_id", "value.o_totalprice", "error.message", "error.type")


@query(f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE {_JUDGED} IN ('retry', 'dead_letter')")
def dead_letter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resilience.replay(resilience.dead_letters(_orders_judged(spark, sf_dir))).select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"SELECT o_orderkey, 'Type: ' || CASE {_JUDGED} WHEN 'retry' THEN 'Transient, Category: Timeout, Message: still pending' ELSE 'Permanent, Category: Validation, Message: too small' END AS line FROM orders WHERE {_JUDGED} IN ('retry', 'dead_letter')")
def error_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = envelope.failed(_orders_judged(spark, sf_dir))
    return bad.select("o_orderkey", envelope.describe(F.col("_error")).alias("line"))


@query("""SELECT event_id, event_type <> 'error' OR event_id % 5 <= 3 AS is_success, CASE WHEN event_type = 'error' THEN least(CAST(event_id % 5 AS INTEGER) + 1, 4) ELSE 1 END AS attempts,
CASE WHEN event_type = 'error' AND event_id % 5 > 3 THEN 'Transient' END AS error_type FROM events""")
def retry_until_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors fail as often as event_id mod 5 says before they succeed; three retries are allowed."""

    def flaky(row: dict, attempt: int) -> dict:
        if row["event_type"] == "error" and attempt <= row["event_id"] % 5:
            raise TimeoutError("not yet")
        return {}

    df = start(spark, sf_dir, "events", "event_id").select("event_id", "event_type", *envelope.ENVELOPE)
    return Attempted(flaky, RetryPolicy(3)).apply(df).select("event_id", envelope.ok().alias("is_success"), "attempts", F.col("_error.type").alias("error_type"))


# The state machine event by event; the window is a list of (time, good).
@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS t, event_type <> 'error' AS good, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, false AS allowed, 'Closed' AS st, 0.0::DOUBLE AS ewma, 0.0::DOUBLE AS opened, 0 AS probes, 0 AS wins, []::STRUCT(t DOUBLE, g BOOLEAN)[] AS w FROM events
UNION ALL
SELECT user_id, i, event_id, allowed, CASE WHEN closes THEN 'Closed' WHEN opens THEN 'Open' ELSE st1 END, CASE WHEN closes THEN 0.0 ELSE ewma2 END, CASE WHEN opens THEN t ELSE opened1 END,
  CASE WHEN closes OR opens THEN 0 ELSE probes2 END, CASE WHEN closes OR opens THEN 0 ELSE wins2 END, w3 FROM
(SELECT *, allowed AND good AND st1 = 'HalfOpen' AND wins2 >= 2 AS closes,
  allowed AND NOT good AND len(w3) >= 5 AND len(list_filter(w3, lambda x: NOT x.g))::DOUBLE / len(w3) >= 0.3::DOUBLE AND st1 IN ('Closed', 'HalfOpen') AS opens FROM
(SELECT *, CASE WHEN allowed AND NOT good AND ewma2 > 1.5::DOUBLE * 0.3::DOUBLE THEN list_append(w2, {'t': t, 'g': false}) ELSE w2 END AS w3 FROM
(SELECT *, CASE WHEN allowed THEN list_append(w1, {'t': t, 'g': good}) ELSE w1 END AS w2, wins1 + (allowed AND good AND st1 = 'HalfOpen')::INTEGER AS wins2,
  CASE WHEN allowed THEN (1.0::DOUBLE - alpha) * ewma + CASE WHEN good THEN 0.0::DOUBLE ELSE alpha END ELSE ewma END AS ewma2 FROM
(SELECT *, CASE WHEN st1 = 'HalfOpen' THEN probes2 <= 3 ELSE st1 = 'Closed' END AS allowed FROM
(SELECT *, probes1 + (st1 = 'HalfOpen')::INTEGER AS probes2 FROM
(SELECT *, CASE WHEN renew THEN 'HalfOpen' ELSE st END AS st1, CASE WHEN renew THEN t ELSE opened END AS opened1, CASE WHEN renew THEN 0 ELSE probes END AS probes1, CASE WHEN renew THEN 0 ELSE wins END AS wins1 FROM
(SELECT o.*, f.st, f.ewma, f.opened, f.probes, f.wins, CASE WHEN f.ewma > 0.1 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS alpha, list_filter(f.w, lambda x: x.t >= o.t - 604800) AS w1,
  o.t - f.opened >= 86400 AND (f.st = 'Open' OR f.st = 'HalfOpen' AND f.probes >= 3) AS renew FROM f JOIN o ON f.user_id = o.user_id AND o.i = f.i + 1))))))))
SELECT user_id, event_id, allowed, st AS cb_state, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: NOT x.g))::DOUBLE / len(w) ELSE 0 END, 9) AS cb_failure_ratio, round(ewma, 9) AS cb_ewma_failure_rate, CAST(probes AS INTEGER) AS cb_half_open_attempts FROM f WHERE i > 0""")
def breaker_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(sf_dir, "events").read(spark).withColumn("ok", F.col("event_type") != "error")
    out = resilience.breaker_replay(df, "user_id", "ts", "event_id", "ok", failure_ratio=0.3, sampling_s=7 * 86400, least=5, break_s=86400)
    return out.withColumns({c: F.round(c, 9) for c in ("cb_failure_ratio", "cb_ewma_failure_rate")})


@query("""SELECT event_id, count(*) OVER w AS window_total, count(*) FILTER (WHERE event_type = 'error') OVER w AS window_failures, round((count(*) FILTER (WHERE event_type = 'error') OVER w) / (count(*) OVER w)::DOUBLE, 9) AS failure_ratio
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""")
def failure_ratio_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(sf_dir, "events").read(spark).withColumn("ok", F.col("event_type") != "error")
    out = resilience.failure_ratio(df, "ok", "ts", 86400, ("user_id",))
    return out.select("event_id", "window_total", "window_failures", F.round("failure_ratio", 9).alias("failure_ratio"))


# Metrics, health, lineage, secrets


def _checked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = start(spark, sf_dir, "lineitem", "l_orderkey")
    return Composite([Validation().require(F.col("l_quantity") <= 45, "qty>45"), Filter(F.col("l_tax") < 0.08), Middleware({"net": net()})]).apply(df)


_COUNTS = "count(*) AS items_processed, count(*) FILTER (WHERE l_quantity <= 45 AND l_tax < 0.08) AS items_succeeded, count(*) FILTER (WHERE l_quantity > 45) AS items_failed, count(*) FILTER (WHERE l_quantity <= 45 AND l_tax >= 0.08) AS items_filtered"


@query(f"SELECT {_COUNTS} FROM lineitem")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(_checked_lines(spark, sf_dir))


@query("SELECT l_returnflag, CASE WHEN count(*) FILTER (WHERE l_quantity > 45) > 0 THEN 'Degraded' ELSE 'Healthy' END AS status FROM lineitem GROUP BY 1")
def health_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _checked_lines(spark, sf_dir).groupBy("l_returnflag").agg(*metrics.counters())
    return per.select("l_returnflag", metrics.readiness(F.lit(0), F.col("items_failed")).alias("status"))


@query("SELECT n_nationkey, n_nationkey AS trace_id, 'nation' AS source, 'demo' AS pipeline, 'upper' AS transform FROM nation")
def lineage_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = envelope.wrap(table(sf_dir, "nation").read(spark), "n_nationkey", source="nation", pipeline="demo")
    df = envelope.lineage(df, lineage_transform="upper")
    m = F.col("_metadata")
    return df.select("n_nationkey", F.col("_trace_id").cast("int").alias("trace_id"), m["lineage_source"].alias("source"), m["lineage_pipeline"].alias("pipeline"), m["lineage_transform"].alias("transform"))


def _re(p: str) -> str:
    return p.replace("'", "''")


_FOUND = " OR ".join(f"regexp_matches(coalesce(text, ''), '{_re(p)}')" for p in secrets.PATTERNS.values())


def _redacted() -> str:
    out = "text"
    for p in secrets.PATTERNS.values():
        out = f"regexp_replace({out}, '{_re(p)}', '{secrets.MASK}', 'g')"
    return out


@query(f"SELECT doc_id, ({_FOUND}) AS has_secret FROM documents")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(sf_dir, "documents").read(spark).select("doc_id", secrets.has_plain_secrets(F.col("text")).alias("has_secret"))


@query()
def secret_scan_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan that also looks into Base64 and percent coding, three layers deep."""
    return table(sf_dir, "documents").read(spark).select("doc_id", secrets.has_secrets(F.col("text")).alias("has_secret"))


@query(f"SELECT doc_id, sha256({_redacted()}) AS digest FROM documents")
def secret_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(sf_dir, "documents").read(spark).select("doc_id", F.sha2(secrets.redact(F.col("text")), 256).alias("digest"))


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def newest_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.newest_per_key(table(sf_dir, "events").read(spark), ["user_id"], ["ts", "event_id"], 3).select("event_id", "user_id")


class _Halver:
    """Halves account balances of customers; refuses negative ones."""

    def open(self) -> None:
        self.factor = 0.5

    def apply(self, batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["c_acctbal"] < 0).any():
            raise ValueError("negative balance")
        return batch.assign(c_acctbal=batch["c_acctbal"] * self.factor)

    def close(self) -> None: ...


@query("SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN c_acctbal ELSE c_acctbal * 0.5 END, 4) AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'negative balance' END AS message FROM customer")
def partition_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = start(spark, sf_dir, "customer", "c_custkey").select("c_custkey", "c_acctbal", *envelope.ENVELOPE)
    return PartitionTransform(_Halver).apply(spread(df)).select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"), F.col("_error.message").alias("message"))


# Streams, run over all that has arrived, into the shared folder

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may name a file or a folder


def _settled(df: DataFrame, mode: str) -> DataFrame:
    """What a stream writes; of updates, each batch's rows with its number."""
    spark = df.sparkSession
    out, marks = workspace(spark, "stream"), workspace(spark, "marks")
    write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType([*df.schema, T.StructField("batch", T.LongType())])).parquet(out)


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives twice; one of each pair stays."""
    df = _arrived(spark, sf_dir)
    return _settled(runner.stream_dedup(merge(df, df), ["event_id"], "ts", "1 hour"), "append").select("event_id", "user_id")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = (F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    out = _settled(runner.tumbling(_arrived(spark, sf_dir), "ts", "1 hour", "6 hours", ["event_type"], *aggs), "complete")
    return out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query(f"SELECT user_id, n, level, velocity FROM ({_EMA})")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's running state after the last batch: rows seen, level and velocity."""
    events = _arrived(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _settled(runner.stream_ema(events, "user_id", "ts", "value", order=["event_id"]), "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n", "level", "velocity"), "n").alias("s"))
    return last.select("user_id", "s.n", F.round("s.level", 6).alias("level"), F.round("s.velocity", 6).alias("velocity"))


# SQL through the SQL source

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SQL: dict[str, tuple[str, dict]] = {
    "sql_q1_pricing": ("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""", {}),
    "sql_q3_shipping": ("""SELECT o.o_orderkey, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE c.c_mktsegment = :segment GROUP BY o.o_orderkey ORDER BY revenue DESC, o.o_orderkey LIMIT 10""", {"segment": "BUILDING"}),
    "sql_q5_local_supplier": ("""SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = :region GROUP BY n.n_name""", {"region": "ASIA"}),
    "sql_q6_forecast": ("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_discount BETWEEN :low AND :high AND l_quantity < 24", {"low": 0.05, "high": 0.07}),
    "sql_outer_joins": ("SELECT n.n_name, count(c.c_custkey) AS customers, count(s.s_suppkey) AS suppliers FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey FULL JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000 GROUP BY n.n_name", {}),
    "sql_semi_anti": ("SELECT c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_totalprice > 300000) AS big FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", {}),
    "sql_theta_join": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", {}),
    "sql_range_join": ("SELECT e.event_id, count(*) AS near FROM events e JOIN events f ON e.user_id = f.user_id AND f.ts BETWEEN e.ts - INTERVAL 1 DAY AND e.ts GROUP BY e.event_id", {}),
    "sql_window": ("""SELECT o_orderkey, o_custkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS rk, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running,
lag(o_orderkey) OVER w AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""", {}),
    "sql_topk_per_group": ("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) t WHERE r <= 3", {}),
    "sql_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", {}),
    "sql_rollup": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", {}),
    "sql_grouping_sets": ("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())", {}),
    "sql_distinct_agg": ("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus", {}),
    "sql_set_ops": ("(SELECT c_nationkey AS k, 'both' AS w FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'customers' FROM customer EXCEPT SELECT s_nationkey, 'customers' FROM supplier)", {}),
    "sql_broadcast_hint": ("SELECT /*+ BROADCAST(n) */ n.n_name, count(*) AS n FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name", {}),
    "sql_date_functions": ("SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR(10)) AS m, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(CAST(o_orderdate + INTERVAL 10 DAY AS DATE) AS VARCHAR(10)) AS later FROM orders", {}),
    "sql_math_functions": ("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS log, CAST(floor(p_retailprice / 7) AS BIGINT) AS whole, CAST(p_size % 7 AS INTEGER) AS rest, greatest(p_size, 25) AS most, round(pow(p_size, 1.5), 4) AS power, CAST(sign(p_size - 25) AS INTEGER) AS s FROM part", {}),
    "sql_text_functions": ("SELECT c_custkey, upper(c_mktsegment) AS u, length(c_name) AS n, replace(c_name, '#', '-') AS r, substring(c_name, 1, 5) AS h, lpad(CAST(c_nationkey AS VARCHAR(9)), 4, '0') AS p, concat_ws('/', c_mktsegment, c_name) AS j FROM customer", {}),
    "sql_cte_subquery": ("WITH spent AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) SELECT o_custkey, total FROM spent WHERE total > (SELECT avg(total) * 1.5 FROM spent)", {}),
    "sql_correlated": ("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem l WHERE l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem m WHERE m.l_partkey = l.l_partkey)", {}),
}


def _sql_query(name: str, sql: str, params: dict) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views = {t: f"{sf_dir}/{t}.parquet" for t in TABLES if f"{t} " in f"{sql} " or f"{t})" in sql or f"{t}\n" in sql}
        return SqlSource(sql, params, views).read(spark)

    QUERIES[name] = run
    oracle = sql
    for k, v in params.items():
        oracle = oracle.replace(f":{k}", f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE")
    ORACLE_SQL[name] = oracle


for _name, (_sql, _params) in SQL.items():
    _sql_query(_name, _sql, _params)


@query("""SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'error' AND (p.ts < e.ts OR (p.ts = e.ts AND p.event_id <= e.event_id))) AS last_error FROM events e""")
def asof_last_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join as a window: the latest error of the same user at or before each event."""
    return SqlSource("SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_error FROM events", views={"events": f"{sf_dir}/events.parquet"}).read(spark)


@query("""SELECT o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') AS orders, CAST(len(list_distinct(list(o_orderstatus))) AS INTEGER) AS kinds, list_sum(list_transform(list_sort(list(o_orderkey))[1:3], lambda x: x * 2))::BIGINT AS doubled, list_contains(list(o_orderpriority), '1-URGENT') AS urgent FROM orders GROUP BY o_custkey""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array_sort(F.collect_list("o_orderkey"))
    grouped = table(sf_dir, "orders").read(spark).groupBy("o_custkey").agg(keys.alias("orders"), F.collect_set("o_orderstatus").alias("s"), F.collect_set("o_orderpriority").alias("p"))
    doubled = F.aggregate(F.transform(F.slice("orders", 1, 3), lambda x: x * 2), F.lit(0).cast("long"), lambda a, x: a + x)
    return grouped.select("o_custkey", F.array_join(F.col("orders").cast("array<string>"), ",").alias("orders"), F.size("s").alias("kinds"), doubled.alias("doubled"), F.array_contains("p", "1-URGENT").alias("urgent"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items checked, priced and enveloped: one result row per input row."""
    pipeline = Pipeline(name="flagship").source(table(sf_dir, "lineitem")).keyed("l_orderkey").transform(Validation().require(F.col("l_quantity") <= 45, "qty>45"), Middleware({"net": net()}))
    return envelope.as_result(pipeline.plan(spark))
