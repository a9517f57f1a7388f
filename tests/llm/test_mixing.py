import hashlib
import math

from pyspark.sql import functions as F

from millrace.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not full:
            out |= {s: level * w[s] for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def brute(rows, quality, seed="mix"):
    sized = [(i, s, len((t or "").encode().split()), hashlib.md5((t or "").encode()).hexdigest() if i is None else i) for i, s, t in rows]
    total = {}
    for _, s, n, _ in sized:
        total[s] = total.get(s, 0) + n
    goal, out = brute_targets(total), []
    for s in total:
        def key(r):
            u = (int(hashlib.md5(f"{seed}:{r[3]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return (-math.log(u) / quality.get(r[0], 1.0), r[0] is not None, r[0] or 0, r[2])

        whole = math.floor(goal[s] / total[s]) if total[s] else 0
        rest, run = goal[s] - whole * total[s], 0
        for r in sorted((x for x in sized if x[1] == s), key=key):
            run += r[2]
            out.append((r[0], s, r[2], r[2] * (whole + (r[2] > 0 and run - r[2] / 2 <= rest))))
    return sorted(out, key=str), goal


def table(spark, rows):
    return spark.createDataFrame([(i, s, t) for i, s, t in rows], "doc_id long, source string, text string").withColumn("s", F.lit(1)).withColumn("size", F.lit(2)).withColumn("bin", F.lit(2))


def check(spark, rows, quality, **options):
    q = spark.createDataFrame(list(quality.items()), "doc_id long, weight double")
    got = mixing.mix(table(spark, rows), q, **options).collect()
    want, goal = brute(rows, quality)
    assert sorted(((r.doc_id, r.source, r.size, r.taken) for r in got), key=str) == want
    assert all(abs(r.target - goal[r.source]) < 1e-6 for r in got)
    assert all(r.taken <= 2 * r.size for r in got)
    return got


ROWS = [(i, f"src{i * i % 7}" if i % 11 else None, "w " * (i * 37 % 90)) for i in range(300)]


def test_matches_brute_force(spark):
    quality = {i: 2.0 if i % 2 else 0.5 for i in range(0, 300, 3)}
    got = check(spark, ROWS, quality)
    for buckets in (1, 7):
        assert sorted(map(str, check(spark, ROWS, quality, buckets=buckets))) == sorted(map(str, got))
    taken = {}
    for r in got:
        taken.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(t - goal) <= 90 for t, goal in taken.values())


def test_edges(spark):
    check(spark, [(1, "a", None), (2, "a", ""), (3, "b", " \t"), (None, None, "x y z"), (None, "b", "x"), (4, "b", "p q"), (4, "b", "p q"), (5, "c", "long " * 60000)], {4: 3.0})
    check(spark, [(1, "a", None)], {})
    check(spark, [], {1: 1.0})
    assert mixing.mix(table(spark, [(1, "a", "b c")])).count() == 1


def test_word_count(spark):
    texts = [None, "", " ", "a", " a", "a ", "\ta\x0b\x0cb\r\nc ", "é ü x", "a\x1fb c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.word_count(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [len((t or "").encode().split()) for t in texts]


def test_draw(spark):
    quality = spark.createDataFrame([], "doc_id long, weight double")
    got = mixing.draw(table(spark, ROWS), quality)
    assert got.columns == table(spark, []).columns
    want = {}
    for i, _, n, taken in brute(ROWS, {})[0]:
        if taken:
            want[i] = taken // n
    seen = {}
    for r in got.where("text <> ''").collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == want


def test_draw_takes_what_mix_takes_from_null_and_repeated_ids(spark):
    """Per source the words drawn are the words taken, with most ids null or repeated and rows all alike among them."""
    rows = [(None, "a", "w " * (1 + i % 9)) for i in range(200)] + [(i % 5, "b", "v " * (1 + i % 3)) for i in range(90)] + [(7, "c", "same words")] * 75 + [(None, None, "x y")] * 40
    rows += [(1000 + i, "d", "u " * (i % 30)) for i in range(120)] + [(None, "d", None)] * 3
    df = table(spark, rows).repartition(5)
    size = mixing.word_count(F.col("text")).alias("n")
    want = {r.source: r.taken for r in mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    drawn = mixing.draw(df)
    got = {r.source: r.taken for r in drawn.select("source", size).groupBy("source").agg(F.sum("n").alias("taken")).collect()}
    assert {k: got.get(k, 0) for k in want} == want
    per_key = lambda d: {(r.doc_id, r.source, r.n): r.c for r in d.groupBy("doc_id", "source", "n").agg(F.sum("c").alias("c")).where("c > 0").collect()}
    assert per_key(drawn.select("doc_id", "source", size, F.lit(1).alias("c")).where("n > 0")) == per_key(mixing.mix(df).select("doc_id", "source", F.col("size").alias("n"), F.col("copies").alias("c")).where("n > 0"))
    plan = drawn._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and drawn.columns == df.columns


def test_plan_is_native(spark):
    plan = mixing.mix(table(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
