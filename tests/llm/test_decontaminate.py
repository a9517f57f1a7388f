import random
import re

from pyspark.sql import functions as F

from millrace.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, window):
    windows = {}
    for name, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add("" if name is None else str(name))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                names = windows.get(tuple(w[k : k + n]))
                if names:
                    hit.update(range(k, k + n))
                    found |= names
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(spark, frame, rows, items, window, **options):
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(frame(rows), table, window=window, **options).select("doc_id", "match.*").collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=str) == brute(rows, items, window)


def test_matches_brute_force(spark, frame):
    rng = random.Random(2)
    make = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(i, make(rng.randint(0, 12))) for i in range(25)] + [(99, None), (None, "d d d d a"), (3, "c c c c c c")]
    rows = [(i, make(rng.randint(0, 60))) for i in range(60)] + [(None, make(30)), (1, None), (1, ""), (2, "A, b! C... d")]
    check(spark, frame, rows, items, 5)
    check(spark, frame, rows, items, 3)
    check(spark, frame, rows[:20], items, 5, block_words=40)


def test_empty_tables(spark, frame):
    check(spark, frame, [], [(1, "a b c")], 3)
    check(spark, frame, [(1, "a b c")], [], 3)


def test_long_text_and_span_removal(spark, frame):
    item = "alpha beta gamma delta epsilon"
    text = "word " * 50000 + "Alpha, beta-gamma; DELTA epsilon! tail"
    table = spark.createDataFrame([(7, item)], "item_id long, text string")
    m = decontaminate.matches(frame([(1, text), (2, "clean text"), (3, None)]), table, window=5, longest=4)
    assert {r.doc_id: r.c for r in m.select("doc_id", F.col("match.contaminated").alias("c")).collect()} == {1: True, 2: False, 3: False}
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(m).collect()}
    assert cut == {1: "word " * 50000 + "! tail", 2: "clean text", 3: None}
