import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm.hard_negatives import mine

SCHEMA = "vec_id long, embedding array<float>, label int, h string, cell string, v string"


def brute(rows, positives=5, negatives=10, anchor=lambda i: i % 3 == 0):
    """Straight from the definition: every anchor against every row."""
    kept, seen = [], set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (i, tuple(v), label) in seen:
            continue
        seen.add((i, tuple(v), label))
        kept.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for a in kept:
        if not anchor(a[0]):
            continue
        score = [(sum(x * y for x, y in zip(a[1], b[1])), b) for b in kept if b is not a]
        near = sorted((x for x in score if x[1][2] == a[2]), key=lambda x: (-x[0], x[1][0]))[:positives]
        for p, b in near:
            fit = sorted((-s, n[0]) for s, n in score if n[2] != a[2] and 30 * p <= 100 * s <= 90 * p)
            out += [(a[0], b[0], k + 1, n, p, -s) for k, (s, n) in enumerate(fit[:negatives])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)
    return sorted(map(tuple, mine(df, F.col("vec_id") % 3 == 0, **options).collect()))


def vectors(rng, n, dim=6, labels=3):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    f = lambda x: float(__import__("numpy").float32(x))
    out = []
    for i in range(n):
        c = rng.randrange(labels)
        out.append((i, [f(x + rng.gauss(0, 0.6)) for x in centres[c]], c if rng.random() < 0.8 else rng.randrange(labels)))
    return out


@pytest.mark.parametrize("options", [{}, {"group": 5, "slab": 11, "most_pivots": 9}])
def test_brute_force(spark, monkeypatch, options):
    monkeypatch.setattr("millrace.llm.hard_negatives.PER_PIVOT", 4)
    rows = vectors(random.Random(3), 150)
    got = run(spark, rows, **options)
    assert got == brute(rows) and len(got) > 500


def test_far_cells_are_not_sent_to(spark, monkeypatch):
    """Two far clusters: rows of one don't reach the anchors of the other, results stay whole."""
    from millrace.llm import hard_negatives

    monkeypatch.setattr(hard_negatives, "PER_PIVOT", 4)
    rng = random.Random(5)
    rows = [(i, [float(x) for x in ((40, 0) if i % 2 else (0, 40))], i % 5 % 2) for i in range(80)]
    rows = [(i, [v[0] + rng.randrange(8) / 8, v[1] + rng.randrange(8) / 8], label) for i, v, label in rows]
    assert run(spark, rows, most_pivots=6) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 2), (6, [None, 1.0], 2), (7, [0.5, 0.5], None), (None, [1.0, 1.0], 1),
            (8, [0.5, 0.5], 2), (9, [], 2), (12, [0.5], 1), (2, [0.5, 0.5], 2), (15, [0.0, 0.0], 2), (16, [-1.0, -1.0], 2)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, [1.0], 1)]) == [] and run(spark, [(0, [1.0], 1)]) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**40, 3.0], 1), (1, [2.0**15, 1.0], 1), (2, [2.0**14, 5.0], 2), (3, [2.0**14, 4.0], 2), (4, [2.0**13, 7.0], 3)]
    want = [x for x in brute(rows) if abs(x[4]) < 2**63]
    assert [x for x in run(spark, rows) if abs(x[4]) < 2**63 - 1] == want and want


def test_copies_and_ties_go_by_id(spark):
    rows = [(i, [1.0, 0.25], i % 2) for i in range(40)] + [(100 + i, [0.5, 0.25], i % 2) for i in range(60)]
    assert run(spark, rows, group=3, slab=7) == brute(rows)
