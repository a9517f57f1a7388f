import itertools
import random

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash_dedup
from millrace.llm._graph import connected_components


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(set(fps)), 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    return {f: root(f) for f in fps}


def check(spark, frame, rows, **options):
    got = simhash_dedup.near_duplicates(frame(rows), **options).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    want = sorted(((i, f, least.get(roots[f])) for (i, _), f in zip(rows, fps)), key=str)
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=str) == want


def texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(1, 200))) for _ in range(30)]
    rows = []
    for i in range(120):
        words = rng.choice(base).split()
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    return rows


def test_matches_brute_force(spark, frame):
    check(spark, frame, texts())


def test_hot_buckets_take_the_exact_way(spark, frame):
    check(spark, frame, texts(), bucket_pairs=1)


def test_hot_buckets_lose_no_link(spark):
    rng = random.Random(1)
    center = rng.getrandbits(64)
    fps = {center}
    while len(fps) < 300:
        f = center
        for _ in range(rng.randint(1, 4)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    for cap in (4, 1000):
        edges = simhash_dedup.links(spark.createDataFrame(signed, "fp long"), cap)
        got = {r.node & (2**64 - 1): r.root for r in connected_components(edges).collect()}
        roots = brute_components(list(fps))
        groups = lambda d: sorted(sorted(k for k in d if d[k] == r) for r in set(d.values()))
        alone = [g for g in groups(roots) if len(g) > 1]
        assert groups(got) == alone


def test_edges(spark, frame):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c"), (4, "A B C"), (4, "a b c"), (5, "Ünï cödé wörds ünd mehr"), (None, "alone in null"), (6, "x " * 70000)]
    check(spark, frame, rows)
    assert simhash_dedup.near_duplicates(frame([])).collect() == []


def test_keep_one(spark, frame):
    rows = [(3, "one two three four"), (1, "one two three four"), (2, "else entirely different words here"), (None, "one two three four")]
    kept = simhash_dedup.keep_one(frame(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert "chunk" in kept.columns


@pytest.mark.parametrize("n", [0, 1, 255, 256, 1000])
def test_majority_bits(n):
    rng = np.random.default_rng(n)
    h = rng.integers(0, 2**64, n, dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > n)
    assert int(simhash_dedup.majority_bits(h, np.array([n]))[0]) == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}
