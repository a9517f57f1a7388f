import itertools
import random

import numpy as np
import pytest

from millrace.llm import simhash_similar
from millrace.llm.simhash_similar import MAX_BITS, SEGMENTS, BITS


def words_of(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def shingles(text, width=5):
    words = words_of(text)
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def is_candidate(a, b):
    lanes = [simhash_similar.signatures([b" ".join(words_of(t))]) for t in (a, b)]
    diff = sum(int(x[0] ^ y[0]) << (2 * BITS * k) for k, (x, y) in enumerate(zip(*lanes))) & ((1 << SEGMENTS * BITS) - 1)
    rest = [int(x[0] ^ y[0]).bit_count() for x, y in zip(*lanes)]
    near = [(diff >> (BITS * s) & ((1 << BITS) - 1)).bit_count() <= 1 for s in range(SEGMENTS)]
    return any(near) and sum(rest) <= MAX_BITS


def brute(rows, candidates=True):
    """component_id by id: links of all pairs, or of those that share a variant."""
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if words_of(rows[i][1]) == words_of(rows[j][1]) or (jaccard(sets[i], sets[j]) >= 0.8 and (not candidates or is_candidate(rows[i][1], rows[j][1]))):
            parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, least.get(root(k))) for k, (i, _) in enumerate(rows)), key=str)


def planted(groups, copies, share, seed, length=(60, 400)):
    """Texts and copies of them with a share of the words replaced, each from the text itself."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = []
    for _ in range(groups):
        base = [vocabulary[min(int(rng.expovariate(1 / 300)), 2999)] for _ in range(rng.randint(*length))]
        texts.append(" ".join(base))
        for _ in range(copies):
            texts.append(" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base))
    rng.shuffle(texts)
    return list(enumerate(texts))


def check(spark, frame, rows, **options):
    got = simhash_similar.similar_documents(frame(rows), **options).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("options", [{}, {"bucket_pairs": 1, "tile_bytes": 5000}])
def test_matches_brute_force(spark, frame, options):
    check(spark, frame, planted(12, 9, 0.02, 3) + [(900, None), (901, ""), (902, "few words"), (903, "Few  WORDS")], **options)


def test_edges(spark, frame):
    long = "x y z " * 60000
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c"), (4, "A B C"), (4, "a b c"), (5, "Ünï cödé wörds ünd mehr"), (None, "alone in null"), (6, long), (7, long + "end")]
    check(spark, frame, rows)
    assert simhash_similar.similar_documents(frame([])).collect() == []


def test_keep_one_similar(spark, frame):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(3, text), (1, text + " more"), (2, "else entirely different words here"), (None, text)]
    kept = simhash_similar.keep_one_similar(frame(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert "chunk" in kept.columns


def test_recall_by_likeness():
    """Of planted pairs at 0.8 or more, nine in ten are candidates, and most of those just above 0.8."""
    found = {low: [0, 0] for low in (0.8, 0.85, 0.9)}
    for seed, share in enumerate((0.004, 0.01, 0.015, 0.02)):
        rows = dict(planted(1, 150, share, seed, (200, 600)))
        base = min(rows, key=lambda i: -sum(jaccard(shingles(rows[i]), shingles(t)) for t in list(rows.values())[:20]))
        for i, t in rows.items():
            x = jaccard(shingles(t), shingles(rows[base]))
            if i != base and x >= 0.8:
                at = max(low for low in found if low <= x)
                found[at][0] += is_candidate(t, rows[base])
                found[at][1] += 1
    hits, all_ = map(sum, zip(*found.values()))
    assert all_ > 150 and hits >= 0.9 * all_
    assert all(h >= 0.8 * n for h, n in found.values() if n > 20), found


def test_signature_is_of_distinct_words():
    a, b = simhash_similar.signatures([b"a b c", b"c b a b a"]), simhash_similar.signatures([b""])
    assert all(x[0] == x[1] for x in a) and all(x[0] == 0 for x in b)
    assert [len(s) for s in simhash_similar.shingle_sets([b"a b", b"", b"a b c d e f"], 5)] == [1, 1, 2]
    assert np.array_equal(*simhash_similar.shingle_sets([b"a b c d e a b c d e", b"a b c d e a b c d e a b c d e"], 5))
