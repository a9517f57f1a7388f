import random

import numpy as np

from millrace.llm import substring_dedup


def brute(rows, width):
    seen = {}
    split = [((t or "").encode().split(), i) for i, t in rows]
    big = 10**30
    for words, i in split:
        for k in range(len(words) - width + 1):
            w = tuple(words[k : k + width])
            seen[w] = min(seen.get(w, big), big - 1 if i is None else i)
    out = []
    for words, i in split:
        gone = set()
        for k in range(len(words) - width + 1):
            if seen[tuple(words[k : k + width])] < (big - 1 if i is None else i):
                gone.update(range(k, k + width))
        out.append((i, len(words), len(gone), " ".join(w.decode() for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def check(frame, rows, width, **options):
    got = substring_dedup.remove_repeats(frame(rows), width=width, **options).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows, width)
    for r in got:
        assert sum(x.end - x.start for x in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))


def test_matches_brute_force(frame):
    rng = random.Random(3)
    shared = [" ".join(rng.choice("abcdefg") for _ in range(20)) for _ in range(5)]
    rows = []
    for i in range(80):
        parts = [" ".join(rng.choice("hijklmnop") for _ in range(rng.randint(0, 30))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(shared))
        rows.append((rng.randint(0, 60), "\n".join(parts)))
    for chunk_bytes in (300, 10**7):
        check(frame, rows, 6, chunk_bytes=chunk_bytes)


def test_edges(frame):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t "), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, long), (10, "pre " + long), (11, "ä ö ü ß é è ñ ñ")]
    check(frame, rows, 5, chunk_bytes=100)
    check(frame, rows, 50)
    assert substring_dedup.remove_repeats(frame([])).collect() == []


def test_all_ids_null(frame):
    check(frame, [(None, "a b c d e f"), (None, "a b c d e f")], 3)


def test_pack_round_trip():
    h = np.unique(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (substring_dedup.unpack(substring_dedup.pack(h)) == h).all()
    assert len(substring_dedup.unpack(substring_dedup.pack(h[:0]))) == 0
