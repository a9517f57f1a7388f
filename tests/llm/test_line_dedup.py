import itertools
import random

import numpy as np
import pytest

from millrace.llm import line_dedup


def slow_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    pairs = [tuple("".join(rng.choice("abcé") for _ in range(rng.randint(0, 20))) for _ in "xy") for _ in range(300)]
    for n in (63, 64, 65, 127, 128, 129, 200, 300):
        for _ in range(6):
            a = [rng.choice("abcdé\u65e5") for _ in range(n)]
            b = list(a)
            for _ in range(rng.randint(0, n // 2)):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "yz"])
            pairs.append(("".join(a), "".join(b)))
    want = [slow_edit(a, b) for a, b in pairs]
    assert [line_dedup.edit_distance(a, b) for a, b in pairs] == want
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert line_dedup.edit_distances(a, b).tolist() == line_dedup.edit_distances(b, a).tolist() == want
    a, b = a + [x * 300 for x in a[:20]], b + [x * 300 for x in a[:20]]  # cells beyond 255
    pairs, want = [*zip(a, b)], want + [0] * 20
    for least in (0.0, 0.5, 0.8, 1.0):
        assert line_dedup.alike(a, b, least).tolist() == [d <= (1 - least) * max(len(x), len(y)) + 1e-9 for x, y, d in zip(a, b, want)]
        assert [bool(line_dedup.alike([x], [y], least)[0]) for x, y in pairs] == line_dedup.alike(a, b, least).tolist()
    assert line_dedup.alike([], [], 0.8).tolist() == []


def test_long_lines_are_compared(monkeypatch):
    monkeypatch.setattr(line_dedup, "_LONG_ROWS", 100)
    a, b = ["x" * 150 + "abc", "y" * 90], ["x" * 150 + "abd", "y" * 80 + "z" * 10]
    assert line_dedup.edit_distances(a, b).tolist() == [1, 10]


def normal_lines(text):
    """Lower-case letters, 0 for digits, words joined by a space; one string a line."""
    out = []
    for line in text.split("\n") if text else []:
        chars = [c.lower() if c.isascii() and c.isalpha() else "0" if c.isascii() and c.isdigit() else " " if c.isascii() else c for c in line]
        out.append(" ".join(x for x in "".join(chars).split(" ") if x))
    return out


def simhash(line):
    """Bit by bit, from 64-bit hashes of the words and of pairs of neighbours, each hashed by itself."""
    words = [line_dedup.rolling(line_dedup._BYTE[np.frombuffer(w.encode(), dtype=np.uint8)], np.array([0]), np.array([len(w.encode())]), "byte")[0] for w in line.split(" ")]
    features = words + [line_dedup.rolling(np.array(p, dtype=np.uint64), np.array([0]), np.array([2]), "word")[0] for p in itertools.pairwise(words)]
    return sum(1 << b for b in range(64) if 2 * sum(int(f) >> b & 1 for f in features) > len(features))


def brute(spark, frame, rows, max_bits=3, similarity=0.8):
    """Groups by all pairs of distinct lines."""
    sims = {}
    for _, t in rows:
        for line in normal_lines(t):
            if line:
                sims[line] = simhash(line)
    parent = {x: x for x in sims}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sims, 2):
        if (sims[a] ^ sims[b]).bit_count() <= max_bits and slow_edit(a, b) <= (1 - similarity) * max(len(a), len(b)) + 1e-9:
            parent[root(a)] = root(b)
    places = []
    for n, (i, t) in enumerate(rows):
        for k, x in enumerate(normal_lines(t)):
            if x:
                places.append(((i is None, i or 0, n, k), root(x)))
    least = {}
    for p, r in places:
        least[r] = min(p, least.get(r, p))
    out = []
    for n, (i, t) in enumerate(rows):
        gone = [p[3] for p, r in places if p[2] == n and least[r] != p]
        out.append((i, len(t.split("\n")) if t else 0, sorted(gone)))
    return sorted(out, key=str)


def check(spark, frame, rows, **options):
    got = line_dedup.dedup_lines(frame(rows), **options).collect()
    assert sorted(((r.doc_id, r.n_lines, r.removed) for r in got), key=str) == brute(spark, frame, rows)
    assert all(r.n_removed == len(r.removed) for r in got)


def rows_of(seed):
    rng = random.Random(seed)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 40))) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            words = rng.choice(base).split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] += rng.choice("xyz")
            lines.append(rng.choice([" ".join(words), " ".join(words).upper() + "!", ""]))
        rows.append((i, "\n".join(lines)))
    return rows


def test_lines_of_a_slice():
    import pyarrow as pa

    texts = ["One, two\n\n  three 42\n", None, "", "!!\n..", "x", "one TWO", "Ä ö\r\nü\n", "\n", "a\tb"]
    own = line_dedup.Lines(pa.chunked_array([texts[:4], texts[4:]]))
    got = [(int(t), int(k), own.distinct[int(c)].as_py()) for t, k, c in zip(own.text, own.number, own.code)]
    assert got == [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate(normal_lines(t)) if x]
    assert own.per_text.tolist() == [len(t.split("\n")) if t else 0 for t in texts]
    assert len(set(own.distinct.to_pylist())) == len(own.distinct) == len(set(own.hashes().tolist()))
    assert own.fingerprints().tolist() == [simhash(x) for x in own.distinct.to_pylist()]
    none = line_dedup.Lines(pa.chunked_array([[None, "", " \n"]], pa.string()))
    assert none.per_text.tolist() == [0, 0, 2] and len(none.code) == len(none.hashes()) == len(none.fingerprints()) == 0


@pytest.mark.parametrize("options", [{}, {"bucket_pairs": 1, "tile": 2}, {"bucket_pairs": 2}])
def test_matches_brute_force(spark, frame, options):
    check(spark, frame, rows_of(4), **options)


def test_finds_near_lines(spark, frame):
    line = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    got = {r.doc_id: r.removed for r in line_dedup.dedup_lines(frame([(1, "first\n" + line), (2, line.replace("wordca", "wordcx")), (3, "other line\nFIRST!")])).collect()}
    assert got == {1: [], 2: [0], 3: [1]}


def test_edges(spark, frame):
    check(spark, frame, [(1, None), (2, ""), (3, "\n\n"), (4, "a b\na b"), (None, "a b"), (5, "!!!\n???"), (6, "only " * 30000), (7, "ÄÖ ü\näö ü")])
    assert line_dedup.dedup_lines(frame([])).collect() == []


def test_repeated_rows(frame):
    got = line_dedup.dedup_lines(frame([(1, "same line"), (1, "same line")])).collect()
    assert sorted(r.n_removed for r in got) == [0, 1]


@pytest.mark.parametrize("bucket_pairs", [1, 32])
def test_lengths_are_counted_in_characters(spark, frame, bucket_pairs):
    line = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(140))
    got = line_dedup.dedup_lines(frame([(1, line), (2, line + " " + "\u65e5" * 200)]), bucket_pairs=bucket_pairs).collect()
    assert {r.doc_id: r.removed for r in got} == {1: [], 2: [0]}


def test_registered_query_finds_lines_with_a_changed_word(spark, frame, tmp_path):
    from millrace.llm.queries import QUERIES

    rng = random.Random(5)
    rows = []
    for i in range(60):
        words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(rng.choice([6, 10, 20, 50]))]
        other = list(words)
        other[rng.randrange(len(words))] += "x"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    frame(rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.removed for r in QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()}
    assert all(got[2 * i] == [] for i in range(60))
    assert sum(got[2 * i + 1] == [0] for i in range(60)) >= 57
    hot = line_dedup.dedup_lines(frame(rows), bands=line_dedup.BANDS, bucket_pairs=1, tile=2).collect()
    assert {r.doc_id: r.removed for r in hot} == got


def candidates(lines):
    """Pairs that share a key of op4, counted from the keys themselves."""
    import pyarrow as pa

    own = line_dedup.Lines(pa.chunked_array([lines]))
    assert own.distinct.to_pylist() == lines
    keys = [line_dedup.block_keys(own.fingerprints(), 5)]
    size = np.array(list(map(len, lines)))
    met, sims = {}, own.fingerprints()
    for tag, gram, which in ((100, 8, np.flatnonzero(size > 47)), (200, 4, np.flatnonzero(size <= 60))):
        bands = line_dedup.band_keys(own.data, own.edges[which], own.edges[which + 1], gram, line_dedup.BANDS)
        for n, row in zip(which.tolist(), bands.tolist()):
            for b, k in enumerate(row):
                met.setdefault((tag + b, k), []).append(n)
    found = {p for group in met.values() for p in itertools.combinations(group, 2)}
    met = {}
    for n, row in enumerate(keys[0].tolist()):
        for k in row:
            met.setdefault(k, []).append(n)
    return found | {(i, j) for group in met.values() for i, j in itertools.combinations(group, 2) if (int(sims[i]) ^ int(sims[j])).bit_count() <= 3}


def alike_pairs(lines, asked, similarity=0.8):
    """Pairs of the asked lines and any others at the similarity or more; pairs whose letters alone differ too much are left out at once."""
    size = np.array(list(map(len, lines)))
    counts = np.zeros((len(lines), 40), dtype=np.int16)
    for i, x in enumerate(lines):
        for c in x:
            counts[i, ord(c) % 40] += 1
    out = set()
    for i in asked:
        most = (1 - similarity) * np.maximum(size, size[i]) + 1e-9
        bound = np.maximum(np.maximum(counts - counts[i], 0).sum(axis=1), np.maximum(counts[i] - counts, 0).sum(axis=1))
        ask = [j for j in np.flatnonzero(bound <= most).tolist() if j != i]
        out |= {(min(i, j), max(i, j)) for j, good in zip(ask, line_dedup.alike([lines[i]] * len(ask), [lines[j] for j in ask], similarity)) if good}
    return out


def test_recall_on_real_lines():
    """Share of the pairs of all-pairs edit similarity that op4 compares, by the shorter line's words."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    lines = list(dict.fromkeys(x for t in texts for x in normal_lines(t) if x))
    pairs, found = alike_pairs(lines, range(0, len(lines), 16)), candidates(lines)
    assert len(pairs) > 20
    recall = len(pairs & found) / len(pairs)
    for low, high in ((0, 5), (6, 10), (11, 20), (21, 50), (51, 10**6)):
        own = [p for p in pairs if low <= min(len(lines[i].split()) for i in p) <= high]
        print(low, high, len(own), sum(p in found for p in own))
    print(len(pairs), recall)
    assert recall >= 0.95


def test_packed_keys_make_the_same_buckets():
    """Keys of two tasks, packed for three parts, against a dictionary of the whole keys; 18 and 14 bytes a key travel."""
    import pyarrow as pa

    rng = random.Random(7)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    lines = list(dict.fromkeys(base + [x + rng.choice("xyz") for x in base] + [x + " more" for x in base]))
    own = line_dedup.Lines.of(pa.array(lines))
    hashes, size = own.hashes(), np.array(list(map(len, lines)))
    want = {}
    for n, row in enumerate(line_dedup.block_keys(own.fingerprints(), 5).tolist()):
        for k in row:
            want.setdefault(k, set()).add(int(hashes[n].view(np.int64)))
    for tag, gram, which in ((100, 8, np.flatnonzero(size > 47)), (200, 4, np.flatnonzero(size <= 60))):
        for n, row in zip(which.tolist(), line_dedup.band_keys(own.data, own.edges[which], own.edges[which + 1], gram, line_dedup.BANDS).tolist()):
            for b, k in enumerate(row):
                want.setdefault((tag + b, k), set()).add(int(hashes[n].view(np.int64)))
    batches, keys = [], 0
    for low, high in ((0, 70), (50, len(lines))):  # lines 50 to 69 are met by both
        part = line_dedup.Lines.of(pa.array(lines[low:high]))
        batches.append(line_dedup.packed_keys(part, hashes[low:high], size[low:high], 3, line_dedup.BANDS, 3))
        keys += sum(10 + 16 * (int(s) > 47) + 16 * (int(s) <= 60) for s in size[low:high])
    table = pa.Table.from_batches(batches)
    assert sum(map(sum, table["counts"].to_pylist())) == keys
    assert sum(len(x) for name in ("blocks", "bands") for x in table[name].to_pylist()) <= 18 * keys
    got = []
    for part in range(3):
        out = line_dedup._buckets(3, 0.8)((pa.scalar(part),), table.filter(pa.compute.equal(table["part"], part))).to_pylist()
        for _, rows in itertools.groupby(out, key=lambda r: r["key"]):
            rows = list(rows)
            assert {r["least"] for r in rows} == {min(r["hash"] for r in rows)} and {r["c"] for r in rows} == {len(rows)}
            got.append(sorted(r["hash"] for r in rows))
    assert sorted(got) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_bounds_of_the_edit_distance():
    rng = random.Random(8)
    for n in (1, 20, 70, 200):
        for _ in range(20):
            a = "".join(rng.choice("abcdefg 日") for _ in range(n))
            b = list(a)
            for _ in range(rng.randint(0, 1 + n // 8)):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randint(0, 3)] = rng.choice(["", "x", "yz"])
            b = "".join(b)
            row = [0] * (len(b) + 1)
            for x in a:
                old, row = row, [0] * (len(b) + 1)
                for j, y in enumerate(b):
                    row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
            assert [line_dedup._in_common(a, b, least) for least in (row[-1], row[-1] + 1)] == [True, False]
            bound = line_dedup._bound(a, b, 0.2 * n)
            assert bound > 0.2 * n or bound >= slow_edit(a, b)
    line = " ".join(f"word{i}" for i in range(60))
    assert line_dedup._bound(line, line.replace("word30 ", "other "), 20) <= 7


def test_ends_bound_the_edit_distance():
    rng = random.Random(9)
    lines, pairs = [], []
    for n in (0, 1, 2, 9, 70, 130, 300):
        for _ in range(12):
            a = [rng.choice("abcdefg 0\0\u65e5") for _ in range(n)]
            b = a if rng.random() < 0.7 else [rng.choice("abcdefg 0\0\u65e5") for _ in range(rng.randint(0, n + n // 5))]
            b = list(b)
            for _ in range(rng.randint(0, 1 + n // 10)):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randint(0, 3)] = rng.choice(["", "x", "yz"])
            pairs.append((len(lines), len(lines) + 1))
            lines += ["".join(a), "".join(b)]
    i, j = np.array(pairs).T
    want = np.array([slow_edit(lines[x], lines[y]) for x, y in pairs])
    for words in (1, 2, 3):
        for x, y in ((i, j), (j, i)):
            assert (line_dedup.end_bounds(lines, x, y, words) <= want).all()


def test_unlike_lines_of_a_hot_bucket_are_told_apart_by_their_ends(monkeypatch):
    """Lines of one language that share a passage: letters and 3-grams alone leave most of their pairs to the exact distance."""
    import pyarrow as pa

    rng = random.Random(10)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    lines = ["the passage that all of them share " + " ".join(rng.choice(words) for _ in range(120)) for _ in range(60)]
    lines += [x[:200] + "another" + x[200:] for x in lines[:5]]
    asked = []
    monkeypatch.setattr(line_dedup, "_in_common", lambda a, b, least, old=line_dedup._in_common: asked.append(1) or old(a, b, least))
    n = len(lines)
    table = pa.table({"hash": list(range(n)), "sim": [0] * n, "root": list(range(n)), "norm": lines, "side": [3] * n})
    found = line_dedup._forest(3, 0.8)((), table).to_pylist()
    assert [(r["u"], r["v"]) for r in found] == [(k, 60 + k) for k in range(5)]
    assert len(asked) <= n
