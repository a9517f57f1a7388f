import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.llm.prefix_trie import rebuilt, trie

SCHEMA = "conv_id long, turn long, role string, text string, c string, k string, pos string, size string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuild(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()[:32]  # noqa: E731  settles ties alone
    for c in own:
        own[c] = [(r, t) for *_, r, t in sorted(own[c], key=lambda x: (x[0], x[1], digest(x[2], x[3])))]
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def brute(convs):
    """Nodes from a dictionary of all prefixes."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: set() for p in nodes}
    for p in nodes:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = sum(saved[x] for x in children[p]) + (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    made = trie(*rebuilt(df, F.crc32(F.col("c").cast("string").cast("binary")) % 6), **options)
    assert tuple(made.columns) == NAMES
    return sorted(map(tuple, made.collect()), key=lambda x: (x[1], x[0]))


def conversations(rng, n, words="ab", longest=9):
    rows = []
    for i in range(n):
        c = rng.choice([i, 100 + i, 1000 + i, -i])
        rows += [(c, t, rng.choice("ua"), rng.choice(words) * rng.randrange(3)) for t in range(rng.randrange(longest))]
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 16), (2, 1), (3, 3), (4, 8)])
def test_brute_force_over_block_sizes(spark, seed, block):
    rows = conversations(random.Random(seed), 90)
    assert run(spark, rows, block=block) == brute(rebuild(rows))


def test_chunks_of_few_turns(spark):
    """Long conversations are sorted and expanded chunk by chunk; most share their first chunks."""
    rng = random.Random(9)
    stem = [rng.choice("xyz") for _ in range(11)]
    rows = []
    for c in range(60):
        text = stem[: rng.randrange(12)] + [rng.choice("xyz") for _ in range(rng.randrange(3))]
        rows += [(c * 7, t, "u", x) for t, x in enumerate(text)]
    rows += [(c, t, "u", x) for c in (901, 903, 905, 907, 909) for t, x in enumerate(stem)]
    assert run(spark, rows, block=5, chunk=2, members=3) == brute(rebuild(rows))


def test_edges(spark):
    rows = [(1, 0, None, "a"), (1, None, "u", None), (1, 0, "", "b"), (1, 0, "", "b"), (None, 0, "u", "x"), (2, 0, "u", "é" * 3), (150, 0, "u", "y"), (3, 5, "u", "z" * 100_000), (4, 5, "u", "z" * 100_000)]
    assert run(spark, rows) == brute(rebuild(rows))
    assert run(spark, []) == []
    assert run(spark, [(None, 0, "u", "x")]) == []


def test_only_turnless_conversations(spark):
    rows = [(c, 0, "u", "y") for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 > 0]
    assert run(spark, rows) == brute(rebuild(rows)) and len(run(spark, rows)) == 1


def test_one_conversation_and_copies(spark):
    rows = [(c, t, "u", str(t)) for c in range(300, 340) for t in range(4)]
    assert run(spark, rows, block=2) == brute(rebuild(rows))


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, entry.queries()["op11_prefix_trie"](spark, sf).collect()), key=lambda x: (x[1], x[0]))
    assert got == brute(rebuild(rows))
