import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
from millrace.llm.encoder import Encoder
from millrace.llm.packing import TIERS, pack, pack_items, sequences
from millrace.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def reference(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [[*x.ids, 2] for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def hold(pieces, ids_of, waste):
    """Every id once, no gaps in a sequence, digests of the library's own ids, little padding."""
    seen, places = {}, {}
    for p in pieces:
        ids = ids_of[p.doc_id]
        assert p.doc_tokens == len(ids) and p.length > 0 and p.offset + p.length <= TIERS[0]
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes())
        seen.setdefault(p.doc_id, []).append((p.start, p.length))
        places.setdefault((p.sequence_id, p.tier), []).append((p.offset, p.length))
    assert set(seen) == set(ids_of)
    for doc, parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids_of[doc])
    assert sorted(s for s, _ in places) == list(range(len(places)))
    padded = 0
    for (_, tier), parts in places.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= tier
        padded += 0 if at & (at - 1) == 0 else TIERS[0] - at
    assert padded <= waste


def test_registered_query_is_whole(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = dict(zip(docs, reference(docs.values())))
    hold(entry.queries()["op13_packing"](spark, SF).collect(), ids, TIERS[0])


def test_edges(spark, frame):
    texts = [None, "", " \n", "a", "word " * 9000, "<|endoftext|> x <|STARTOFTEXT|>", "L'ÉTÉ à ß í İ K", *["same copy here"] * 300]
    docs = frame([(i, t) for i, t in enumerate(texts)]).repartition(3)
    pieces = pack(docs, PATH)
    ids = dict(enumerate(reference(texts)))
    hold(pieces.collect(), ids, TIERS[0])
    whole = sequences(pieces).collect()
    assert sum(len(s.ids) // 4 for s in whole) == sum(map(len, ids.values()))
    for s in whole:
        flat = np.frombuffer(s.ids, dtype="<u4").tolist()
        assert flat == [x for p in s.pieces for x in ids[p.doc_id][p.start : p.start + p.length]]
    assert pack(docs.limit(0), PATH).count() == 0


def test_rows_without_or_with_repeated_ids(spark, frame):
    pieces = pack(frame([(None, "one two"), (None, "three"), (7, "x"), (7, "x")]), PATH).collect()
    assert sum(p.length for p in pieces) == sum(map(len, reference(["one two", "three", "x", "x"])))


def test_step_groups_are_even(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = pack(docs, PATH, step_ids=1 << 15, with_ids=False).select("sequence_id", "tier", "step_group").distinct().collect()
    groups = {m.step_group for m in made}
    assert len(groups) > 3
    for tier in TIERS:
        n = [sum(m.tier == tier and m.step_group == g for m in made) for g in groups]
        assert max(n) - min(n) <= 1


@pytest.mark.parametrize("bad", [(4096, 1024), (100, 99)])
def test_tiers_have_to_halve(spark, frame, bad):
    with pytest.raises(ValueError):
        pack(frame([(1, "x")]), PATH, tiers=bad)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 64), st.integers(1, 4096)), max_size=120))
def test_plan_covers_each_item_once_and_leaves_under_the_shortest_tier(sizes):
    item, start, length, tier, seq, offset = pack_items(np.array(sizes, dtype=np.int64))
    filled, covered = {}, {}
    for i, s, n, t, q, o in sorted(zip(item.tolist(), start.tolist(), length.tolist(), tier.tolist(), seq.tolist(), offset.tolist())):
        assert covered.get(i, 0) == s and n > 0
        covered[i] = s + n
        filled.setdefault((t, q), []).append((o, n))
    assert covered == dict(enumerate(sizes))
    for (t, _), parts in filled.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == t if t else at < TIERS[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=list("abZs'TtDd 1\n\t\x0b\x1c\x85\xa0éÉÀàß\xed̀Σσς٣!.,<|>‍漢가İK"), max_size=30), max_size=8))
def test_word_pieces_give_the_librarys_ids(texts):
    ids, counts = Encoder.of(PATH).encode(pa.array(texts, pa.string()))
    want = [x[:-1] for x in reference(texts)]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
