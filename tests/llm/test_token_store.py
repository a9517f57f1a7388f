import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import encoder as pieces
from millrace.llm import token_store
from millrace.llm.queries import tokenizer_path

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return token_store.Encoder.of(tokenizer_path())


@pytest.fixture(scope="module")
def fresh():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def library(fresh, texts):
    return [x.ids for x in fresh.encode_batch(texts, add_special_tokens=False)]


def mine(encoder, texts):
    flat, counts = encoder.encode(texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


TRICKY = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\tb", "x y z", "don't 'tis we'll", "foo, bar.baz!! 12 3.5", "<|endoftext|> hi <|endoftext|>", "Äpfel über　日本 語", "a  b", "￾ mark", "é́ combining", "1 2 3", "word... word", "²³ x² y", "a .b", "\r\n x", "a.\nB c", "\na", "a\n", "\n", "a\n\nb", "a \nb", "a\n b", "a\r\nb", "x\ny\nz w", "foo$$$ bar'' it's' a's. ''s &x& don't'", "end's"]


def test_encoder_equals_the_library(encoder, fresh):
    assert mine(encoder, TRICKY) == library(fresh, TRICKY)


PARTS = [*"ab Z'sé.,!1 \n\t日²×÷ßÿ\xa0\u2003\u3000\x85\x1c—¿", "'t", "'ll", "<|endoftext|>", "<|", "|>", "e\u0301", "ñ", "😀", "  ", " x"]


@settings(max_examples=600, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=1, max_size=5))
def test_encoder_equals_the_library_on_any_text(fresh, texts):
    encoder = token_store.Encoder.of(tokenizer_path())
    assert mine(encoder, texts) == library(fresh, texts)


def test_every_character_beside_spaces_and_marks(encoder, fresh):
    """Every code point up to 0x3400 in the places where texts are cut."""
    texts = [f"a{c}b {c} .{c}, x{c}, {c}y\n{c}\n{c}'s z{c} " for c in map(chr, range(1, 0x3400))]
    flat, counts = encoder.encode(texts)
    want = library(fresh, texts)
    assert counts.tolist() == [len(x) for x in want] and flat.tolist() == [y for x in want for y in x]


def test_slices_and_nulls_of_an_array(encoder, fresh):
    import pyarrow as pa

    texts = ["no", None, "", "Ein Text, è vero.", "<|endoftext|> x", None, "last"]
    for a, b in ((0, 7), (1, 3), (2, 6), (3, 3), (1, 2)):
        for own in (pa.array(texts, pa.string()).slice(a, b - a), pa.array(texts, pa.large_string()).slice(a, b - a)):
            flat, counts = encoder.encode(own)
            want = library(fresh, [x or "" for x in texts[a:b]])
            assert counts.tolist() == [len(x) for x in want] and flat.tolist() == [y for x in want for y in x]


def test_memory_limit(encoder, fresh, monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY_BYTES", 60)
    monkeypatch.setattr(pieces, "LONGEST", 8)
    encoder._clear()
    for seed in range(4):
        rng = random.Random(seed)
        texts = [" ".join(rng.choice(["the", "of", "xq"]) + rng.choice("abcdefghijk,.") for _ in range(30)) for _ in range(5)]
        assert mine(encoder, texts) == library(fresh, texts)
        assert encoder.chars <= 60 and encoder.chars == sum(map(len, encoder.place))


def test_remembered_pieces_are_no_python_objects():
    import tracemalloc

    encoder, text = token_store.Encoder(tokenizer_path()), " ".join(f"w{i:06d}" for i in range(100_000))
    tracemalloc.start()
    encoder.encode([text])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(encoder.first) == 100_000 and held < 60 * 100_000


def test_without_room_for_all_the_pieces_met_again_are_remembered(fresh, monkeypatch):
    encoder = token_store.Encoder(tokenizer_path())
    monkeypatch.setattr(pieces, "MEMORY_BYTES", 60)
    texts = [" ".join(f"q{i}x the" for i in range(100))]
    assert mine(encoder, texts) == library(fresh, texts)
    assert encoder.place == [" the"]
    assert mine(encoder, texts) == library(fresh, texts)


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_get_texts_whole(name):
    from tokenizers import Tokenizer

    encoder, fresh = token_store.Encoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    assert mine(encoder, TRICKY) == library(fresh, TRICKY)


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 2048, 2049, 5000, 2048 * 128 + 1, token_store.BLOCK + 777])
def test_coder_round_trip(tmp_path, n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.001, n), 49999).astype(np.uint32)
    table = token_store.Table.counted(np.bincount(ids, minlength=50257))
    assert table.freq.sum() == 1 << token_store.SCALE_BITS
    path = str(tmp_path / "x")
    token_store.write_file(path, token_store.shard_bytes(ids, [1], np.array([n]), 0, table))
    shard = token_store.Shard(path, table)
    assert np.array_equal(shard.ids(), ids)
    for _ in range(10):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert np.array_equal(shard.ids(a, b), ids[a:b])


def test_ids_are_packed_in_two_or_four_bytes():
    for ids in ([], [0], [65535, 3], [65536, 1], [2**32 - 1, 7, 0]):
        ids = np.array(ids, dtype=np.uint32)
        blob = token_store._pack(ids)
        back = token_store._unpack(blob)
        assert back.dtype == np.uint32 and back.tolist() == ids.tolist() and blob[0] == (2 if ids.max(initial=0) < 65536 else 4)


def test_damage_is_seen(tmp_path):
    ids = np.arange(3000, dtype=np.uint32)
    table = token_store.Table.counted(np.bincount(ids))
    raw = bytearray(b"".join(token_store.shard_bytes(ids, [1], np.array([3000]), 0, table)))
    raw[-5] ^= 1
    (tmp_path / "x").write_bytes(raw)
    with pytest.raises(ValueError):
        token_store.Shard(str(tmp_path / "x"), table).ids()
    with pytest.raises(ValueError):
        token_store.Shard(str(tmp_path / "x"), token_store.Table.counted(np.array([1, 1])))


def check(fresh, frame, rows, **options):
    got = token_store.read_index(*token_store.write_tokens(frame(rows), tokenizer_path(), **options)).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault((i is None, i or 0), []).append([*library(fresh, [t or ""])[0], 2])
    want, start = [], 0
    for key in sorted(ids):
        for own in sorted(ids[key], key=lambda x: np.array(x, dtype="<u4").tobytes()):
            want.append((None if key[0] else key[1], start, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
            start += len(own)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda x: x[1]) == want


def test_batches_of_the_store_are_small(spark, frame):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(16 << 20))
    token_store.write_tokens(frame([(1, "a")]), tokenizer_path())
    now = int(spark.conf.get(name))
    spark.conf.set(name, before)
    assert now == 4 << 20


def test_store(fresh, frame):
    rng = random.Random(1)
    rows = [(rng.randint(-50, 50), " ".join(rng.choice(TRICKY) for _ in range(rng.randint(0, 9)))) for _ in range(70)]
    rows += [(None, "null id"), (None, None), (3, None), (4, ""), (5, "very long " * 40000)]
    check(fresh, frame, rows, chunk_bytes=500)
    check(fresh, frame, rows[:5])
    check(fresh, frame, [])


def test_added_tokens_are_found_as_the_file_says(encoder, fresh, frame):
    texts = ["hi <|endoftext|> there", "plain text", "", "<|endoftext|>", "a<|endoftext|><|endoftext|> b\n", "<|endoftext", "x y <|endoftext|>"]
    want = [x.ids for x in fresh.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [5303, 220, 50256, 612]
    assert mine(encoder, texts) == want and mine(encoder, texts[:1]) == want[:1]
    got = token_store.read_index(*token_store.write_tokens(frame(list(enumerate(texts))), tokenizer_path())).collect()
    ends = [[*x, 2] for x in want]
    assert [(r.n_tokens, r.ids_crc32) for r in sorted(got, key=lambda r: r.doc_id)] == [(len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for x in ends]
