import zlib

import numpy as np

from millrace.llm import language_id
from millrace.llm.queries import op1_language_id

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    import itertools

    model = language_id.Model(["a", "b", "c"], language_id.Features({}))
    rng = np.random.default_rng(0)
    model.moves = rng.normal(size=(3, 3))
    counts = np.array([4, 1, 3])
    emitted = rng.random((8, 3)) + 0.05
    moved = np.zeros((3, 3))
    got = model.posteriors(emitted, counts, moved)
    at, want, joint = 0, [], np.zeros((3, 3))
    for n in counts:
        e, total, p = emitted[at : at + n], 0.0, np.zeros((n, 3))
        pairs = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.prod([e[i, y] for i, y in enumerate(path)]) * np.exp(sum(model.moves[a, b] for a, b in itertools.pairwise(path)))
            total += w
            for i, y in enumerate(path):
                p[i, y] += w
            for a, b in itertools.pairwise(path):
                pairs[a, b] += w
        want.append(p / total)
        joint += pairs / total
        at += n
    assert np.allclose(got, np.concatenate(want))
    assert np.allclose(moved, joint)


def test_segments_give_what_one_segment_gives(monkeypatch):
    rng = np.random.default_rng(1)
    model = language_id.Model(["a", "b", "c", "d"], language_id.Features({}))
    model.moves = rng.normal(size=(4, 4)) * 3
    counts = np.array([1, 700, 3, 50, 10, 2, 333, 5, 64])
    emitted = np.exp(-30 * rng.random((counts.sum(), 4)))
    monkeypatch.setattr(language_id, "SEGMENT", 1000)
    want = model.posteriors(emitted, counts)
    for span in (1, 2, 5, 50, 64):
        monkeypatch.setattr(language_id, "SEGMENT", span)
        assert np.allclose(model.posteriors(emitted, counts), want)
    monkeypatch.setattr(language_id, "SCAN_LABELS", 3)
    assert np.allclose(model.posteriors(emitted, counts), want)


def test_words_are_those_of_split():
    texts = ["", " a  b\n", "x", "\t", "c\u2003d\x1ce\x85f\xa0g", "  ", "a b a\u3000", "é\n\nü"]
    words, codes, sizes = language_id.split_words(texts)
    assert [words[c] for c in codes] == [w for t in texts for w in t.split()] and len(set(words)) == len(words)
    assert sizes.tolist() == [len(t.split()) for t in texts]


def test_word_memory_is_bounded(monkeypatch):
    known = model()
    texts = ["the cat and the dog " + " ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    want = known.predict(texts)[1]
    monkeypatch.setattr(language_id, "MEMORY", 100)
    known._clear()
    for at in range(0, 30, 2):
        assert np.allclose(known.predict(texts[at : at + 2])[1], want[at : at + 2])
        assert len(known.place) == len(known.rows) == len(known.hits) <= 100


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = op1_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) / len(held) >= 0.97


def model():
    en, es = "the cat and the dog were in the house with other things", "el gato y el perro estaban en la casa con otras cosas"
    return language_id.train([(en, "en"), (es, "es")] * 20)


def test_code_switching_runs():
    label, score, runs = model().predict(["the dog and the cat were with things el perro y la casa con otras cosas 12"])
    assert runs[0] == [(0, 8, "en"), (8, 16, "es")]
    assert 0 < score[0] < 1


def test_edges(spark, frame):
    rows = [(1, None), (2, ""), (3, "123 !!"), (None, "the house"), (4, "la casa " * 40000), (4, "la casa"), (5, "x" * 100000)]
    got = {(r.doc_id, r.text and r.text[:8]): r.language for r in language_id.identify(frame(rows), model()).collect()}
    assert all(got[k].lang == "und" and got[k].score == 0 and got[k].runs == [] for k in ((1, None), (2, ""), (3, "123 !!")))
    assert got[(4, "la casa ")].lang == "es" and got[(None, "the hous")].lang == "en"
    assert language_id.identify(frame([]), model()).collect() == []
    empty = language_id.train([])
    assert {r.language.lang for r in language_id.identify(frame(rows), empty).collect()} == {"und"}


def test_sample_is_bounded_and_leaves_held_out_rows_alone(spark, frame):
    from pyspark.sql import functions as F

    rows = [(i, f"text {i} " * 500) for i in range(50)] + [(None, "no id"), (100, None)]
    got = language_id.sample(frame(rows), F.col("doc_id") % 2 == 0, per_label=10, chars=40)
    assert len(got) == 10 and all(len(t) <= 40 and lang == "en" for t, lang in got)
    assert language_id.sample(frame([]), F.lit(True)) == []


def test_sample_bounds_hold_for_repeated_ids_and_many_labels(spark):
    rows = [(7, f"hot {i}", "hot") for i in range(500)] + [(i, f"text {i}", f"l{i % 9}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    got = language_id.sample(docs, F.lit(True), per_label=5, labels=4)
    assert sorted({lang for _, lang in got}) == ["hot", "l0", "l1", "l2"] and len(got) == 20
    assert got == language_id.sample(docs.repartition(7), F.lit(True), per_label=5, labels=4)
