import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import _common


@pytest.mark.parametrize("quantiles", [4096, 5])
def test_chunks_are_even_in_bytes(spark, monkeypatch, quantiles):
    """Clustered ids, and long texts at one end: no chunk gets over twice its size, but for single rows."""
    monkeypatch.setattr(_common, "MAX_QUANTILES", quantiles)
    rng = random.Random(2)
    sizes = {**{i: 20 for i in range(3000)}, **{10**12 + i: rng.randint(0, 3000) for i in range(200)}, **{-7 - i: 5 for i in range(100)}}
    rows = [(i, "x" * n) for i, n in sizes.items()] + [(None, "no id"), (5_000_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bounds = _common.id_chunks(docs, "doc_id", "text", 10_000)
    assert bounds[0] == min(sizes) and (np.diff(bounds) > 0).all() and len(bounds) >= 20
    held = np.zeros(len(bounds))
    np.add.at(held, _common.chunks_of(pa.array(list(sizes)), bounds), list(sizes.values()))
    assert held.max() <= 2.3 * 10_000 + 3000


def test_chunks_of_few_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert len(_common.id_chunks(empty, "doc_id", "text")) == 0
    nulls = spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")
    assert len(_common.id_chunks(nulls, "doc_id", "text", 1)) == 0
    one = spark.createDataFrame([(4, "a" * 100)] * 50, "doc_id long, text string")
    assert _common.id_chunks(one, "doc_id", "text", 10).tolist() == [4]
    assert _common.chunks_of(pa.array([3, 4, 5, None]), np.array([4])).tolist() == [0, 0, 0, 0]


def test_slices():
    table = pa.table({"text": ["aa", None, "bbbbbbb", "", "c", "dd", "é"]})
    assert [s["text"].to_pylist() for s in _common.slices(table, "text", 4)] == [["aa", None], ["bbbbbbb"], ["", "c", "dd"], ["é"]]


def test_batches_are_bounded(spark):
    before = spark.conf.get(_common._BATCH)
    for given, want in (("64m", 16 << 20), ("1m", 1 << 20)):
        spark.conf.set(_common._BATCH, given)
        _common.bounded(spark.range(1))
        assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_common._BATCH)) == want
    spark.conf.set(_common._BATCH, before)
