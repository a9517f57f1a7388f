import zlib

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import token_store
from millrace.llm.queries import op1_language_id, tokenizer_path
from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_simhash_similar import brute as brute_copies

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_run_equals_the_stages_by_brute_force(spark, docs):
    pytest.importorskip("public_tokenizers")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in op1_language_id(spark, SF).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.MIN_SCORE}

    kept = {i for i, least in brute_copies([(i, rows[i].text) for i in sorted(kept)]) if i == least}

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in brute_contamination([(i, rows[i].text) for i in kept], items, 13) if r[4]}
    assert bad
    kept -= bad

    quality = {r.doc_id: 2.0 if r.quality else 0.5 for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    mix = [(i, taken // n) for i, _, n, taken in brute_mix([(i, rows[i].source, rows[i].text) for i in kept], quality)[0] if n and taken]

    encoder, want, start = token_store.Encoder.of(tokenizer_path()), [], 0
    for i, copies in sorted(mix):
        ids = np.array([*encoder.tokenizer.encode(rows[i].text, add_special_tokens=False).ids, 2], dtype="<u4")
        for _ in range(copies):
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_stages_keep_the_columns(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_bear_empty_tables_and_nulls(spark, docs):
    for made in (docs.where("false"), spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], docs.schema)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, made, SF).collect()
