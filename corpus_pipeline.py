"""Corpus pipeline: language ID, near-dedup, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared
folder and gives what it reads back to the next. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language_id, mixing, simhash_similar, token_store
from millrace.llm._common import forget, workspace
from millrace.llm.queries import language_model, quality_weights, table, tokenizer_path

#: A document is rejected if no language has this mean posterior.
MIN_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those labelled `und` or below MIN_SCORE go."""
    found = language_id.identify(docs, language_model(docs), as_col="__language", with_runs=False)
    kept = found.where((F.col("__language.lang") != language_id.NONE) & (F.col("__language.score") >= MIN_SCORE))
    return kept.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: 5-word shingles alike to 0.8 or more."""
    return simhash_similar.keep_one_similar(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which passages of the benchmark make up less than a twentieth; others go whole."""
    matched = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"), as_col="__match")
    return matched.where(~F.col("__match.contaminated")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.draw(docs, quality_weights(spark, sf_dir))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; per row of it doc_id, start, n_tokens, ids_crc32 as read back."""
    return token_store.read_index(*token_store.write_tokens(docs, tokenizer_path()))


STAGES = [
    ("language_id", language_stage),
    ("simhash_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
    ("token_store", token_stage),
]

#: Language labels, XXH64 with a seed and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = workspace(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            forget(spark, before)
        before = path
    return docs
