"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, substring dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return
the columns of ``documents``. Documents without text or letters, and longer ones that fit no learned language,
go in the first stage (without any labelled language, only the former); the second keeps the largest id of equal texts, the third the least id of each group of near copies; the fourth takes
repeated passages out of the texts (a text may become empty, its row stays); the fifth packs what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import exact_dedup, jaccard, language, packing, substring_dedup
from palimpsest.llm._store import documents, materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_copies(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("best_fit_packing", pack),
]

#: No SQL expresses the stages; tests/llm/test_pipeline.py holds each stage and the whole against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
