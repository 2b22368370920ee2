"""From raw documents to packed training sequences: language, near copies, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkbars.llm import language, neardup, packing, substrings
from sparkbars.llm.common import stage

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text fits one of the languages that the labelled rows of ``docs`` teach; others, null texts and
    those without a letter, go. Repeated rows are judged alike; an empty table stays empty; columns stay as they are."""
    return language.accepted(docs, language.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 of five-word shingles, the one of smallest id. Null
    and empty texts and null ids are linked with nothing and stay; columns stay as they are."""
    return neardup.drop_near_duplicates(docs, neardup.Plan(words=5, percent=80))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that a document of smaller id has. Null and short texts, and rows
    with a null id, stay; n_chars is counted anew; other columns stay as they are."""
    return substrings.remove_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens along the content curve; a null text counts as empty and has its closing id only."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: Language models, signatures and tokenizers are not SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
