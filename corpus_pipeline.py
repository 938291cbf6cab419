"""From raw documents to token ids of a training mix.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; run() writes what a stage returns
as Parquet to the shared folder and reads it back as the next stage's docs, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabwright.llm import bpe, exact_dedup, language_id, mixing, ngram_join
from tabwright.llm.common import store, table

#: Near duplicates: five words, a similarity of 0.8.
WORDS, PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the labelled ones; text without letters, or of no main language, goes."""
    return language_id.keep_known(docs, language_id.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id."""
    return ngram_join.one_of_each_group(docs, WORDS, PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids, and whether decoding gave the text back."""
    return bpe.encode_decode(docs, outputs="ids").select("doc_id", "lang", "source", "n_tokens", "token_ids", "decoded_equal")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("weighted_mix", mix_sources),
    ("bpe", encode),
]

#: Language identification and BPE have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
