"""A corpus pipeline of five stages over ``documents``: rules, copies, near copies, mixture, tokens.

Every stage takes what its predecessor kept and returns documents with their columns; the last one
returns the tokens' digests of each document. Nulls, empty texts, repeated rows and empty tables are those of
the operators' docstrings: a null text has no words and is rejected by the first stage, a null doc_id is kept
and comes last where ids decide, of rows that repeat one stays, and an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cladewise.llm import bpe, exact_dedup, mixing, ngram_join, quality
from cladewise.llm.common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.quality_filter(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts one document stays."""
    return ngram_join.keep_one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by calibrated probabilities."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens as digests, and those of the decoded text."""
    return bpe.bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing", mixture), ("BPE", tokens)]

#: Raking and BPE are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        if k:  # no later stage reads the table before
            scratch.drop(before)
    return docs
