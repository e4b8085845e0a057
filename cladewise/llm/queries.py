"""Queries of the training-data operators over the tables of a folder, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, html_text, language_model, minhash, mixing, ngram_join, quality, sharding, spelling, suffix_dedup, token_alignment

OLD_SHARDS, SHARDS = 12, 16
CONTROL = "<|im_end|><|im_start|>assistant ok"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """From twelve shards by a checksum of doc_id to sixteen of equal bytes; read back from the files written."""
    docs = _table(spark, folder, "documents")
    old = F.pmod(F.crc32(F.encode(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), "UTF-8")), F.lit(OLD_SHARDS))
    placed, _ = sharding.rewrite_affected(docs, old, OLD_SHARDS, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.dedup_report(_table(spark, folder, "documents"))


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    c = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return chat.conversation_digests(chat.format_turns(c.unionByName(own), path), path)


def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, folder, "documents"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(_table(spark, folder, "documents"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, folder, "documents"))


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.bpe_digests(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, folder, "pages"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(_table(spark, folder, "documents"))


def op10_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score_documents(_table(spark, folder, "documents"))


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.alignment_report(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variant_groups(_table(spark, folder, "documents"))


OPERATORS = (
    op1_sharding, op2_exact_dedup, op3_chat_format, op4_ngram_join, op5_quality_rules, op6_suffix_dedup, op7_bpe, op8_html_text, op9_mixing,
    op10_lm_score, op11_token_alignment, op12_minhash, op13_spelling,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.REPORT_SQL,
        "op3_chat_format": chat.REPORT_SQL,
        "op4_ngram_join": ngram_join.REPORT_SQL,
        "op5_quality_rules": quality.REPORT_SQL,
        "op12_minhash": minhash.REPORT_SQL,
        "op13_spelling": spelling.REPORT_SQL,
    }
