"""The corpus operators as queries over the supplied tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_records, chat, decontaminate, lm_scoring, minhash, packing, quality, sharding, substring_dedup, suffix_dedup
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op4_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_records.tokenised(table(spark, sf_dir, "documents"))


def op5_shard_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"))


def op8_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op10_chat_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.examples(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op9_lm_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_suffix_array_dedup,
        op3_substring_dedup,
        op4_binary_records,
        op5_shard_interleave,
        op6_best_fit_packing,
        op7_superminhash,
        op8_quality_lines,
        op9_lm_cross_entropy,
        op10_chat_prefix_target,
    )
}
ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_suffix_array_dedup": suffix_dedup.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op5_shard_interleave": sharding.ORACLE,
    "op7_superminhash": minhash.ORACLE,
    "op8_quality_lines": quality.ORACLE,
    "op9_lm_cross_entropy": lm_scoring.ORACLE,
    "op10_chat_prefix_target": chat.ORACLE,
}
