"""The queries of the training-data operators over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, decontaminate, language_id, license_scan, line_dedup, merkle, packing, quality, simhash, substring_dedup, suffix_dedup, suffix_tree_lm, token_file
from .common import read_table
from .oracle import ORACLE

#: Where the public vocabularies are; None asks the installed package.
TOKENIZER_DIR: str | None = None


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    if TOKENIZER_DIR:
        return f"{TOKENIZER_DIR}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digest(_docs(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_docs(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_docs(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(_docs(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_docs(spark, sf_dir))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_ids(_docs(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_docs(spark, sf_dir))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.lm_scores(_docs(spark, sf_dir))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digest(_docs(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return conversation_repair.repair_digest(conversation_repair.damaged(turns), turns)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_docs(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_suffix_dedup, op2_line_dedup, op3_license_scan, op4_packing, op5_simhash, op6_language_id, op7_token_ids, op8_quality_rules, op9_decontaminate, op10_lm_scores, op11_substring_dedup, op12_conversation_repair, op13_merkle_manifest, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
