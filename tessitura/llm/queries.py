"""The query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessitura.llm import bpe, chat_format, decontaminate, line_dedup, near_dup, pitman_yor, quality_classifier, quality_rules, substring_dedup, warc_audit
from tessitura.llm.common import table


def byte_bpe_path() -> str:
    """The public 50k byte-level vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.query(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.query(table(spark, sf_dir, "conversations"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.query(table(spark, sf_dir, "documents"), byte_bpe_path())


def op7_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_audit.query(table(spark, sf_dir, "pages"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.query(table(spark, sf_dir, "documents"))


def op10_odd_sketch_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.query(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.query(table(spark, sf_dir, "documents"))


def op5_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pitman_yor": op1_pitman_yor,
    "op2_quality_rules": op2_quality_rules,
    "op3_repeated_strings": op3_repeated_strings,
    "op4_chat_format": op4_chat_format,
    "op5_spaced_seed_decontamination": op5_spaced_seed_decontamination,
    "op6_bpe": op6_bpe,
    "op7_warc_audit": op7_warc_audit,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_odd_sketch_near_dup": op10_odd_sketch_near_dup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality_rules.oracle_sql(),
    "op4_chat_format": chat_format.ORACLE_SQL,
    "op7_warc_audit": warc_audit.ORACLE_SQL,
}
