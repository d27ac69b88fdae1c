"""A corpus pipeline of five stages, each on all rows that the stage before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame.  All stages but the last return the columns of ``docs``, whatever other columns
it has.  Nulls, empty and very long texts, ties, repeated rows and empty tables have the
results that each stage's operator states in its module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import bpe, decontaminate, line_dedup, near_dup, quality_rules
from tessitura.llm.common import discard, free_name, table, written
from tessitura.llm.queries import byte_bpe_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; so do those with null and empty texts (no words); equal rows are judged alike."""
    return quality_rules.keep_good(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike the first stays; ``n_chars`` follows the text; rows with a null key stay as they are; no row goes."""
    name = free_name(docs, "_removed")
    out = line_dedup.drop_lines(docs, removed=name)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(name) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop(name)


def first_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest key of each near-duplicate group stays; texts without words are like nothing and stay; null keys stay."""
    return near_dup.keep_first(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and empty texts hold none; an empty benchmark leaves all."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the token ids and of the text decoded from them, for every row; a null text counts as empty."""
    return bpe.query(docs, byte_bpe_path())


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", fresh_lines),
    ("near_dedup", first_of_alike),
    ("decontamination", clean_of_benchmark),
    ("bpe", encoded),
]

#: Fuzzy lines and spaced seeds have no SQL form; tests/llm/test_pipeline.py compares whole rows with plain versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
