"""From raw documents to packed training sequences: five stages, each one operator over all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bytepair, leaks, lines, neardup, packing, quality, shared

VOCABULARY = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the n-gram score keep; null and empty texts fail the rules."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat others; those of which no word is left go, so null and empty texts do."""
    rest = lines.dedup_lines(docs, counts=("__lines", "__removed", "__which")).where("__removed < __lines")
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies; a row without a doc_id goes if its group has one."""
    return neardup.drop_near(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows that repeat are judged each, null ids and null texts pass."""
    found = leaks.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "__leaks")
    return found.where(F.size("__leaks") == 0).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document, with a token for its end, lies in the training sequences; rows that repeat are packed each."""
    counts = bytepair.count_tokens(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
    return packing.pack_documents(shared.materialise(counts.select("doc_id", (F.col("n_tokens") + 1).alias("n_tokens")), "lengths"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The score of the first stage and the edit distances of the fourth aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
