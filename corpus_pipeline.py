"""The corpus pipeline: toxicity, quality rules, SimHash near-dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import op1_toxicity, op2_packing, op5_quality, op10_simhash
from kinweave.llm.common import stage, table, tokenizer_path
from kinweave.staging import Scope


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted toxic."""
    return op1_toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the limits or are outliers of their language and source."""
    return op5_quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-copies."""
    return op10_simhash.drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed documents."""
    return op2_packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("packing", packing)]

#: Not expressible in SQL: a trained model, XXH64 fingerprints, a tokenizer. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    with Scope(spark) as made:
        for name, step in STAGES:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
            made.drop(keep=1)  # what this stage was made from is not read again
    return docs
