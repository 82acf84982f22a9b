"""The corpus pipeline: documents to packed sequences, stage by stage.

Each stage takes what its predecessor kept.  Filtering stages return whole
rows of documents; substring dedup returns every row with its text cut.

Rows: an empty table stays empty in every stage.  Null text counts as empty;
the stages keep it as one document among equal ones.  Rows without doc_id are
never dropped by their id; rows that repeat one go together where a stage
judges by it.  Extra columns, whatever their names, go along up to the last
stage, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackweave.llm import exact, kneser_ney, packing, phrases, resemblance
from trackweave.llm.common import Scratch, release


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return kneser_ney.keepers(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.stays(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity 0.8 or more."""
    return resemblance.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller doc_id has."""
    return phrases.cleaned(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left; the last stage."""
    return packing.pack(docs, capacity=1024, end_id=2, lean=True)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
        release(spark)
    return docs


# Perplexity and tokenization have no SQL; tests hold run() against brute force.
ORACLE_SQL = None
