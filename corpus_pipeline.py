"""The corpus pipeline: quality filter, near-dedup, repeated-passage removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for label 1. It learns from the labelled ones
    among docs, the held-out fold apart."""
    from sheetloom.llm.quality import CUT, train, with_score

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return with_score(docs, train(docs, labels), "_score").where(f"_score >= {CUT}").drop("_score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least doc_id: those that SimHash
    links, and those of a five-word similarity of 0.8 or more."""
    from sheetloom.llm.similar import one_of_each

    return one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that a document of smaller doc_id has; n_chars follows."""
    from pyspark.sql import functions as F

    from sheetloom.llm.repeated_passages import without_repeats

    kept = without_repeats(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else kept


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into training sequences: one row per piece."""
    from sheetloom.llm.packing import pack_documents
    from sheetloom.llm.queries import WORD_TOKENIZER, vocabulary

    return pack_documents(docs, vocabulary(WORD_TOKENIZER))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_dedup", near_dedup), ("passages", passages), ("packing", packing)]

#: SQL has neither the classifier's fit nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    from sheetloom.llm.common import discard, materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)  # nothing but this stage reads its input
    return STAGES[-1][1](spark, docs, sf_dir)
