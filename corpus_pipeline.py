"""The corpus pipeline: toxic and low-quality documents go, one document of each group of near copies stays,
and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridoc.llm import common, importance, near_dedup, queries, toxicity


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic by a network fitted on the labels, judged by text alone, in all their columns.

    A null text counts as an empty one; repeated rows and ties stay or go together; null ids stay; columns of any
    name stay; an empty table stays empty."""
    return toxicity.without_toxic(docs, queries.table(spark, sf_dir, "labels"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling towards the labels' good ones draws, in all their columns.

    A null text counts as an empty one; repeated rows and ties at the cut stay or go together; null ids share one
    key's noise; columns of any name stay; an empty table stays empty."""
    return importance.selected_documents(docs, queries.table(spark, sf_dir, "labels"))


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each class of near copies, in all columns: one that the class's smallest id has.

    Null and empty texts are one class; repeated rows of the text that stays all stay, and so do rows without an id
    where no row of the class has one; columns of any name stay; an empty table stays empty."""
    return near_dedup.without_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences of the documents, a row for each piece; edge cases as in packed_documents."""
    return queries.packed_documents(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("quality", quality_filter),
    ("near_dedup", near_dedup_filter),
    ("packing", packed),
]

#: No stage can be stated in SQL; tests compare them with brute force and held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of sf_dir, each one's result written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
