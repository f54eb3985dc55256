"""Corpus pipeline over ``documents``: five stages, each one operator of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorewright.llm import exact_dedup, ngram_join, packing, pii, quality
from scorewright.llm.textops import drop_path, scratch, shared_path, written


# Every stage takes an empty table to an empty one, leaves other columns, whatever their names, as
# they are and reads only doc_id and text of them.


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; null texts and texts without words go, repeated rows fare alike."""
    return quality.without_junk(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, null being the empty one: most code points, then smallest doc_id (null last)."""
    return exact_dedup.without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id (null last) of each component of similar texts: five words, 0.8 or more.

    Texts without words are linked with nothing and stay.
    """
    return ngram_join.one_of_each(docs, words=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data; null texts, ids and repeated rows stay as they are."""
    return pii.with_surrogates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences; a null text is one piece of the end id, repeated rows are packed each."""
    return packing.best_fit_pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact dedup", exact_stage),
    ("near duplicates", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The quality stage's trained model is beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage kept is written as Parquet and read again.

    What a stage wrote besides is deleted when its result is written, and each result when the next is.
    """
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, path)
        if old:
            drop_path(spark, old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
