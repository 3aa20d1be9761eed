"""The corpus pipeline over documents: stages of the operators, each written and read again.

Every stage but the last returns the columns of documents, whatever they are. Rows without an id
pass the deduplication by similarity, which needs one; empty tables pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposift.llm.common import cut, ready, table, unused
from reposift.llm.exact_dedup import drop_exact_duplicates
from reposift.llm.language import UNKNOWN, fit_language_model, with_language
from reposift.llm.near_dedup import drop_near_duplicates
from reposift.llm.packing import pack
from reposift.llm.suffix_dedup import drop_repeated_passages

# Stages use the native and Python operators; their rows are decided by models and hashes that
# SQL does not have.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those that are null or without a letter go.

    The language that the model predicts changes nothing here, as a text with a letter always gets
    one: the stage rejects texts without a letter only. Where no document has a language to learn from, all with a letter stay.
    """
    ready(spark)
    found, score = unused(docs, "found"), unused(docs, "found_score")
    model = fit_language_model(docs)
    if not model.families:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    known = with_language(docs, model, names=(found, score))
    return known.filter(F.col(found) != UNKNOWN).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest id."""
    return drop_near_duplicates(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that have come before."""
    return drop_repeated_passages(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: one row per piece of a document, with its token ids."""
    return pack(docs)


STAGES = [
    ("language", language_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("passage dedup", passage_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
