"""Corpus pipeline: toxic and unreadable documents go, one document of each near-duplicate group stays, the rest is packed.

Each stage gets the table that the stage before it wrote. All but the last return the columns of ``documents``. Rows with
nulls stay unless a stage rejects them: a null text is neither toxic nor a duplicate, but has no language.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secret_audit.llm.dartminhash import without_near_duplicates
from secret_audit.llm.langid import UNKNOWN, identify_languages, train_language_model
from secret_audit.llm.packing import pack_documents
from secret_audit.llm.spark_tools import free_name, stored
from secret_audit.llm.toxicity import score_toxicity, train_chain

#: Language ID rejects a document without a letter, and one whose best language is less likely than this.
LEAST_LANGUAGE_SCORE = 0.4


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier chain finds toxic; it learns from the labels of the documents at hand."""
    model = train_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ["quality", "toxic"])
    prefix, decision = free_name(docs, "p_"), free_name(docs, "is_toxic")
    while {(prefix + c).lower() for c in model.categories} & {c.lower() for c in docs.columns}:
        prefix += "_"
    scored = score_toxicity(docs, model, keep=docs.columns, prefix=prefix, decision=decision)
    return scored.filter(~F.col(decision) | F.col("text").isNull()).select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told; it learns from the documents that carry one.

    Where no document carries one, only those without a letter go.
    """
    model = train_language_model(docs)
    if model is None:
        return docs.filter(F.col("text").cast("string").rlike(r"\p{L}"))
    language, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    known = identify_languages(docs, model, keep=docs.columns, language=language, score=score)
    return known.filter((F.col(language) != UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each class of near-duplicates."""
    return without_near_duplicates(docs).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece of a document."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("language_id", language_id), ("near_dedup", near_dedup), ("packing", packing)]

#: Trained models, near-duplicate search and packing can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
