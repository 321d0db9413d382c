"""Confidence from context and from a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secret_audit.functions.context import (
    ContextConfig,
    adjustment_of,
    clamp,
    context_predicates,
    reason_of,
    rule_confidence,
)


def score_context(hits: DataFrame, config: ContextConfig = ContextConfig()) -> DataFrame:
    """Adds context_adjustment and context_reason from ``file_path`` and ``line``."""
    predicates = context_predicates(F.col("file_path"), F.col("line"), config)
    return hits.withColumns({
        "context_adjustment": adjustment_of(predicates), "context_reason": reason_of(predicates),
    })


def filter_by_context(hits: DataFrame, config: ContextConfig = ContextConfig()) -> DataFrame:
    """Moves confidence by the context score, clamps it and keeps rows at or above the minimum."""
    scored = score_context(hits, config)
    moved = scored.withColumn("confidence", clamp(F.col("confidence") + F.col("context_adjustment")))
    return moved.where(F.col("confidence") >= config.min_confidence).drop("context_adjustment")


def classify_by_rule(hits: DataFrame) -> DataFrame:
    """Adds class_confidence, label and reasoning from type, path and line."""
    kind = F.col("type")
    return hits.withColumns({
        "class_confidence": rule_confidence(kind, F.col("file_path"), F.col("line")),
        "label": kind,
        "reasoning": F.concat(F.lit("Rule-based classification for "), kind),
    })


def merge_confidence(classified: DataFrame) -> DataFrame:
    """The larger of the context and the classifier confidence, with the classifier's reason."""
    return (
        classified.withColumn("confidence", F.greatest("confidence", "class_confidence"))
        .withColumn("classification_reason", F.col("reasoning"))
        .drop("class_confidence", "label", "reasoning")
    )
