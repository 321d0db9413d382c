"""Commit scan: file versions in, scored and deduplicated findings out."""

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
from secret_audit.functions.text import location
from secret_audit.operators.detect import scan_lines_with_entropy
from secret_audit.operators.merge import dedupe_and_suppress, with_id
from secret_audit.rules import COMMIT_PACK, PLUGIN_PACK


def commit_findings(
    versions: DataFrame,
    rules=COMMIT_PACK,
    config: ContextConfig = ContextConfig(),
    threshold: float = 4.5,
    legacy_confidence: bool = False,
    legacy_key: bool = False,
) -> DataFrame:
    """Rules, entropy, context, classifier and dedupe in one read of the text and one shuffle of the hits."""
    hits = scan_lines_with_entropy(
        versions, rules, threshold=threshold, confidence="raw" if legacy_confidence else "scaled"
    )
    path, line, kind = F.col("file_path"), F.col("line"), F.col("type")
    predicates = context_predicates(path, line, config)
    scored = hits.withColumns({
        "_context": clamp(F.col("confidence") + adjustment_of(predicates)),
        "context_reason": reason_of(predicates),
        "_class": rule_confidence(kind, path, line),
        "classification_reason": F.concat(F.lit("Rule-based classification for "), kind),
    }).drop("line")
    kept = dedupe_and_suppress(scored, F.col("_context") >= config.min_confidence, legacy_key)
    out = kept.withColumn("confidence", F.greatest("_context", "_class")).drop("_context", "_class")
    return with_id(out, "repo", "commit_sha", "file_path", "fingerprint")


def plugin_findings(files: DataFrame, rules=PLUGIN_PACK, threshold: float = 4.5) -> DataFrame:
    """Rule and entropy findings as a bag, entropy tokens shaped like a rule left out."""
    found = scan_lines_with_entropy(files, rules, threshold=threshold, drop_rule_shapes=True)
    return found.withColumn("location", location(F.col("file_path"), F.col("line_start"))).drop("line")
