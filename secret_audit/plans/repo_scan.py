"""Repository scan: files in, merged findings and scored scans out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secret_audit.operators.detect import findings_from_content
from secret_audit.operators.merge import merge_engines, with_id
from secret_audit.operators.metrics import risk_scores
from secret_audit.operators.verdicts import align_verdicts, apply_verdicts, number_batches
from secret_audit.rules import CONTENT_PACK

ID_COLUMNS = ("scan_id", "file_path", "type", "line_start", "rule_ord", "match_ord", "fingerprint")


def scan_findings(files: DataFrame, rules=CONTENT_PACK, context: bool = False) -> DataFrame:
    """Raw rule findings with scan_id and a deterministic id; ``files`` carries scan_id or uses the repo."""
    if "scan_id" not in files.columns:
        files = files.withColumn("scan_id", F.concat(F.lit("scan-"), F.coalesce("repo", F.lit("unknown"))))
    return with_id(findings_from_content(files, rules, context), *ID_COLUMNS)


def merged_findings(raw: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """One finding per path, start line and type in each scan; confirmed by the model first.

    With verdicts the raw findings are used several times and have to be a stored table.
    """
    if verdicts is None:
        return merge_engines(raw)
    # Verdicts with finding ids need no batch numbers.
    judged = align_verdicts(raw if "id" in verdicts.columns else number_batches(raw), verdicts)
    confirmed = apply_verdicts(judged).drop("batch_id", "position")
    return merge_engines(confirmed, raw)


def scan_results(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Per repo with at least one file: scan id, risk score and number of findings."""
    scans = files.select(F.concat(F.lit("scan-"), "repo").alias("scan_id")).distinct()
    return risk_scores(findings, scans)
