"""Declared schemas of the input and output tables."""

from pyspark.sql import types as T

_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


FILES = _table(repo=_S, commit_sha=_S, file_path=_S, content=_S, size=_L, metadata=T.MapType(_S, _S))

FILE_CHANGE = _table(file_path=_S, status=_S, patch=_S, content=_S)
COMMITS = _table(repo=_S, sha=_S, message=_S, author=_S, date=_TS, files=T.ArrayType(FILE_CHANGE))

VERDICT = _table(
    is_secret=T.BooleanType(), is_vulnerability=T.BooleanType(), type=_S, severity=_S,
    confidence=_D, remediation=_S, reasoning=_S,
)

FINDINGS = _table(
    id=_S, scan_id=_S, repo=_S, commit_sha=_S, file_path=_S, type=_S, severity=_S, confidence=_D,
    line_start=_I, line_end=_I, engine=_S, fingerprint=_S, evidence_hash=_S, masked_preview=_S,
    context=_S, context_reason=_S, classification_reason=_S, description=_S, remediation=_S,
    status=_S, notes=_S, first_seen_at=_TS, last_seen_at=_TS, created_at=_TS,
)

ENGINES = _table(regex=T.BooleanType(), mcp=T.BooleanType(), semgrep=T.BooleanType())
SCANS = _table(
    id=_S, repo_url=_S, branch=_S, mode=_S, status=_S, error_message=_S, risk_score=_D, total_files=_L,
    scanned_files=_L, skipped_files=_L, findings_count=_L, duration_ms=_L, engines=ENGINES,
    started_at=_TS, finished_at=_TS,
)

SCAN_RUNS = _table(
    id=_S, repo=_S, status=_S, commit_range=_S, started_at=_TS, ended_at=_TS, new_findings_count=_L, event_time=_TS,
)

# Domains of the status and severity columns.
STATUSES = ("NEW", "ACKNOWLEDGED", "RESOLVED", "FALSE_POSITIVE")
PATCH_STATUSES = ("NEW", "ACKNOWLEDGED", "RESOLVED")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
SCAN_STATUSES = ("queued", "running", "done", "error")
