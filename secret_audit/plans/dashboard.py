"""Dashboard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from secret_audit.operators.listing import recent_scans, scan_totals, top_types
from secret_audit.operators.metrics import scans_with_counts, severity_breakdown


def dashboard(scans: DataFrame, findings: DataFrame) -> dict[str, DataFrame]:
    """The tables of the dashboard by name; recent scans are cut to ten before findings are counted for them."""
    recent = recent_scans(scans, 10)
    theirs = findings.join(recent.select(recent["id"].alias("scan_id")), "scan_id", "left_semi")
    return {
        "totals": scan_totals(scans),
        "severity_breakdown": severity_breakdown(findings),
        "top_types": top_types(findings),
        "recent_scans": scans_with_counts(recent, theirs),
    }
