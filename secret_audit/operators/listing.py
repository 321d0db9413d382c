"""Filters, pages and latest-of queries behind the listing screens."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the largest page that the listing request allows; a caller that serves requests checks it.
REQUEST_PAGE = 1000


def filter_findings(
    findings: DataFrame,
    repo: str | None = None,
    severity: str | None = None,
    type: str | None = None,
    status: str | None = None,
    since: str | None = None,
) -> DataFrame:
    """Equality filters and ``first_seen_at >= since``; an unreadable date fails the query."""
    for name, value in {"repo": repo, "severity": severity, "type": type, "status": status}.items():
        if value:
            findings = findings.where(F.col(name) == value)
    if since:
        when = datetime.fromisoformat(since)
        findings = findings.where(F.col("first_seen_at") >= F.lit(when.isoformat(sep=" ")).cast("timestamp"))
    return findings


def by_ids(findings: DataFrame, ids, id_col: str = "id") -> DataFrame:
    """Rows with an id in a short list, or in the ``id`` column of a table."""
    if isinstance(ids, DataFrame):
        return findings.join(ids.select(F.col("id").alias(id_col)), id_col, "left_semi")
    return findings.where(F.col(id_col).isin(list(ids)))


def by_id(findings: DataFrame, value: str, id_col: str = "id") -> DataFrame:
    return findings.where(F.col(id_col) == value)


def search(findings: DataFrame, text: str, columns=("type", "description", "file_path", "repo")) -> DataFrame:
    """Case-insensitive substring over several columns."""
    if not text:
        return findings
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return findings.where(hit)


def page(df: DataFrame, by: str = "created_at", limit: int = 100, offset: int = 0, tie: str = "id") -> DataFrame:
    """Newest first with the id as tie-break; only offset + limit rows per task are kept. For far pages use ``page_after``."""
    if limit <= 0 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    return df.orderBy(F.desc(by), F.asc(tie)).offset(offset).limit(limit)


def page_after(df: DataFrame, last=None, by: str = "created_at", limit: int = 100, tie: str = "id") -> DataFrame:
    """The page behind the row ``last`` = (value of ``by``, id), the first one without it; costs the same however far it is."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    if last is not None:
        value, key = F.lit(last[0]).cast(df.schema[by].dataType), F.col(tie) > F.lit(last[1])
        if last[0] is None:
            df = df.where(F.col(by).isNull() & key)
        else:
            df = df.where((F.col(by) < value) | ((F.col(by) == value) & key) | F.col(by).isNull())
    return df.orderBy(F.desc(by), F.asc(tie)).limit(limit)


def top_types(findings: DataFrame, n: int = 5) -> DataFrame:
    return findings.groupBy("type").agg(F.count("*").alias("findings")).orderBy(F.desc("findings"), "type").limit(n)


def recent_scans(scans: DataFrame, n: int = 10) -> DataFrame:
    return scans.orderBy(F.desc_nulls_last("started_at"), "id").limit(n)


def scan_totals(scans: DataFrame, cap: int = 50) -> DataFrame:
    """Number of scans as the dashboard shows it, at most ``cap``, and the true number."""
    return scans.agg(F.least(F.count("*"), F.lit(cap)).alias("total_scans"), F.count("*").alias("all_scans"))


def latest(df: DataFrame, at: str = "started_at", *by: str, tie: str = "id") -> DataFrame:
    """The row with the latest time, overall or per group, without a sort."""
    row = F.max_by(F.struct(*df.columns), F.struct(at, tie)).alias("_r")
    return df.groupBy(*by).agg(row).where(F.col("_r").isNotNull()).select("_r.*")


def list_scans(metadata: DataFrame, limit: int = 100) -> DataFrame:
    """Stored scans, newest first."""
    return metadata.orderBy(F.desc_nulls_last("stored_at"), "scan_id").limit(limit)


def progress(status: Column, scanned: Column, total: Column) -> Column:
    """Percent shown while a scan runs: at most 90 until it is done."""
    share = F.least(F.lit(90), (scanned / total * 90).cast("int"))
    return (
        F.when(status == "running", F.when(total > 0, share).otherwise(50))
        .when(status == "done", 100)
        .otherwise(0)
    )
