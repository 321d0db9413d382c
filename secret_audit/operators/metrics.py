"""Scores, counts and rollups over findings and scans.

Functions aggregate with a combine on the map side (by hash, but for the sample of ``alert_digest``), so a repository or scan that holds most of the
findings sends one row per task. Sums of fractions are taken in decimals: the result does not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secret_audit.functions.text import risk_band
from secret_audit.schemas import SEVERITIES

# Fixed values.
SEVERITY_WEIGHTS = {"CRITICAL": 10.0, "HIGH": 7.0, "MEDIUM": 4.0, "LOW": 1.0}
DEFAULT_WEIGHT = 1.0
DEFAULT_CONFIDENCE = 0.5


def severity_weight(severity: Column) -> Column:
    weight = F.lit(DEFAULT_WEIGHT)
    for name, value in SEVERITY_WEIGHTS.items():
        weight = F.when(severity == name, F.lit(value)).otherwise(weight)
    return weight


def risk_aggregate() -> Column:
    """Unrounded risk score of the findings in a group."""
    confidence = F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE))
    weighted = (severity_weight(F.col("severity")) * confidence).cast("decimal(28,12)")
    return F.least(F.lit(100.0), F.sum(weighted).cast("double") / (F.count("*") * 10.0) * 100.0)


def risk_scores(findings: DataFrame, scans: DataFrame | None = None, by: str = "scan_id", decimals: int | None = 2) -> DataFrame:
    """Risk score per group; with ``scans`` every scan is listed and one without findings scores 0."""
    score = findings.groupBy(by).agg(risk_aggregate().alias("risk_score"), F.count("*").alias("findings"))
    if scans is not None:
        score = scans.select(by).distinct().join(score, by, "left").fillna(0.0, ["risk_score"]).fillna(0, ["findings"])
    if decimals is None:
        return score
    return score.withColumn("risk_score", F.bround("risk_score", decimals))


def severity_breakdown(findings: DataFrame) -> DataFrame:
    """Count per severity, zeros kept, other values left out."""
    counts = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    pairs = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("findings")) for s in SEVERITIES])
    return counts.select(F.inline(pairs))


def count_by(findings: DataFrame, *columns: str, out: str = "findings") -> DataFrame:
    return findings.groupBy(*columns).agg(F.count("*").alias(out))


def count_by_status_and_kind(findings: DataFrame, status: str = "status", kind: str = "type") -> DataFrame:
    """Counts by status, by kind and the total from one pass; ``dimension`` names the grouping."""
    sets = findings.groupingSets([[status], [kind], []], status, kind).agg(
        F.count("*").alias("findings"), F.grouping_id().alias("_g")
    )
    dimension = F.when(F.col("_g") == 1, "status").when(F.col("_g") == 2, "kind").otherwise("total")
    value = F.when(F.col("_g") == 1, F.col(status)).when(F.col("_g") == 2, F.col(kind))
    return sets.select(dimension.alias("dimension"), value.alias("value"), "findings")


def mean_time_to_acknowledge(findings: DataFrame) -> DataFrame:
    """Seconds from first to last seen over acknowledged findings; null if there are none.

    A finding without both times adds nothing to the sum but counts in the mean.
    """
    # A long holds 292,000 years of microseconds, which many findings add up to.
    micros = (F.unix_micros("last_seen_at") - F.unix_micros("first_seen_at")).cast("decimal(20,0)")
    acknowledged = findings.where(F.col("status") == "ACKNOWLEDGED")
    total = F.coalesce(F.sum(micros).cast("double"), F.lit(0.0)) / 1e6
    return acknowledged.agg(F.when(F.count("*") > 0, total / F.count("*")).alias("mtta_seconds"))


def daily_rollup(findings: DataFrame, at: str = "created_at", scans: DataFrame | None = None) -> DataFrame:
    """Per day and repo: findings, counts by severity and the mean risk score of that day's scans.

    Without ``scans`` the risk is computed over the day's findings.
    """
    day = F.to_date(at).alias("day")
    counts = [F.count("*").alias("findings_total")] + [
        F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES
    ]
    if scans is None:
        return findings.groupBy(day, "repo").agg(*counts, risk_aggregate().alias("risk_score_avg"))
    risk = scans.groupBy(F.to_date("started_at").alias("day"), "repo").agg(
        F.avg(F.col("risk_score").cast("decimal(18,6)")).cast("double").alias("risk_score_avg")
    )
    rolled = findings.groupBy(day, "repo").agg(*counts).join(risk, ["day", "repo"], "full_outer")
    return rolled.fillna(0, ["findings_total", *[s.lower() for s in SEVERITIES]])


def alert_digest(findings: DataFrame, *by: str, sample: bool = False) -> DataFrame:
    """Totals by confidence band and a ``kind: n`` line, kinds in name order.

    Kinds are counted first, so the text is built from one row per kind. ``sample`` adds the finding with the lowest id
    as ``_sample``.
    """
    c = F.col("confidence")
    per_kind = findings.groupBy(*by, "type").agg(
        F.count("*").alias("n"),
        F.count_if(c >= 0.8).alias("high"),
        F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"),
        F.count_if(c < 0.5).alias("low"),
        *([F.min_by(F.struct(*[x for x in findings.columns if x not in by]), "id").alias("_sample")] if sample else []),
    )
    kinds = F.sort_array(F.collect_list(F.struct("type", "n")))
    line = F.array_join(F.transform(kinds, lambda k: F.concat(k["type"], F.lit(": "), k["n"])), ", ")
    return per_kind.groupBy(*by).agg(
        F.sum("n").alias("total"), F.sum("high").alias("high"), F.sum("medium").alias("medium"),
        F.sum("low").alias("low"), line.alias("kind_summary"),
        *([F.min_by("_sample", F.col("_sample.id")).alias("_sample")] if sample else []),
    )


def cycle_summary(cycles: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: commits and contexts processed, findings, alerts, actions and errors.

    ``cycles`` has one row per finding or processed file with commit_sha, context_id, finding_id, alerted, acted and
    error.
    """
    per_commit = cycles.groupBy(run, "commit_sha").agg(
        F.count("context_id").alias("contexts"), F.count("finding_id").alias("findings"),
        F.count_if("alerted").alias("alerts"), F.count_if("acted").alias("actions"), F.count("error").alias("errors"),
    )
    return per_commit.groupBy(run).agg(
        F.count("commit_sha").alias("commits_processed"),
        F.sum("contexts").alias("contexts_processed"),
        F.sum("findings").alias("findings_detected"),
        F.sum("alerts").alias("alerts_sent"),
        F.sum("actions").alias("remediation_actions"),
        F.sum("errors").alias("errors"),
    )


def usage_totals(usage: DataFrame) -> DataFrame:
    """Requests and tokens by provider and model, with subtotals per provider and a total (nulls)."""
    return usage.rollup("provider", "model").agg(
        F.count("*").alias("requests"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )


def file_counters(flags: DataFrame, by: str = "repo") -> DataFrame:
    """Total, scanned and skipped files from ``selection_flags`` output."""
    s = F.col("selection")
    return flags.groupBy(by).agg(
        F.count("*").alias("total_files"),
        F.count_if(s == "selected").alias("scanned_files"),
        F.count_if(s != "selected").alias("skipped_files"),
    )


def scans_with_counts(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Every scan with its number of findings; counts are taken before the join."""
    counts = findings.groupBy("scan_id").agg(F.count("*").alias("findings_count"))
    rest = scans.drop("findings_count")
    return rest.join(counts, rest["id"] == counts["scan_id"], "left").drop("scan_id").fillna(0, ["findings_count"])


def scan_report(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Scan attributes on each of its findings; a scan without findings keeps one row.

    An inner join plus the scans without findings, because a left join could not split the findings of a large scan.
    """
    head = scans.select(
        F.col("id").alias("scan_id"), "repo_url", "branch", F.col("status").alias("scan_status"), "risk_score",
        risk_band(F.col("risk_score")).alias("risk_band"),
    )
    empty = head.join(findings.select("scan_id").distinct(), "scan_id", "left_anti")
    return findings.join(head, "scan_id").unionByName(empty, allowMissingColumns=True)
