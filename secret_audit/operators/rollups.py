"""Rollups that follow the findings: what a batch adds or changes is added up, the history is not read again.

A partial is the number of findings of a (day, repo, severity, status) and their weighted confidence. Partials add up, and a
finding whose status changes is taken back under the old one and added under the new one. A batch appends its own partials
as a delta; a repeated batch replaces its delta; many deltas are folded into a version (``sources.store``). Day, repository and
severity of a finding don't change, so sums of deltas equal a new count over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secret_audit.operators.metrics import DEFAULT_CONFIDENCE, severity_weight
from secret_audit.schemas import SEVERITIES
from secret_audit.sources.store import open_deltas, read_changes, write_delta, write_snapshot

KEYS = ("day", "repo", "severity", "status")


def partials(findings: DataFrame, at: str = "created_at") -> DataFrame:
    """Partials of new findings; combined before the shuffle."""
    weighted = severity_weight(F.col("severity")) * F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE))
    keyed = findings.withColumn("day", F.to_date(at))
    return keyed.groupBy(*KEYS).agg(F.count("*").alias("findings"), F.sum(weighted.cast("decimal(28,12)")).alias("weighted"))


def status_partials(findings: DataFrame, updates: DataFrame, at: str = "created_at") -> DataFrame:
    """Partials of status changes (id, status, one row per id): minus under the old status, plus under the new one.

    ``findings`` has the status before the updates. Ids that are unknown and statuses that stay the same change nothing.
    """
    new = updates.select("id", F.col("status").alias("_status"))
    changed = findings.join(new, "id").where(~F.col("status").eqNullSafe(F.col("_status")))
    back = partials(changed, at).withColumns({"findings": -F.col("findings"), "weighted": -F.col("weighted")})
    return fold_partials(back.unionByName(partials(changed.withColumn("status", F.col("_status")), at)))


def fold_partials(changes: DataFrame) -> DataFrame:
    """Partials added up; those that cancel out are left out."""
    wide = "decimal(38,12)"
    summed = changes.groupBy(*KEYS).agg(F.sum("findings").alias("findings"), F.sum("weighted").cast(wide).alias("weighted"))
    return summed.where((F.col("findings") != 0) | (F.col("weighted") != 0))  # one may leave as another comes


def append_partials(changes: DataFrame, base: str, batch_id: int, compact_every: int = 50) -> None:
    """Write the partials of one batch."""
    write_delta(fold_partials(changes), base, batch_id)
    if open_deltas(changes.sparkSession, base) >= compact_every:
        write_snapshot(read_partials(changes.sparkSession, base), base, batch_id)


def read_partials(spark: SparkSession, base: str) -> DataFrame | None:
    changes = read_changes(spark, base)
    return None if changes is None else fold_partials(changes.drop("_batch"))


def rollup(summed: DataFrame, by: tuple[str, ...] = ("day", "repo")) -> DataFrame:
    """Findings, counts by severity and risk score per day and repository, or by other columns of the partials."""
    counts = [F.sum(F.when(F.col("severity") == s, F.col("findings")).otherwise(0)).alias(s.lower()) for s in SEVERITIES]
    total = F.sum("findings")
    risk = F.least(F.lit(100.0), F.sum("weighted").cast("double") / (total * 10.0) * 100.0)
    return summed.groupBy(*by).agg(total.alias("findings_total"), *counts, risk.alias("risk_score_avg"))
