"""Whole runs: a repository scan and a commit scan that write their tables.

A run has a version number. Running it again with the same number replaces what it wrote, so a job that was lost half
way is simply started again.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secret_audit.operators.merge import FINDING_KEY, fold_lifecycle, lifecycle, not_stored, with_id
from secret_audit.operators.metrics import cycle_summary, file_counters, risk_scores
from secret_audit.operators.remediation import remediation_plan
from secret_audit.operators.reports import alert_messages
from secret_audit.operators.select import (
    DEFAULT_EXCLUDE,
    DEFAULT_INCLUDE,
    select_files,
    selection_flags,
    selection_rejects,
)
from secret_audit.operators.verdicts import batch_requests, number_batches
from secret_audit.plans.commit_scan import commit_findings, plugin_findings
from secret_audit.plans.repo_scan import merged_findings, scan_findings
from secret_audit.rules import COMMIT_PACK, CONTENT_PACK
from secret_audit.schemas import SCAN_RUNS, SCANS
from secret_audit.sources import store


COMPACT_EVERY = 50


@dataclass(frozen=True)
class ScanRequest:
    """What to scan of each repository."""

    branch: str = "main"
    include: tuple[str, ...] = DEFAULT_INCLUDE
    exclude: tuple[str, ...] = DEFAULT_EXCLUDE
    max_files: int | None = None
    max_bytes_per_file: int | None = None
    strict: bool = True
    rules: tuple = field(default=CONTENT_PACK)
    #: Also write ``<base>/requests``: prompts for the model with the starred-out context of each finding.
    model_requests: bool = False

    def selection(self) -> dict:
        return {n: getattr(self, n) for n in ("include", "exclude", "max_files", "max_bytes_per_file", "strict")}


def _now() -> datetime:
    return datetime.now(timezone.utc)


def _time(value: datetime):
    return F.lit(value.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def scan_name(repo: Column, version: int) -> Column:
    """Id of a repository's scan in one run, so that a later run is another scan."""
    return F.concat(F.lit("scan-"), F.coalesce(repo, F.lit("unknown")), F.lit(f"-{version:010d}"))


def run_repo_scan(
    files: DataFrame, base: str, version: int, request: ScanRequest = ScanRequest(), verdicts: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Scan the files of any number of repositories; returns the stored (findings, scans) of this run.

    Files that the request leaves out are in ``<base>/rejects`` with their reasons. A run that fails leaves a scan with the
    error for each repository (or one without a repository, if the files can't be listed). ``scan_history`` reads all runs.
    """
    spark, started = files.sparkSession, _now()
    engines = F.struct(F.lit(True).alias("regex"), F.lit(verdicts is not None).alias("mcp"), F.lit(False).alias("semgrep"))

    def scan_rows(scans: DataFrame, status: str, error: str | None) -> DataFrame:
        finished = _now()
        facts = {
            "branch": F.lit(request.branch), "mode": F.lit("full"), "status": F.lit(status), "error_message": F.lit(error).cast("string"),
            "duration_ms": F.lit(int((finished - started).total_seconds() * 1000)).cast("long"), "engines": engines,
            "started_at": _time(started), "finished_at": _time(finished),
        }
        have = {**{c: F.col(c) for c in scans.columns}, **facts, "id": scan_name(F.col("repo"), version), "repo_url": F.col("repo")}
        return scans.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCANS])

    try:
        chosen = select_files(files, **request.selection()).withColumn("scan_id", scan_name(F.col("repo"), version))
        store.write_snapshot(scan_findings(chosen, request.rules, request.model_requests), f"{base}/raw", version)
        raw = store.read_version(spark, f"{base}/raw", version)
        if request.model_requests:
            store.write_snapshot(batch_requests(number_batches(raw)), f"{base}/requests", version)
        merged = merged_findings(raw, verdicts).withColumns({
            "created_at": _time(started), "first_seen_at": _time(started), "last_seen_at": _time(started),
        })
        store.write_snapshot(store.finding_rows(merged), f"{base}/findings", version)
        findings = store.read_version(spark, f"{base}/findings", version)
        store.write_snapshot(selection_rejects(files, **request.selection()), f"{base}/rejects", version)
        counters = file_counters(selection_flags(files, **request.selection()))
        scans = counters.withColumn("scan_id", scan_name(F.col("repo"), version))
        scored = risk_scores(findings, scans).withColumnRenamed("findings", "findings_count")
        store.write_snapshot(scan_rows(scans.join(scored, "scan_id"), "done", None), f"{base}/scans", version)
    except Exception as e:
        text = str(e).split("\n")[0][:1000]
        try:
            store.write_snapshot(scan_rows(files.select("repo").distinct(), "error", text), f"{base}/scans", version)
        except Exception:  # not even the names can be read
            nobody = spark.createDataFrame([(None,)], "repo string")
            store.write_snapshot(scan_rows(nobody, "error", text), f"{base}/scans", version)
        raise
    return findings, store.read_version(spark, f"{base}/scans", version)


def scan_history(spark: SparkSession, base: str) -> DataFrame | None:
    """The scans of all runs, failed ones included."""
    return store.read_history(spark, f"{base}/scans")


def run_commit_scan(versions: DataFrame, base: str, version: int, rules=COMMIT_PACK, **options) -> dict[str, DataFrame]:
    """Scan file versions of commits and fold them into the lifecycle table.

    ``versions`` comes from ``sources.commits`` and carries seen_at. Returns the ``new`` findings of this run, the
    ``lifecycle`` table, the ``alerts`` for the new findings and the ``runs`` record. A run that fails leaves an ERROR
    record.
    """
    spark, started = versions.sparkSession, _now()
    run = f"run-{version:010d}"

    def record(status: str, ended: datetime | None, new: int | None) -> None:
        row = (run, None, status, None, started, ended, new, ended or started)
        store.write_snapshot(spark.createDataFrame([row], SCAN_RUNS), f"{base}/runs/{run}", 1 if ended else 0)

    record("OK", None, None)
    try:
        found = commit_findings(versions.drop("metadata", "size"), rules, **options)
        store.write_snapshot(found, f"{base}/found", version)
        batch = store.read_version(spark, f"{base}/found", version)
        known = store.read_changes(spark, f"{base}/lifecycle", below=version)
        rows = with_id(lifecycle(batch, "seen_at"), *FINDING_KEY)
        fresh = rows if known is None else not_stored(rows, known, FINDING_KEY)
        store.write_snapshot(fresh, f"{base}/new", version)
        store.write_delta(rows, f"{base}/lifecycle", version)
        if store.open_deltas(spark, f"{base}/lifecycle") >= COMPACT_EVERY:
            folded = fold_lifecycle(store.read_changes(spark, f"{base}/lifecycle", below=version + 1))
            store.write_snapshot(folded, f"{base}/lifecycle", version)
        new = store.read_version(spark, f"{base}/new", version)
        record("OK", _now(), new.count())
    except Exception:
        record("ERROR", _now(), None)
        raise
    return {
        "new": new,
        "lifecycle": fold_lifecycle(store.read_changes(spark, f"{base}/lifecycle", below=version + 1)),
        "alerts": alert_messages(new.withColumn("run_id", F.lit(run)), "run_id"),
        "runs": store.current_runs(spark.read.schema(SCAN_RUNS).option("recursiveFileLookup", "true").parquet(f"{base}/runs")),
    }


def run_plugin_cycle(contexts: DataFrame, base: str, version: int, detect=plugin_findings, handle=remediation_plan) -> dict[str, DataFrame]:
    """One cycle over changed files: detect, store what is not stored yet, plan remediation, count.

    ``contexts`` has the files columns and seen_at. A stored finding is never changed; a version that is run again replaces
    its own rows. Returns the ``new`` findings, their ``plan`` and the ``cycle`` counters.
    """
    spark, run = contexts.sparkSession, f"cycle-{version:010d}"
    found = store.materialize(detect(contexts.drop("metadata", "size")))
    known = store.read_changes(spark, f"{base}/stored", below=version)
    fresh = lifecycle(found) if known is None else not_stored(lifecycle(found), known, FINDING_KEY)
    store.write_delta(with_id(fresh, *FINDING_KEY), f"{base}/stored", version)
    new = spark.read.parquet(store.delta_folder(f"{base}/stored", version))
    planned = handle(new)
    acted = F.coalesce(F.col("action") != "none", F.lit(False))
    null = F.lit(None).cast("string")
    seen = contexts.select(
        F.lit(run).alias("run_id"), "commit_sha", F.concat_ws(":", "repo", "commit_sha", "file_path").alias("context_id"), null.alias("finding_id"),
        F.lit(False).alias("alerted"), F.lit(False).alias("acted"), null.alias("error"),
    )
    hits = planned.select(
        F.lit(run).alias("run_id"), "commit_sha", null.alias("context_id"), F.col("id").alias("finding_id"), F.lit(False).alias("alerted"),
        acted.alias("acted"), null.alias("error"),
    )
    store.write_snapshot(cycle_summary(seen.unionByName(hits)), f"{base}/cycles", version)
    return {"new": new, "plan": planned, "cycle": store.read_version(spark, f"{base}/cycles", version)}
