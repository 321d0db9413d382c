"""Merged findings and what is computed from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from secret_audit.checks import corpus, oracle as o
from secret_audit.checks.registry import query
from secret_audit.functions import text as T
from secret_audit.operators import listing as L
from secret_audit.operators import metrics as A
from secret_audit.operators import remediation as R
from secret_audit.operators import reports
from secret_audit.operators import rollups as U
from secret_audit.operators import search as X
from secret_audit.operators import verdicts as V
from secret_audit.operators.merge import append_notes, union_all
from secret_audit.plans.dashboard import dashboard
from secret_audit.plans.repo_scan import merged_findings, scan_findings, scan_results
from secret_audit.rules import CONTENT_PACK
from secret_audit.session import shared_dir
from secret_audit.sources.store import materialize

_STATUS = "CASE doc_id % 4 WHEN 0 THEN 'NEW' WHEN 1 THEN 'ACKNOWLEDGED' WHEN 2 THEN 'RESOLVED' ELSE 'FALSE_POSITIVE' END"


def raw_findings(spark, sf):
    return scan_findings(corpus.files(spark, sf))


def with_times(merged):
    minute = "timestampadd(MINUTE, {}, timestamp '2024-01-01 00:00:00')"
    return merged.withColumns({
        "status": F.expr(_STATUS),
        "created_at": F.expr(minute.format("doc_id")),
        "first_seen_at": F.expr(minute.format("doc_id")),
        "last_seen_at": F.expr(minute.format("doc_id * 3")),
    })


def findings(spark, sf):
    return with_times(merged_findings(raw_findings(spark, sf)))


def stored_findings(spark, sf):
    """Findings written once, for queries that read them more than once."""
    return materialize(findings(spark, sf))


def stored_raw(spark, sf):
    return materialize(raw_findings(spark, sf))


_ID = "id, scan_id, file_path, type, severity, confidence, line_start, line_end, engine, fingerprint, masked_preview"


@query("merged_findings", o.on_findings(f"SELECT {_ID} FROM findings"))
def merged_findings_query(spark, sf):
    return findings(spark, sf).select(*_ID.split(", "))


@query("detector_union", o.with_(
    *o.BASE, o.LINES, o.CANDIDATES,
    select="SELECT file_path, type, line_start, match_ord, fingerprint, CAST(NULL AS DOUBLE) AS entropy FROM raw_findings UNION ALL "
           "SELECT file_path, 'high_entropy_string', line_start, match_ord, sha256(secret), round(entropy, 6) FROM candidates WHERE round(entropy, 12) >= 4.5"))
def detector_union(spark, sf):
    from secret_audit.functions.mask import fingerprint
    from secret_audit.operators.detect import entropy_candidates

    cols = ["file_path", "type", "line_start", "match_ord", "fingerprint"]
    tokens = entropy_candidates(corpus.files(spark, sf)).withColumn("type", F.lit("high_entropy_string"))
    tokens = tokens.withColumn("fingerprint", fingerprint(F.col("secret"))).select(*cols, F.round("entropy", 6).alias("entropy"))
    return union_all(raw_findings(spark, sf).select(*cols), tokens)


# --- scores and counts -----------------------------------------------------------------------------------------------

@query("repo_risk_scores", o.on_findings(
    f"SELECT s.scan_id, round(coalesce(r.risk, 0.0), 6) AS risk_score, coalesce(r.n, 0) AS findings FROM "
    f"(SELECT DISTINCT concat('scan-', repo) AS scan_id FROM files) s LEFT JOIN "
    f"(SELECT scan_id, {o.risk()} AS risk, count(*) AS n FROM findings GROUP BY scan_id) r USING (scan_id)"))
def repo_risk_scores(spark, sf):
    scans = corpus.files(spark, sf).select(F.concat(F.lit("scan-"), "repo").alias("scan_id"))
    scores = A.risk_scores(merged_findings(raw_findings(spark, sf)), scans, decimals=None)
    return scores.select("scan_id", F.round("risk_score", 6).alias("risk_score"), "findings")


@query("risk_scores_of_all_scans", o.on_findings(
    f"SELECT s.id AS scan_id, round(coalesce(r.risk, 0.0), 6) AS risk_score, coalesce(r.n, 0) AS findings FROM repo_scans s LEFT JOIN "
    f"(SELECT scan_id, {o.risk()} AS risk, count(*) AS n FROM findings GROUP BY scan_id) r ON r.scan_id = s.id", o.REPO_SCANS))
def risk_scores_of_all_scans(spark, sf):
    scans = corpus.repo_scans(spark, sf).select(F.col("id").alias("scan_id"))
    scores = A.risk_scores(findings(spark, sf), scans, decimals=None)
    return scores.select("scan_id", F.round("risk_score", 6).alias("risk_score"), "findings")


@query("scan_results", o.on_findings(
    f"SELECT scan_id, round_even({o.risk()}, 2) AS risk_score, count(*) AS findings FROM findings GROUP BY scan_id"))
def scan_results_query(spark, sf):
    return scan_results(corpus.files(spark, sf), findings(spark, sf))


@query("severity_breakdown", o.on_findings(
    "SELECT s AS severity, count(id) AS findings FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) v(s) "
    "LEFT JOIN findings ON severity = s GROUP BY s"))
def severity_breakdown(spark, sf):
    return A.severity_breakdown(findings(spark, sf))


@query("count_by_type", o.on_findings("SELECT type, count(*) AS findings FROM findings GROUP BY type"))
def count_by_type(spark, sf):
    return A.count_by(findings(spark, sf), "type")


@query("count_by_status_and_kind", o.on_findings(
    "SELECT 'status' AS dimension, status AS value, count(*) AS findings FROM findings GROUP BY status UNION ALL "
    "SELECT 'kind', type, count(*) FROM findings GROUP BY type UNION ALL SELECT 'total', NULL, count(*) FROM findings"))
def count_by_status_and_kind(spark, sf):
    return A.count_by_status_and_kind(findings(spark, sf))


@query("filtered_total", o.on_findings(
    "SELECT count(*) AS total FROM findings WHERE severity = 'HIGH' AND status = 'NEW' AND first_seen_at >= timestamp '2024-01-01 02:00:00'"))
def filtered_total(spark, sf):
    kept = L.filter_findings(findings(spark, sf), severity="HIGH", status="NEW", since="2024-01-01T02:00:00")
    return kept.agg(F.count("*").alias("total"))


@query("mean_time_to_acknowledge", o.on_findings(
    "SELECT round(avg((epoch_us(last_seen_at) - epoch_us(first_seen_at)) / 1e6), 6) AS mtta_seconds FROM findings WHERE status = 'ACKNOWLEDGED'"))
def mean_time_to_acknowledge(spark, sf):
    return A.mean_time_to_acknowledge(findings(spark, sf)).select(F.round("mtta_seconds", 6).alias("mtta_seconds"))


_SEV = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))


@query("daily_rollup", o.on_findings(
    f"SELECT CAST(created_at AS DATE) AS day, repo, count(*) AS findings_total, {_SEV}, round({o.risk()}, 6) AS risk_score_avg "
    "FROM findings GROUP BY ALL"))
def daily_rollup(spark, sf):
    return A.daily_rollup(findings(spark, sf)).withColumn("risk_score_avg", F.round("risk_score_avg", 6))


@query("daily_rollup_with_scans", o.on_findings(
    f"SELECT coalesce(f.day, s.day) AS day, coalesce(f.repo, s.repo) AS repo, coalesce(findings_total, 0) AS findings_total, "
    "coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, risk_score_avg FROM "
    f"(SELECT CAST(created_at AS DATE) AS day, repo, count(*) AS findings_total, {_SEV} FROM findings GROUP BY ALL) f FULL JOIN "
    "(SELECT CAST(started_at AS DATE) AS day, concat('src', regexp_extract(repo_url, '[0-9]$')) AS repo, round(avg(risk_score), 6) AS risk_score_avg "
    "FROM scans GROUP BY ALL) s USING (day, repo)", o.SCANS))
def daily_rollup_with_scans(spark, sf):
    scans = corpus.scans(spark, sf).withColumn(
        "repo", F.concat(F.lit("src"), F.regexp_extract("repo_url", "[0-9]$", 0)))
    rolled = A.daily_rollup(findings(spark, sf), scans=scans)
    return rolled.withColumn("risk_score_avg", F.round("risk_score_avg", 6))


_CHANGED = "CASE WHEN doc_id % 3 = 0 THEN 'RESOLVED' ELSE status END"


def _rollup_base(spark, sf):
    """Partials of findings that come in two batches and of status changes, one batch being written twice."""
    base, found = shared_dir(spark, "rollup"), stored_findings(spark, sf)
    updates = found.where("doc_id % 3 = 0").select("id", F.lit("RESOLVED").alias("status"))
    steps = [U.partials(found.where("doc_id % 2 = 0")), U.partials(found.where("doc_id % 2 = 1")), U.status_partials(found, updates)]
    for batch, step in [*enumerate(steps), (2, steps[2])]:
        U.append_partials(step, base, batch, compact_every=2)
    return base


@query("incremental_rollup", o.on_findings(
    f"SELECT CAST(created_at AS DATE) AS day, repo, count(*) AS findings_total, {_SEV}, round({o.risk()}, 6) AS risk_score_avg FROM findings GROUP BY ALL"))
def incremental_rollup(spark, sf):
    rolled = U.rollup(U.read_partials(spark, _rollup_base(spark, sf)))
    return rolled.withColumn("risk_score_avg", F.round("risk_score_avg", 6))


@query("incremental_status_counts", o.on_findings(
    f"SELECT repo, {_CHANGED} AS status, count(*) AS findings_total, {_SEV}, round({o.risk()}, 6) AS risk_score_avg FROM findings GROUP BY ALL"))
def incremental_status_counts(spark, sf):
    """After status changes: equal to counting the changed table anew."""
    rolled = U.rollup(U.read_partials(spark, _rollup_base(spark, sf)), ("repo", "status"))
    return rolled.withColumn("risk_score_avg", F.round("risk_score_avg", 6))


_DIGEST = (
    "count(*) AS total, count(*) FILTER (WHERE confidence >= 0.8) AS high, "
    "count(*) FILTER (WHERE confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (WHERE confidence < 0.5) AS low"
)


@query("alert_digest", o.on_findings(
    f"SELECT scan_id, total, high, medium, low, kind_summary FROM (SELECT scan_id, {_DIGEST} FROM findings GROUP BY scan_id) JOIN "
    "(SELECT scan_id, string_agg(type || ': ' || n, ', ' ORDER BY type) AS kind_summary FROM "
    "(SELECT scan_id, type, count(*) AS n FROM findings GROUP BY ALL) GROUP BY scan_id) USING (scan_id)"))
def alert_digest(spark, sf):
    return A.alert_digest(findings(spark, sf), "scan_id")


@query("cycle_summary", o.on_findings(
    "SELECT scan_id AS run_id, count(DISTINCT f.commit_sha) AS commits_processed, count(DISTINCT f.doc_id) AS contexts_processed, "
    "count(m.id) AS findings_detected, count(*) FILTER (WHERE m.confidence >= 0.8) AS alerts_sent, "
    "count(*) FILTER (WHERE m.type = 'aws_access_key') AS remediation_actions, "
    "count(*) FILTER (WHERE m.id IS NULL AND f.doc_id % 2 = 0) AS errors FROM (SELECT *, concat('scan-', repo) AS scan_id FROM files) f "
    "LEFT JOIN (SELECT doc_id, id, confidence, type FROM findings) m USING (doc_id) GROUP BY scan_id"))
def cycle_summary(spark, sf):
    null = F.lit(None)
    found = stored_findings(spark, sf).select(
        F.col("scan_id").alias("run_id"), "commit_sha", null.cast("string").alias("context_id"), F.col("id").alias("finding_id"),
        (F.col("confidence") >= 0.8).alias("alerted"), (F.col("type") == "aws_access_key").alias("acted"),
        null.cast("string").alias("error"), "doc_id")
    hit = found.select("doc_id").distinct().withColumn("hit", F.lit(True))
    scanned = corpus.files(spark, sf).select("repo", "commit_sha", "file_path", "doc_id").join(hit, "doc_id", "left").select(
        F.concat(F.lit("scan-"), "repo").alias("run_id"), "commit_sha", F.col("file_path").alias("context_id"),
        null.cast("string").alias("finding_id"), F.lit(False).alias("alerted"), F.lit(False).alias("acted"),
        F.when(F.col("hit").isNull() & (F.col("doc_id") % 2 == 0), "empty").alias("error"), "doc_id")
    return A.cycle_summary(scanned.unionByName(found))


@query("scans_with_counts", o.on_findings(
    "SELECT s.id, s.repo_url, coalesce(n, 0) AS findings_count FROM repo_scans s LEFT JOIN "
    "(SELECT scan_id, count(*) AS n FROM findings GROUP BY scan_id) c ON c.scan_id = s.id", o.REPO_SCANS))
def scans_with_counts(spark, sf):
    return A.scans_with_counts(corpus.repo_scans(spark, sf), findings(spark, sf)).select("id", "repo_url", "findings_count")


@query("scan_report", o.on_findings(
    "SELECT s.id AS scan_id, s.repo_url, s.branch, CASE WHEN risk >= 80 THEN 'Critical' WHEN risk >= 60 THEN 'High' "
    "WHEN risk >= 40 THEN 'Medium' ELSE 'Low' END AS risk_band, f.file_path, f.type, f.line_start FROM repo_scans s "
    f"LEFT JOIN (SELECT scan_id, {o.risk()} AS risk FROM findings GROUP BY scan_id) r ON r.scan_id = s.id "
    "LEFT JOIN findings f ON f.scan_id = s.id", o.REPO_SCANS))
def scan_report(spark, sf):
    found = stored_findings(spark, sf)
    ids = corpus.repo_scans(spark, sf).select(F.col("id").alias("scan_id"))
    scores = A.risk_scores(found, ids, decimals=None).select(F.col("scan_id").alias("id"), "risk_score")
    scans = corpus.repo_scans(spark, sf).join(scores, "id")
    return A.scan_report(scans, found.drop("status")).select(
        "scan_id", "repo_url", "branch", "risk_band", "file_path", "type", "line_start")


# --- listings --------------------------------------------------------------------------------------------------------

_PAGE = ["id", "type", "severity", "repo", "file_path", "line_start", "created_at"]


@query("finding_filters", o.on_findings(
    f"SELECT {', '.join(_PAGE)} FROM findings WHERE repo = 'src3' AND severity = 'CRITICAL' AND type = 'aws_secret_key'"))
def finding_filters(spark, sf):
    return L.filter_findings(findings(spark, sf), repo="src3", severity="CRITICAL", type="aws_secret_key").select(*_PAGE)


@query("findings_page", o.on_findings(
    f"SELECT {', '.join(_PAGE)} FROM findings ORDER BY created_at DESC, id LIMIT 25 OFFSET 50"))
def findings_page(spark, sf):
    return L.page(findings(spark, sf).select(*_PAGE), limit=25, offset=50)


@query("findings_page_after", o.on_findings(
    f"SELECT {', '.join(_PAGE)} FROM findings ORDER BY created_at DESC, id LIMIT 25 OFFSET 50"))
def findings_page_after(spark, sf):
    """The same page found from the row before it."""
    rows = stored_findings(spark, sf).select(*_PAGE)
    before = L.page(rows, limit=1, offset=49).first()
    return L.page_after(rows, before and (before["created_at"], before["id"]), limit=25)


@query("findings_by_id_table", o.on_findings(
    "SELECT id, type FROM findings WHERE id IN (SELECT sha256(concat_ws('|', concat('scan-', repo), file_path, type, line_start, "
    "rule_ord, match_ord, fingerprint)) FROM raw_findings WHERE doc_id % 7 = 0)"))
def findings_by_id_table(spark, sf):
    ids = raw_findings(spark, sf).where("doc_id % 7 = 0").select("id")
    return L.by_ids(findings(spark, sf), ids).select("id", "type")


@query("findings_by_id_list", o.on_findings(
    "SELECT id, type, file_path FROM findings WHERE fingerprint IN (sha256('AKIA' || upper(sha256('0')[1:16])), "
    "sha256('AKIA' || upper(sha256('3')[1:16])))"))
def findings_by_id_list(spark, sf):
    import hashlib

    def secret(i):
        return "AKIA" + hashlib.sha256(str(i).encode()).hexdigest()[:16].upper()

    ids = [hashlib.sha256(secret(i).encode()).hexdigest() for i in (0, 3)]
    return L.by_ids(findings(spark, sf), ids, "fingerprint").select("id", "type", "file_path")


@query("finding_lookup", o.on_findings(
    "SELECT fingerprint, type, file_path FROM findings WHERE fingerprint = sha256('AKIA' || upper(sha256('6')[1:16]))"))
def finding_lookup(spark, sf):
    import hashlib

    secret = "AKIA" + hashlib.sha256(b"6").hexdigest()[:16].upper()
    return L.by_id(findings(spark, sf), hashlib.sha256(secret.encode()).hexdigest(), "fingerprint").select(
        "fingerprint", "type", "file_path")


@query("finding_search", o.on_findings(
    "SELECT id, type, file_path FROM findings WHERE contains(lower(concat_ws(chr(10), type, description, file_path, repo)), 'settings') "
    "OR contains(lower(description), 'aws')"))
def finding_search(spark, sf):
    f = stored_findings(spark, sf)
    both = L.search(f, "Settings").unionByName(L.search(f, "AWS", columns=("description",))).dropDuplicates(["id"])
    return both.select("id", "type", "file_path")


@query("finding_search_indexed", o.on_findings(
    "SELECT id, type, file_path FROM findings WHERE contains(lower(concat_ws(chr(10), type, description, file_path, repo)), 'settings') "
    "OR contains(lower(description), 'aws')"))
def finding_search_indexed(spark, sf):
    """The same rows from the blocks that the trigrams of the texts lead to."""
    base = shared_dir(spark, "search")
    X.write_search_index(stored_findings(spark, sf), base, rows_per_block=500)
    both = X.search_index(spark, base, "Settings").unionByName(X.search_index(spark, base, "AWS", ("description",)))
    return both.dropDuplicates(["id"]).select("id", "type", "file_path")


@query("top_types", o.on_findings("SELECT type, count(*) AS findings FROM findings GROUP BY type ORDER BY findings DESC, type LIMIT 5"))
def top_types(spark, sf):
    return L.top_types(findings(spark, sf))


@query("dashboard_recent_scans", o.on_findings(
    "SELECT r.id, r.repo_url, count(f.id) AS findings_count FROM (SELECT * FROM repo_scans ORDER BY started_at DESC, id LIMIT 10) r "
    "LEFT JOIN findings f ON f.scan_id = r.id GROUP BY ALL", o.REPO_SCANS))
def dashboard_recent_scans(spark, sf):
    tables = dashboard(corpus.repo_scans(spark, sf), findings(spark, sf))
    return tables["recent_scans"].select("id", "repo_url", "findings_count")


@query("confidence_bands", o.on_findings(
    "SELECT id, CAST(trunc(confidence * 100) AS INTEGER) AS percent, CASE WHEN trunc(confidence * 100) >= 80 THEN 'high' "
    "WHEN trunc(confidence * 100) >= 50 THEN 'medium' ELSE 'low' END AS band FROM findings"))
def confidence_bands(spark, sf):
    c = F.col("confidence")
    return findings(spark, sf).select("id", T.confidence_percent(c).alias("percent"), T.confidence_band(c).alias("band"))


# --- documents -------------------------------------------------------------------------------------------------------

_HUNK = (
    "'--- a/' || file_path || chr(10) || '+++ b/' || file_path || chr(10) || '@@ -' || line_start || ',1 +' || line_start || ',1 @@' || chr(10) "
    "|| '-' || description || chr(10) || '+# SECRET REMOVED - ' || remediation || chr(10)"
)


@query("unified_diff", o.on_findings(
    f"SELECT scan_id, '' AS part, count(*) AS findings, string_agg({_HUNK}, chr(10) ORDER BY file_path, line_start, id) AS unified_diff "
    "FROM findings GROUP BY scan_id"))
def unified_diff(spark, sf):
    return reports.unified_diff(stored_findings(spark, sf))


@query("finding_document_parts", o.on_findings(
    "SELECT scan_id, part, count(*) AS findings, string_agg(id, ',' ORDER BY file_path, line_start, id) AS ids FROM "
    "(SELECT *, id[1:greatest(0, ceil(ln(n / 10.0) / ln(16.0)))::INT] AS part FROM "
    "(SELECT *, count(*) OVER (PARTITION BY scan_id) AS n FROM findings)) GROUP BY ALL"))
def finding_document_parts(spark, sf):
    from secret_audit.operators.numbering import document_parts

    parts = document_parts(stored_findings(spark, sf), "scan_id", target=10)
    return parts.groupBy("scan_id", "part").agg(
        F.count("*").alias("findings"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file_path", "line_start", "id"))), lambda x: x["id"]), ",").alias("ids"))


@query("pull_request_text", o.on_findings(
    "SELECT scan_id, '' AS part, count(*) AS findings, 'Security: Fix ' || count(*) || ' secret(s) in ' || min(repo) AS pr_title, "
    "'## Security Fix: ' || count(*) || ' Secret(s) Removed' || chr(10) || chr(10) || "
    f"{o.lit(reports.PR_INTRO)} || string_agg('### ' || type || ' in ' || file_path || ':' || line_start || chr(10) || '- **Severity**: ' || severity "
    "|| chr(10) || '- **Confidence**: ' || printf('%.2f', confidence) || chr(10) || '- **Remediation**: ' || remediation || chr(10) || chr(10), '' "
    f"ORDER BY file_path, line_start, id) || {o.lit(reports.PR_FOOTER)} AS pr_body FROM findings GROUP BY scan_id"))
def pull_request_text(spark, sf):
    return reports.pull_request(stored_findings(spark, sf))


_SARIF_RULES = ", ".join(
    "{'id': " + o.lit(i) + ", 'name': " + o.lit(n) + ", 'shortDescription': {'text': " + o.lit(s) + "}, 'fullDescription': {'text': "
    + o.lit(f) + "}, 'helpUri': " + o.lit(u) + "}" for i, n, s, f, u in reports.SARIF_RULES)


@query("sarif_export", o.on_findings(
    "SELECT scan_id, '' AS part, CAST(len(results) AS INTEGER) AS results, CAST(to_json({'$schema': " + o.lit(reports.SARIF_SCHEMA)
    + ", 'version': '2.1.0', 'runs': [{'tool': {'driver': {'name': " + o.lit(reports.TOOL_NAME) + ", 'version': '1.0.0', 'informationUri': "
    + o.lit(reports.TOOL_URI) + ", 'rules': [" + _SARIF_RULES + "]}}, 'results': results, 'artifacts': [{'location': {'uri': repo_url, "
    "'uriBaseId': 'ROOT'}, 'description': {'text': 'Repository: ' || repo_url || ' (' || branch || ')'}}]}]}) AS VARCHAR) AS sarif FROM "
    "(SELECT s.id AS scan_id, s.repo_url, s.branch, coalesce(list({'ruleId': regexp_replace(type, '_', '-'), 'level': CASE WHEN severity IN ('CRITICAL', 'HIGH') "
    "THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END, 'message': {'text': description}, 'locations': [{'physicalLocation': "
    "{'artifactLocation': {'uri': file_path, 'uriBaseId': 'ROOT'}, 'region': {'startLine': line_start, 'endLine': line_end}}}], 'properties': "
    "{'confidence': confidence, 'severity': severity, 'remediation': remediation}} ORDER BY file_path, line_start, f.id) FILTER (WHERE f.id IS NOT NULL), []) AS results "
    "FROM repo_scans s LEFT JOIN findings f ON s.id = f.scan_id GROUP BY s.id, s.repo_url, s.branch)", o.REPO_SCANS))
def sarif_export(spark, sf):
    return reports.sarif(stored_findings(spark, sf), corpus.repo_scans(spark, sf))


@query("sarif_files", o.on_findings(
    "SELECT s.id AS scan_id, count(f.id) AS results, coalesce(string_agg(f.file_path || ':' || f.line_start || ' ' || regexp_replace(f.type, '_', '-'), ';' "
    "ORDER BY file_path, line_start, f.id), '') AS listed, 'Repository: ' || any_value(repo_url) || ' (' || any_value(branch) || ')' AS artifact "
    "FROM repo_scans s LEFT JOIN findings f ON s.id = f.scan_id GROUP BY s.id", o.REPO_SCANS))
def sarif_files(spark, sf):
    """One SARIF file per scan, written and read back."""
    path = shared_dir(spark, "sarif")
    reports.write_lines(reports.sarif_lines(stored_findings(spark, sf), corpus.repo_scans(spark, sf)), path)
    result = "struct<ruleId:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>"
    parsed = F.from_json("value", f"runs array<struct<results:array<{result}>,artifacts:array<struct<description:struct<text:string>>>>>")
    run = F.get(F.col("_doc.runs"), F.lit(0))
    place = lambda r: F.get(r["locations"], F.lit(0))["physicalLocation"]
    line = F.transform(run["results"], lambda r: F.concat(
        place(r)["artifactLocation"]["uri"], F.lit(":"), place(r)["region"]["startLine"], F.lit(" "), r["ruleId"]))
    return reports.read_documents(spark, path).withColumn("_doc", parsed).select(
        "scan_id", F.size(run["results"]).cast("long").alias("results"), F.array_join(line, ";").alias("listed"),
        F.get(run["artifacts"], F.lit(0))["description"]["text"].alias("artifact"))


@query("report_sections", o.on_findings(
    "SELECT scan_id, severity, section, count(*) AS severity_findings, string_agg(type || '|' || file_path || '|' || line_start || '|' || "
    "printf('%.1f', confidence * 100), ';' ORDER BY file_path, line_start, id) AS listed FROM (SELECT *, "
    "CAST(list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], severity) AS INTEGER) AS section FROM findings) GROUP BY ALL"))
def report_sections(spark, sf):
    line = F.transform("findings", lambda f: F.concat_ws(
        "|", f["type"], f["file_path"], f["line_start"].cast("string"), f["confidence_percent"].cast("string")))
    return reports.report_sections(stored_findings(spark, sf)).select(
        "scan_id", "severity", "section", "severity_findings", F.array_join(line, ";").alias("listed"))


_ALERT_GROUP = "doc_id"


@query("alert_messages", o.on_findings(
    "SELECT doc_id, CASE WHEN count(*) = 1 THEN 'single' ELSE 'batch' END AS kind, CASE WHEN count(*) = 1 THEN "
    "'Secret Audit detected a ' || min(type) || ' with ' || CAST(trunc(min(confidence) * 100) AS INTEGER) || '% confidence' ELSE "
    "'Secret Audit detected ' || count(*) || ' secrets across the repository' END AS text, true AS valid_json, "
    "CASE WHEN count(*) = 1 THEN 5 ELSE 4 END AS blocks FROM findings GROUP BY doc_id"))
def alert_messages(spark, sf):
    messages = reports.alert_messages(findings(spark, sf), "doc_id")
    return messages.select(
        "doc_id", "kind", "text", (F.get_json_object("payload", "$.text") == F.col("text")).alias("valid_json"),
        F.json_array_length(F.get_json_object("payload", "$.blocks")).alias("blocks"))


def _json(kind: str, text: str) -> str:
    return f"json_object('type', '{kind}', 'text', {text})"


def _header(text: str) -> str:
    return f"json_object('type', 'header', 'text', {_json('plain_text', text)})"


def _fields(*pairs: tuple[str, str]) -> str:
    items = ", ".join(_json("mrkdwn", f"'*{label}:*' || chr(10) || {value}") for label, value in pairs)
    return f"json_object('type', 'section', 'fields', json_array({items}))"


def _actions(*buttons: str) -> str:
    return f"json_object('type', 'actions', 'elements', json_array({', '.join(buttons)}))"


_PERCENT = "CAST(trunc(confidence * 100) AS INTEGER)"
_ONE_ALERT = "json_object('blocks', json_array(" + ", ".join([
    _header(f"CASE WHEN {_PERCENT} >= 80 THEN '🔴' WHEN {_PERCENT} >= 50 THEN '🟡' ELSE '🟢' END || ' Secret Audit Secret Detected'"),
    _fields(("Repository", "repo"), ("Confidence", f"{_PERCENT} || '%'"), ("Type", "type"), ("Status", "status")),
    _fields(("Commit", "'`' || substr(commit_sha, 1, 8) || '`'"), ("File", "'`' || file_path || '`'"), ("Lines", "line_start || '-' || line_end"),
            ("Preview", "'`' || masked_preview || '`'")),
    "json_object('type', 'section', 'text', " + _json("mrkdwn", "'*Action Required:* manual' || chr(10) || '*First Seen:* ' || strftime(first_seen_at, '%Y-%m-%d %H:%M:%S')") + ")",
    _actions("json_object('type', 'button', 'text', " + _json("plain_text", "'View Details'") + ", 'url', 'http://localhost:8000/findings/' || id, 'style', 'primary')",
             "json_object('type', 'button', 'text', " + _json("plain_text", "'Acknowledge'") + ", 'value', id, 'action_id', 'acknowledge_finding')"),
]) + f"), 'text', 'Secret Audit detected a ' || type || ' with ' || {_PERCENT} || '% confidence')"
_MANY_ALERTS = "json_object('blocks', json_array(" + ", ".join([
    _header("'🚨 Secret Audit Batch Alert - ' || total || ' Secrets Detected'"),
    _fields(("Total Findings", "total"), ("High Confidence", "high"), ("Medium Confidence", "medium"), ("Low Confidence", "low")),
    "json_object('type', 'section', 'text', " + _json("mrkdwn", "'*Secret Types:* ' || kinds") + ")",
    _actions("json_object('type', 'button', 'text', " + _json("plain_text", "'View All Findings'") + ", 'url', 'http://localhost:8000/findings', 'style', 'primary')"),
]) + "), 'text', 'Secret Audit detected ' || total || ' secrets across the repository')"


@query("alert_payloads", o.on_findings(
    f"SELECT doc_id, CAST({_ONE_ALERT} AS VARCHAR) AS payload FROM findings WHERE doc_id IN (SELECT doc_id FROM findings GROUP BY 1 HAVING count(*) = 1) UNION ALL "
    f"SELECT doc_id, CAST({_MANY_ALERTS} AS VARCHAR) FROM (SELECT doc_id, sum(n) AS total, sum(high) AS high, sum(medium) AS medium, sum(low) AS low, "
    "string_agg(type || ': ' || n, ', ' ORDER BY type) AS kinds FROM (SELECT doc_id, type, count(*) AS n, count(*) FILTER (WHERE confidence >= 0.8) AS high, "
    "count(*) FILTER (WHERE confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (WHERE confidence < 0.5) AS low FROM findings GROUP BY ALL) "
    "GROUP BY doc_id HAVING sum(n) > 1)"))
def alert_payloads(spark, sf):
    """The whole message as it is sent."""
    return reports.alert_messages(findings(spark, sf), "doc_id").select("doc_id", "payload")


@query("remediation_routes", o.on_findings(
    "SELECT id, type, CASE type WHEN 'aws_access_key' THEN 'chat' WHEN 'aws_secret_key' THEN 'aws_remediation' END AS handler FROM findings"))
def remediation_routes(spark, sf):
    extra = spark.createDataFrame([("aws_access_key", "chat", 0)], "type string, handler string, priority int")
    routes = R.default_routes(spark).unionByName(extra)
    return R.route(findings(spark, sf), routes).select("id", "type", "handler")


_PLAN = (
    "CASE type WHEN 'aws_access_key' THEN 'disable' WHEN 'aws_secret_key' THEN 'manual_required' ELSE 'none' END AS action, "
    "CASE type WHEN 'aws_access_key' THEN 'Disable the access key' WHEN 'aws_secret_key' THEN "
    "'Cannot remediate secret key without access key ID' ELSE 'No remediation available for ' || type END AS message"
)


@query("remediation_plan", o.on_findings(
    f"SELECT id, type, {_PLAN}, CASE WHEN type IN ('aws_access_key', 'aws_secret_key') THEN 'RESOLVED' ELSE status END AS status_on_success, "
    "CASE WHEN type IN ('aws_access_key', 'aws_secret_key') THEN 'ACKNOWLEDGED' ELSE status END AS status_on_failure FROM findings"))
def remediation_plan(spark, sf):
    return R.remediation_plan(findings(spark, sf)).select(
        "id", "type", "action", "message", "status_on_success", "status_on_failure")


@query("remediation_notes", o.on_findings(
    "SELECT id, CASE WHEN planned THEN CASE WHEN doc_id % 2 = 0 THEN 'seen' || chr(10) ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN "
    "'Remediation: ' || action || ' - first try' || chr(10) ELSE '' END || 'Remediation: ' || action || ' - ' || message "
    "ELSE CASE WHEN doc_id % 2 = 0 THEN 'seen' ELSE '' END END AS notes, CASE WHEN planned THEN CASE WHEN type = 'aws_access_key' THEN 'RESOLVED' "
    f"ELSE 'ACKNOWLEDGED' END ELSE status END AS status FROM (SELECT *, {_PLAN}, type IN ('aws_access_key', 'aws_secret_key') AS planned FROM findings)"))
def remediation_notes(spark, sf):
    f = stored_findings(spark, sf).withColumn("notes", F.when(F.col("doc_id") % 2 == 0, "seen").otherwise(""))
    results = R.remediation_plan(f).where(F.col("action") != "none").select(
        "id", "action", "message", (F.col("action") == "disable").alias("success"), "doc_id", F.to_timestamp(F.lit("2024-02-02")).alias("ts"))
    # An earlier result of some findings went the other way.
    earlier = results.where(F.col("doc_id") % 3 == 0).withColumns({
        "message": F.lit("first try"), "success": ~F.col("success"), "ts": F.to_timestamp(F.lit("2024-02-01"))})
    return append_notes(f, results.unionByName(earlier)).select("id", "notes", "status")


# --- verdicts --------------------------------------------------------------------------------------------------------

_NUMBERED = (
    "numbered AS (SELECT *, CAST((seq - 1) // 5 AS BIGINT) AS batch_id, CAST((seq - 1) % 5 AS INTEGER) AS position FROM "
    "(SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY id) AS seq FROM raw_findings))"
)


@query("candidate_batches", o.on_findings("SELECT id, scan_id, batch_id, position FROM numbered", _NUMBERED))
def candidate_batches(spark, sf):
    return V.number_batches(stored_raw(spark, sf)).select("id", "scan_id", "batch_id", "position")


@query("batch_prompts", o.on_findings(
    f"SELECT scan_id, batch_id, count(*) AS candidates, {o.lit(V.BATCH_HEAD)} || string_agg('Candidate ' || (position + 1) || ':' || chr(10) || 'File: ' "
    "|| file_path || chr(10) || 'Line: ' || line_start || chr(10) || 'Context: ' || chr(10) || 'Snippet: ' || chr(10) || chr(10), '' ORDER BY position) || "
    f"{o.lit(V.BATCH_TAIL)} AS prompt FROM numbered GROUP BY ALL", _NUMBERED))
def batch_prompts(spark, sf):
    requests = V.batch_requests(V.number_batches(stored_raw(spark, sf)))
    return requests.select("scan_id", "batch_id", "candidates", "prompt")


_SHOWN = (
    "contexts AS (SELECT id, string_agg(printf('%s%4d: %s', CASE WHEN n BETWEEN line_start AND line_end THEN '>>> ' ELSE '    ' END, n, ls[n]), chr(10) "
    "ORDER BY n) AS context FROM (SELECT r.id, r.line_start, r.line_end, string_split(f.content, chr(10)) AS ls, unnest(range(greatest(1, r.line_start - 3), "
    "least(len(string_split(f.content, chr(10))), r.line_end + 3) + 1)) AS n FROM raw_findings r JOIN files f USING (doc_id)) GROUP BY id)",
    f"hidden AS (SELECT r.id, list_reduce(list_prepend(regexp_replace(c.context, {o.re2('|'.join(r.pattern for r in CONTENT_PACK))}, '***', 'g'), "
    "list_filter(string_split(r.secret, chr(10)), lambda s: length(s) > 0)), lambda a, s: replace(a, s, '***')) AS context "
    "FROM raw_findings r JOIN contexts c USING (id))",
)


@query("request_contexts", o.on_findings(
    f"SELECT scan_id, batch_id, {o.lit(V.BATCH_HEAD)} || string_agg('Candidate ' || (position + 1) || ':' || chr(10) || 'File: ' || file_path || chr(10) || "
    "'Line: ' || line_start || chr(10) || 'Context: ' || h.context || chr(10) || 'Snippet: ' || chr(10) || chr(10), '' ORDER BY position) || "
    f"{o.lit(V.BATCH_TAIL)} AS prompt FROM numbered n JOIN hidden h USING (id) GROUP BY ALL", _NUMBERED, *_SHOWN))
def request_contexts(spark, sf):
    """Prompts as they are sent: every candidate with the lines around it, secrets starred out."""
    found = materialize(scan_findings(corpus.files(spark, sf), context=True))
    return V.batch_requests(V.number_batches(found)).select("scan_id", "batch_id", "prompt")


@query("text_prompts",
       f"SELECT conv_id, turn, sha256({o.lit(V.TEXT_HEAD)} || text || {o.lit(V.TEXT_TAIL)}) AS prompt_hash, 2 AS messages FROM conversations")
def text_prompts(spark, sf):
    chat = corpus.table(spark, sf, "conversations")
    conversation = V.messages(V.TEXT_SYSTEM, V.text_prompt(F.col("text")))
    return chat.select("conv_id", "turn", F.sha2(conversation[1]["content"], 256).alias("prompt_hash"),
                       F.size(conversation).alias("messages"))


@query("secret_prompts",
       f"SELECT conv_id, turn, sha256({o.lit(V.SECRET_HEAD)} || 'Text: \"' || text || '\"' || chr(10) || 'File: unknown' || chr(10) || 'Detected as: ' "
       f"|| role || chr(10) || {o.lit(V.SECRET_TAIL)}) AS prompt_hash FROM conversations")
def secret_prompts(spark, sf):
    chat = corpus.table(spark, sf, "conversations")
    prompt = V.secret_prompt(F.col("text"), F.lit(None).cast("string"), F.col("role"))
    return chat.select("conv_id", "turn", F.sha2(prompt, 256).alias("prompt_hash"))


# Stand-in model replies: one JSON text per labelled document; some quote the confidence, some put the object in a list.
_VERDICT_JSON = (
    "CASE WHEN doc_id % 9 = 0 THEN 'not json' WHEN doc_id % 9 = 1 THEN '[1, 2' WHEN doc_id % 9 = 2 THEN '{{\"is_secret\": true}}' ELSE concat(CASE WHEN doc_id % 9 = 4 THEN '[' ELSE '' END, "
    "concat('{{\"is_secret\": ', CASE WHEN quality = 1 THEN 'true' ELSE 'false' END, ', \"is_vulnerability\": ', CASE WHEN toxic = 1 THEN 'true' "
    "ELSE 'false' END, ', \"type\": \"api_key\", \"severity\": \"', CASE WHEN toxic = 1 THEN 'CRITICAL' ELSE 'MEDIUM' END, "
    "'\", \"confidence\": ', CASE WHEN doc_id % 9 = 3 THEN '\"0.3\"' ELSE concat('0.', cast(doc_id % 9 as varchar(9))) END, ', \"remediation\": \"rotate\", \"reasoning\": \"doc ', cast(doc_id as varchar(20)), '\"}}'), CASE WHEN doc_id % 9 = 4 THEN ']' ELSE '' END) END"
).format()
_READ = {
    "is_secret": ("CASE WHEN doc_id % 9 < 2 THEN {f} WHEN doc_id % 9 = 2 THEN true ELSE quality = 1 END", "false"),
    "is_vulnerability": ("CASE WHEN doc_id % 9 < 2 THEN {f} WHEN doc_id % 9 = 2 THEN false ELSE toxic = 1 END", "false"),
    "type": ("CASE WHEN doc_id % 9 < 2 THEN {f} WHEN doc_id % 9 = 2 THEN 'unknown' ELSE 'api_key' END", "'unknown'"),
    "severity": ("CASE WHEN doc_id % 9 < 2 THEN {f} WHEN doc_id % 9 = 2 THEN 'LOW' WHEN toxic = 1 THEN 'CRITICAL' ELSE 'MEDIUM' END", "'LOW'"),
    "confidence": ("CASE WHEN doc_id % 9 < 2 THEN {f} WHEN doc_id % 9 = 2 THEN 0.5 ELSE (doc_id % 9) / 10.0 END", "0.1"),
    "remediation": ("CASE WHEN doc_id % 9 < 2 THEN {f} WHEN doc_id % 9 = 2 THEN 'Review and secure this item' ELSE 'rotate' END",
                    "'Manual review recommended'"),
    "reasoning": ("CASE WHEN doc_id % 9 < 2 THEN {f} WHEN doc_id % 9 = 2 THEN 'No reasoning provided' ELSE concat('doc ', doc_id) END",
                  "'MCP classification failed, manual review required'"),
}


def _verdict_fields(missing: str = "NULL", prefix: str = "") -> str:
    return ", ".join(f"{sql.format(f=missing)} AS {prefix}{name}" for name, (sql, _) in _READ.items())


@query("verdict_parse", f"SELECT doc_id, {_verdict_fields()} FROM labels")
def verdict_parse(spark, sf):
    labels = corpus.table(spark, sf, "labels").selectExpr("doc_id", f"{_VERDICT_JSON} AS json")
    return labels.select("doc_id", V.parse_verdict(F.col("json")).alias("v")).select("doc_id", "v.*")


@query("verdict_reply_split",
       "SELECT doc_id, CAST(p AS INTEGER) AS position, CASE WHEN doc_id % 3 = 2 AND p = 1 THEN 'text reply' ELSE concat('{\"type\":\"t', doc_id, '\"}') END AS json "
       "FROM (SELECT doc_id, unnest(range(2)) AS p FROM labels WHERE doc_id % 3 <> 1)")
def verdict_reply_split(spark, sf):
    one = F.concat(F.lit('{"type":"t'), F.col("doc_id").cast("string"), F.lit('"}'))
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"choices": ['), one, F.lit(", "), one, F.lit("]}"))).when(
        F.col("doc_id") % 3 == 1, "busy").otherwise(F.concat(F.lit("["), one, F.lit(', "text reply"]')))
    replies = corpus.table(spark, sf, "labels").select("doc_id", F.lit(0).alias("batch_id"), reply.alias("reply"))
    return V.reply_verdicts(replies, "doc_id").select("doc_id", "position", "json")


def _judged(spark, sf):
    """Each candidate's verdict is the one of its document; documents without a label have none."""
    raw = stored_raw(spark, sf)
    numbered = V.number_batches(raw)
    labels = corpus.table(spark, sf, "labels").selectExpr("doc_id", f"{_VERDICT_JSON} AS json")
    texts = numbered.select("scan_id", "batch_id", "position", "doc_id").join(labels, "doc_id")
    return raw, numbered, texts.select("scan_id", "batch_id", "position", "json")


_JUDGED = (
    _NUMBERED,
    "judged AS MATERIALIZED (SELECT n.*, " + ", ".join(
        "CASE WHEN l.doc_id IS NULL THEN {f} ELSE {sql} END AS v_{name}".format(f=fallback, name=name, sql=sql.format(f=fallback).replace("doc_id", "n.doc_id"))
        for name, (sql, fallback) in _READ.items()) + " FROM numbered n LEFT JOIN labels l ON l.doc_id = n.doc_id)",
)


@query("verdict_alignment", o.on_findings(
    "SELECT id, batch_id, position, v_is_secret AS is_secret, v_severity AS severity, CAST(v_confidence AS DOUBLE) AS confidence, "
    "v_remediation AS remediation, v_reasoning AS reasoning FROM judged", *_JUDGED))
def verdict_alignment(spark, sf):
    _, numbered, texts = _judged(spark, sf)
    v = F.col("verdict")
    return V.align_verdicts(numbered, texts).select(
        "id", "batch_id", "position", v["is_secret"].alias("is_secret"), v["severity"].alias("severity"),
        v["confidence"].alias("confidence"), v["remediation"].alias("remediation"), v["reasoning"].alias("reasoning"))


@query("verdict_apply", o.on_findings(
    "SELECT id, type, v_severity AS severity, CAST(v_confidence AS DOUBLE) AS confidence, description || ' (MCP verified)' AS description, "
    "v_remediation AS remediation, 'mcp' AS engine FROM judged WHERE v_is_secret OR v_is_vulnerability", *_JUDGED))
def verdict_apply(spark, sf):
    _, numbered, texts = _judged(spark, sf)
    return V.apply_verdicts(V.align_verdicts(numbered, texts)).select(
        "id", "type", "severity", "confidence", "description", "remediation", "engine")


@query("merged_with_verdicts", o.on_findings(
    "SELECT scan_id, file_path, line_start, type, severity, confidence, engine FROM (SELECT scan_id, file_path, line_start, type, rule_ord, match_ord, "
    "0 AS rank, v_severity AS severity, CAST(v_confidence AS DOUBLE) AS confidence, 'mcp' AS engine FROM judged WHERE v_is_secret OR v_is_vulnerability "
    "UNION ALL SELECT scan_id, file_path, line_start, type, rule_ord, match_ord, 1, severity, confidence, 'regex' FROM raw_findings) "
    "QUALIFY row_number() OVER (PARTITION BY scan_id, file_path, line_start, type ORDER BY rank, rule_ord, match_ord) = 1", *_JUDGED))
def merged_with_verdicts(spark, sf):
    # The verdicts carry the findings' ids, as replies to stored requests do.
    raw = stored_raw(spark, sf)
    labels = corpus.table(spark, sf, "labels").selectExpr("doc_id", f"{_VERDICT_JSON} AS json")
    return merged_findings(raw, raw.select("id", "doc_id").join(labels, "doc_id").select("id", "json")).select(
        "scan_id", "file_path", "line_start", "type", "severity", "confidence", "engine")
