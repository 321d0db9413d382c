"""Sources, sinks and file selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from secret_audit.checks import corpus, oracle as o
from secret_audit.checks.registry import query
from secret_audit.functions import text as T
from secret_audit.operators import select as S
from secret_audit.rules import PACKS
from secret_audit.session import shared_dir
from secret_audit.sources import store
from secret_audit.sources.commits import file_versions, newest_commits
from secret_audit.sources.files import files_from_text, read_files

_FILE_COLS = "repo, commit_sha, file_path, size, sha256(content) AS content_hash"


def _shown(df):
    return df.select("repo", "commit_sha", "file_path", "size", F.sha2("content", 256).alias("content_hash"))


@query("files_source", o.with_(o.FILES, select=f"SELECT {_FILE_COLS} FROM files"))
def files_source(spark, sf):
    path = shared_dir(spark, "files")
    corpus.files(spark, sf).drop("doc_id").write.parquet(path)
    return _shown(read_files(spark, path))


@query("text_table_as_files",
       "SELECT lang AS repo, concat('doc/', doc_id) AS file_path, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def text_table_as_files(spark, sf):
    docs = corpus.table(spark, sf, "documents")
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return files_from_text(docs, "text", "lang", path).select("repo", "file_path", "size")


@query("lossy_decode", "SELECT doc_id, sha256(replace(text, chr(65533), '')) AS text_hash FROM documents")
def lossy_decode(spark, sf):
    # A stray byte is put before and after each text and has to disappear again.
    raw = F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))
    docs = corpus.table(spark, sf, "documents")
    return docs.select("doc_id", F.sha2(T.decode_ignore(raw), 256).alias("text_hash"))


def _with_bad_bytes(spark, sf):
    docs = corpus.table(spark, sf, "documents")
    bad = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))
    raw = F.when(F.col("doc_id") % 5 == 0, bad).when(F.col("doc_id") % 11 != 3, F.encode("text", "UTF-8"))
    return docs.select("doc_id", raw.alias("raw"))


@query("strict_decode",
       "SELECT doc_id, sha256(text) AS text_hash FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 11 <> 3")
def strict_decode(spark, sf):
    good, _ = S.split_rejects(_with_bad_bytes(spark, sf))
    return good.select("doc_id", F.sha2("content", 256).alias("text_hash"))


@query("rejected_files",
       "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'invalid_utf8' ELSE 'missing_content' END AS reason "
       "FROM documents WHERE doc_id % 5 = 0 OR doc_id % 11 = 3")
def rejected_files(spark, sf):
    _, bad = S.split_rejects(_with_bad_bytes(spark, sf))
    return bad.select("doc_id", "reason")


@query("base64_decode",
       "SELECT doc_id, sha256(decode(from_base64(to_base64(encode(text))))) AS text_hash FROM documents")
def base64_decode(spark, sf):
    docs = corpus.table(spark, sf, "documents")
    blob = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "(.{60})", "$1\n")
    return docs.select("doc_id", F.sha2(T.decode_base64(blob), 256).alias("text_hash"))


_COMMITS_CTE = (
    o.FILES,
    "commits AS (SELECT repo, commit_sha AS sha, timestamp '2024-01-01' + to_minutes(doc_id * 7) AS date, doc_id, "
    "file_path, content FROM files WHERE doc_id * 7 >= 1000)",
    "newest AS (SELECT * FROM commits QUALIFY row_number() OVER (PARTITION BY repo ORDER BY date DESC, sha DESC) <= 10)",
)
_ALL_COMMITS = tuple(c.replace(" WHERE doc_id * 7 >= 1000)", ")") for c in _COMMITS_CTE)


def _commits(spark, sf):
    change = F.struct(
        "file_path", F.when(F.col("doc_id") % 6 == 0, "removed").otherwise("modified").alias("status"),
        F.lit(None).cast("string").alias("patch"), "content",
    )
    extra = F.struct(
        F.concat(F.lit("empty/"), F.col("doc_id").cast("string")).alias("file_path"), F.lit("added").alias("status"),
        F.lit(None).cast("string").alias("patch"), F.lit("").alias("content"),
    )
    return corpus.files(spark, sf).select(
        "repo", F.col("commit_sha").alias("sha"), F.lit("msg").alias("message"), F.lit("dev").alias("author"),
        F.expr("timestampadd(MINUTE, doc_id * 7, timestamp '2024-01-01 00:00:00')").alias("date"),
        F.array(change, extra).alias("files"),
    )


@query("newest_commits", o.with_(*_COMMITS_CTE, select="SELECT repo, sha, date FROM newest"))
def newest_commits_query(spark, sf):
    return newest_commits(_commits(spark, sf), 10, "2024-01-01 16:40:00").select("repo", "sha", "date")


@query("commit_file_versions", o.with_(
    *_COMMITS_CTE,
    select="SELECT repo, sha AS commit_sha, file_path, CAST(strlen(content) AS BIGINT) AS size, 'modified' AS file_status "
           "FROM newest WHERE doc_id % 6 <> 0 AND NOT regexp_matches(lower(file_path), '[.]png$')"))
def commit_file_versions(spark, sf):
    versions = file_versions(newest_commits(_commits(spark, sf), 10, "2024-01-01 16:40:00"))
    return versions.select("repo", "commit_sha", "file_path", "size", F.col("metadata")["file_status"].alias("file_status"))


@query("commit_contents_join", o.with_(
    *_ALL_COMMITS,
    select="SELECT repo, sha AS commit_sha, file_path, sha256(content) AS content_hash FROM commits "
           "WHERE doc_id % 6 <> 0 AND NOT regexp_matches(lower(file_path), '[.]png$')"))
def commit_contents_join(spark, sf):
    commits = _commits(spark, sf)
    bare = commits.withColumn("files", F.transform("files", lambda f: f.withField("content", F.lit(None).cast("string"))))
    contents = corpus.files(spark, sf).select(F.col("commit_sha").alias("sha"), "file_path", "content")
    return file_versions(bare, contents).select(
        "repo", "commit_sha", "file_path", F.sha2("content", 256).alias("content_hash"))


_INCLUDED = "(regexp_matches(file_path, '^(?:[^/]+/)*[^/]*[.]py$') OR regexp_matches(file_path, '^(?:[^/]+/)*[^/]*[.]js$') " \
            "OR regexp_matches(file_path, '^(?:[^/]+/)*[^/]*[.]env$') OR regexp_matches(file_path, '^(?:[^/]+/)*[^/]*[.]yml$'))"


@query("include_globs", o.with_(o.FILES, select=f"SELECT file_path FROM files WHERE {_INCLUDED}"))
def include_globs(spark, sf):
    files = corpus.files(spark, sf).select("file_path")
    return files.where(S.included(F.col("file_path")))


@query("exclude_globs", o.with_(
    o.FILES, select="SELECT file_path FROM files WHERE NOT regexp_matches(file_path, '(?s)^(.*/node_modules/.*|.*/dist/.*|[.]git/.*)$')"))
def exclude_globs(spark, sf):
    files = corpus.files(spark, sf).select("file_path")
    return files.where(~S.excluded(F.col("file_path")))


@query("exclude_globs_top_level", o.with_(
    o.FILES, select="SELECT file_path FROM files WHERE NOT regexp_matches(file_path, '(^|/)(node_modules|dist)/')"))
def exclude_globs_top_level(spark, sf):
    files = corpus.files(spark, sf).select("file_path")
    return files.where(~S.excluded(F.col("file_path"), strict=False))


@query("max_file_size", o.with_(o.FILES, select="SELECT file_path, size FROM files WHERE size <= 3000"))
def max_file_size(spark, sf):
    return corpus.files(spark, sf).where(F.col("size") <= 3000).select("file_path", "size")


@query("max_files", o.with_(
    o.FILES, select="SELECT repo, file_path FROM files QUALIFY row_number() OVER (PARTITION BY repo ORDER BY file_path) <= 20"))
def max_files(spark, sf):
    return S.limit_files(corpus.files(spark, sf), 20).select("repo", "file_path")


@query("select_files", o.with_(
    o.FILES,
    select=f"SELECT repo, file_path, size FROM files WHERE {_INCLUDED} AND NOT regexp_matches(file_path, "
           "'(?s)^(.*/node_modules/.*|.*/dist/.*|[.]git/.*)$') AND size <= 20000 "
           "QUALIFY row_number() OVER (PARTITION BY repo ORDER BY file_path) <= 8"))
def select_files(spark, sf):
    return S.select_files(corpus.files(spark, sf), max_files=8, max_bytes_per_file=20000).select(
        "repo", "file_path", "size")


@query("file_counters", o.with_(
    o.FILES,
    select=f"SELECT repo, count(*) AS total_files, count(*) FILTER (WHERE ok) AS scanned_files, "
           f"count(*) FILTER (WHERE NOT ok) AS skipped_files FROM (SELECT repo, {_INCLUDED} AND NOT "
           "regexp_matches(file_path, '(?s)^(.*/node_modules/.*|.*/dist/.*|[.]git/.*)$') AND size <= 20000 AS ok FROM files) GROUP BY repo"))
def file_counters(spark, sf):
    from secret_audit.operators.metrics import file_counters as counters

    return counters(S.selection_flags(corpus.files(spark, sf), max_bytes_per_file=20000))


_OUT = "regexp_matches(file_path, '(?s)^(.*/node_modules/.*|.*/dist/.*|[.]git/.*)$')"


@query("selection_rejects", o.with_(
    o.FILES,
    "asked AS (SELECT doc_id, file_path, CASE WHEN doc_id % 17 <> 0 THEN repo END AS repo, octet_length(encode(content)) AS bytes FROM files)",
    f"first AS (SELECT *, CASE WHEN NOT {_INCLUDED} THEN 'not_included' WHEN {_OUT} THEN 'excluded' "
    "WHEN bytes > 20000 THEN 'too_large' END AS why FROM asked)",
    select="SELECT doc_id, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY repo, why IS NULL ORDER BY file_path) > 8 THEN 'over_limit' "
           "ELSE coalesce(why, 'selected') END AS reason FROM first"))
def selection_rejects(spark, sf):
    # Some repositories and sizes are unknown; selected and rejected files together are all files.
    files = corpus.files(spark, sf).withColumns({
        "repo": F.when(F.col("doc_id") % 17 != 0, F.col("repo")), "size": F.when(F.col("doc_id") % 13 != 0, F.col("size"))})
    request = {"max_files": 8, "max_bytes_per_file": 20000}
    kept = S.select_files(files, **request).select("doc_id", F.lit("selected").alias("reason"))
    return kept.unionByName(S.selection_rejects(files, **request).select("doc_id", "reason"))


@query("scan_history", o.on_findings(
    "SELECT concat('scan-', s.source, '-000000000', s.v) AS id, s.source AS repo_url, 'done' AS status, s.n AS total_files, "
    "coalesce(f.n, 0) AS findings_count FROM (SELECT source, unnest([1, 2]) AS v, count(*) AS n FROM documents GROUP BY source) s LEFT JOIN "
    "(SELECT repo, v, count(*) AS n FROM (SELECT *, unnest([1, 2]) AS v FROM findings) WHERE v = 1 OR doc_id % 2 = 0 GROUP BY ALL) f "
    "ON f.repo = s.source AND f.v = s.v"))
def scan_history_query(spark, sf):
    from secret_audit.plans.jobs import ScanRequest, run_repo_scan, scan_history

    base = shared_dir(spark, "scans")
    files = corpus.files(spark, sf)
    everything = ScanRequest(include=("**/*",), exclude=())
    run_repo_scan(files, base, 1, everything)
    # Half of the files have lost their secrets by the second run.
    later = files.withColumn("content", F.when(F.col("doc_id") % 2 == 0, F.col("content")).otherwise("clean"))
    run_repo_scan(later, base, 2, everything)
    return scan_history(spark, base).select("id", "repo_url", "status", "total_files", "findings_count")


@query("binary_extensions", o.with_(
    o.FILES, select="SELECT file_path FROM files WHERE NOT regexp_matches(lower(file_path), '[.](png|jpg|pdf|zip|exe)$')"))
def binary_extensions(spark, sf):
    files = corpus.files(spark, sf).select("file_path")
    return files.where(~S.is_binary_path(F.col("file_path")))


@query("pruned_paths", o.with_(
    o.FILES,
    select="SELECT file_path FROM files WHERE NOT regexp_matches(file_path, '(^|/)(node_modules|dist|build|env|[.]git)/') "
           "AND NOT regexp_matches(lower(file_path), '[.](png|svg|gz)$')"))
def pruned_paths(spark, sf):
    files = corpus.files(spark, sf).select("file_path")
    return files.where(~S.is_pruned_path(F.col("file_path")))


@query("removed_and_empty_files",
       "SELECT doc_id FROM documents WHERE doc_id % 6 <> 0 AND doc_id % 7 NOT IN (1, 2)")
def removed_and_empty_files(spark, sf):
    docs = corpus.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 6 == 0, "removed").when(F.col("doc_id") % 6 == 1, "added").alias("status"),
        F.when(F.col("doc_id") % 7 == 1, "").when(F.col("doc_id") % 7 != 2, F.col("text")).alias("content"),
    )
    return docs.where(~S.is_removed(F.col("status")) & S.has_content(F.col("content"))).select("doc_id")


@query("repo_urls",
       "SELECT page_id, url, regexp_matches(gh, '^https://github[.]com/[^/]+/[^/]+/?$') AS is_repo, "
       "CASE WHEN contains(gh, 'github.com/') THEN rtrim(string_split(gh, 'github.com/')[2], '/') END AS repo_name FROM "
       "(SELECT *, CASE WHEN page_id % 3 = 0 THEN 'https://github.com/org' || page_id || '/app/' "
       "WHEN page_id % 3 = 1 THEN 'http://github.com/' || split_part(url, '/', 4) ELSE url END AS gh FROM pages)")
def repo_urls(spark, sf):
    pages = corpus.table(spark, sf, "pages")
    gh = F.expr(
        "CASE WHEN page_id % 3 = 0 THEN 'https://github.com/org' || page_id || '/app/' "
        "WHEN page_id % 3 = 1 THEN 'http://github.com/' || split_part(url, '/', 4) ELSE url END")
    return pages.select("page_id", "url", gh.alias("gh")).select(
        "page_id", "url", T.is_repo_url(F.col("gh")).alias("is_repo"), T.repo_name(F.col("gh")).alias("repo_name"))


_DOC_COLS = "id, scan_id, file_path, type, line_start, fingerprint"


def _findings(spark, sf):
    from secret_audit.checks.queries_findings import stored_findings

    return stored_findings(spark, sf)


@query("finding_documents_roundtrip", o.on_findings(
    f"SELECT {_DOC_COLS}, confidence, created_at FROM findings"))
def finding_documents_roundtrip(spark, sf):
    path = shared_dir(spark, "documents")
    store.write_finding_documents(
        store.finding_rows(_findings(spark, sf)), path, "2024-02-01 00:00:00", target=10)
    back = store.read_finding_documents(spark, path)
    return back.select(*_DOC_COLS.split(", "), "confidence", "created_at")


@query("finding_document_counts", o.on_findings(
    "SELECT scan_id, count(*) AS listed, count(*) AS stated FROM findings GROUP BY scan_id"))
def finding_document_counts(spark, sf):
    docs = store.finding_documents(store.finding_rows(_findings(spark, sf)), "2024-02-01 00:00:00", target=10)
    return docs.groupBy("scan_id").agg(
        F.sum(F.size("findings")).alias("listed"), F.max("count").alias("stated"))


@query("scan_metadata_roundtrip", o.with_(
    o.SCANS, select="SELECT id, repo_url, status, risk_score, started_at, timestamp '2024-03-02' AS stored_at FROM scans"))
def scan_metadata_roundtrip(spark, sf):
    path = shared_dir(spark, "metadata")
    scans = corpus.scans(spark, sf)
    store.write_scan_metadata(scans.withColumn("risk_score", F.lit(0.0)), path, "2024-03-01 00:00:00")
    store.write_scan_metadata(scans, path, "2024-03-02 00:00:00")
    return store.read_scan_metadata(spark, path).select(
        "id", "repo_url", "status", "risk_score", "started_at", "stored_at")


@query("findings_append", o.on_findings(
    "SELECT id, CASE WHEN doc_id % 2 = 0 THEN 'unknown' ELSE repo END AS repo, "
    "CASE WHEN doc_id % 3 = 0 THEN '' ELSE remediation END AS remediation, CAST(created_at AS DATE) AS day FROM findings"))
def findings_append(spark, sf):
    path = shared_dir(spark, "findings")
    f = _findings(spark, sf)
    f = f.withColumn("repo", F.when(F.col("doc_id") % 2 != 0, F.col("repo"))).withColumn(
        "remediation", F.when(F.col("doc_id") % 3 != 0, F.col("remediation")))
    store.append_findings(f, path)
    return store.read_findings(spark, path).select("id", "repo", "remediation", "day")


@query("scan_run_log", o.with_(
    o.SCANS,
    select="SELECT id, regexp_extract(repo_url, 'r[0-9]$') AS repo, CASE WHEN status = 'error' THEN 'ERROR' ELSE 'OK' END AS status, "
           "started_at, finished_at AS ended_at, total_files AS new_findings_count FROM scans"))
def scan_run_log(spark, sf):
    path = shared_dir(spark, "runs")
    scans = corpus.scans(spark, sf)
    repo = F.regexp_extract("repo_url", "r[0-9]$", 0)
    null = F.lit(None)
    opened = scans.select(
        "id", repo.alias("repo"), F.lit("OK").alias("status"), null.cast("string").alias("commit_range"), "started_at",
        null.cast("timestamp").alias("ended_at"), null.cast("long").alias("new_findings_count"),
        F.col("started_at").alias("event_time"))
    closed = scans.select(
        "id", null.cast("string").alias("repo"), F.when(F.col("status") == "error", "ERROR").otherwise("OK").alias("status"),
        null.cast("string").alias("commit_range"), null.cast("timestamp").alias("started_at"),
        F.col("finished_at").alias("ended_at"), F.col("total_files").alias("new_findings_count"),
        F.expr("timestampadd(MICROSECOND, 1, finished_at)").alias("event_time"))
    store.append_runs(opened, path)
    store.append_runs(closed, path)
    from secret_audit.schemas import SCAN_RUNS

    return store.current_runs(spark.read.schema(SCAN_RUNS).parquet(path)).select(
        "id", "repo", "status", "started_at", "ended_at", "new_findings_count")


def _pack_values() -> str:
    rows = []
    for pack, rules in PACKS.items():
        for i, r in enumerate(rules):
            rows.append(f"({o.lit(pack)}, {i}, {o.lit(r.name)}, {o.lit(r.kind)}, {o.lit(r.severity)}, CAST({r.confidence} AS DOUBLE))")
    return "rules(pack, ord, name, kind, severity, confidence) AS (VALUES " + ", ".join(rows) + ")"


@query("rule_hit_counts", o.with_(
    o.FILES, o.content_hits(),
    select="SELECT r.rule, count(DISTINCT doc_id) AS texts, count(h.doc_id) AS matches FROM (VALUES "
           + ", ".join(f"({o.lit(r.name)})" for r in PACKS["content"]) + ") r(rule) LEFT JOIN hits h USING (rule) GROUP BY r.rule"))
def rule_hit_counts(spark, sf):
    from secret_audit.operators.detect import rule_hit_counts as counts

    return counts(corpus.files(spark, sf))


@query("rule_pack_use", o.with_(
    o.FILES, o.content_hits(), _pack_values(),
    select="SELECT pack, ord, name, kind, r.severity, r.confidence, count(h.doc_id) AS matches FROM rules r "
           "LEFT JOIN hits h ON h.rule = r.name WHERE pack = 'content' GROUP BY ALL"))
def rule_pack_use(spark, sf):
    from secret_audit.operators.detect import scan_content
    from secret_audit.rules import rules_table

    found = scan_content(corpus.files(spark, sf)).groupBy("rule").agg(F.count("*").alias("n"))
    rules = rules_table(spark, {"content": PACKS["content"]})
    return rules.join(found, rules["name"] == found["rule"], "left").select(
        "pack", "ord", "name", "kind", "severity", "confidence", F.coalesce("n", F.lit(0)).alias("matches"))


@query("user_rule_pack", o.with_(o.FILES, o.content_hits(), select="SELECT file_path, rule, match_ord, line_start, line_end FROM hits"))
def user_rule_pack(spark, sf):
    from secret_audit.operators.detect import scan_content
    from secret_audit.rules import read_rules, rules_table

    path = shared_dir(spark, "rules")
    rules_table(spark, {"content": PACKS["content"]}).coalesce(1).write.json(path)
    found = scan_content(corpus.files(spark, sf), read_rules(spark, path))
    return found.select("file_path", "rule", "match_ord", "line_start", "line_end")


@query("tree_contents",
       "SELECT source AS repo, concat(CASE WHEN doc_id % 3 = 0 THEN '.d/.f' ELSE 'd/f' END, doc_id) AS file_path, "
       "CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS content_hash FROM documents")
def tree_contents(spark, sf):
    """The documents written as files, hidden ones among them, and read back as repository trees."""
    from secret_audit.sources.tree import read_tree, write_tree

    root = shared_dir(spark, "tree")
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, ".d/.f").otherwise("d/f"), F.col("doc_id").cast("string"))
    docs = corpus.table(spark, sf, "documents").select(F.concat_ws("/", "source", name).alias("path"), F.encode("text", "UTF-8").alias("raw"))
    write_tree(docs, root)
    return read_tree(spark, root).select("repo", "file_path", "size", F.sha2("content", 256).alias("content_hash"))


@query("registered_connector_and_handler", o.on_findings(
    "SELECT id, CASE type WHEN 'aws_access_key' THEN 'disable' WHEN 'aws_secret_key' THEN 'manual_required' ELSE 'none' END AS action FROM findings"))
def registered_connector_and_handler(spark, sf):
    from secret_audit.plans.repo_scan import merged_findings, scan_findings
    from secret_audit.plugins import registry

    path = shared_dir(spark, "files")
    corpus.files(spark, sf).drop("doc_id").write.parquet(path)
    files = registry.get("connector", "files")(spark, path)
    found = merged_findings(scan_findings(files)).withColumn("status", F.lit("NEW"))
    return registry.get("handler", "aws_remediation")(found).select("id", "action")
