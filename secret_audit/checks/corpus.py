"""Stand-in inputs made from the given tables, as SQL that Spark and DuckDB both run.

``documents`` becomes the files table: each text gets lines with made-up secrets by its id. ``events`` becomes
sightings, scans, runs and updates. No row is added or left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


Q = "chr(39)"
NL = "chr(10)"

# (condition, text). {H} is the hex digest of the id, {B} its base64 form, {G} a digest shared by a group of ids.
PLANTS = (
    ("doc_id % 7 = 0", "'k = \"AKIA' || upper(substr({H}, 1, 16)) || '\"'"),
    ("doc_id % 7 = 1", f"'aws_secret_access_key = ' || {Q} || substr({{B}}, 1, 40) || {Q}"),
    ("doc_id % 11 = 2", "'google: AIza' || substr({H}, 1, 35)"),
    ("doc_id % 11 = 3", "'slack xoxb-' || substr({H}, 1, 24)"),
    ("doc_id % 9 = 4", "'# token = \"ghp_' || substr({H}, 1, 36) || '\"'"),
    ("doc_id % 13 = 5", "'-----BEGIN RSA PRIVATE KEY-----'"),
    ("doc_id % 13 = 6", "'-----begin EC private key-----'"),
    ("doc_id % 5 = 0", "'password = \"pw-' || substr({H}, 1, 12) || '\"'"),
    ("doc_id % 10 = 1", f"'Password:' || {NL} || '\"multi' || {NL} || 'line' || substr({{H}}, 1, 6) || '\" tail'"),
    ("doc_id % 17 = 1", "'sk_live_' || substr({H}, 1, 24)"),
    ("doc_id % 6 = 2", "'digest = ' || substr({H}, 1, 32)"),
    ("doc_id % 14 = 3", "'jwt_secret: \"' || substr({H}, 1, 32) || '\"'"),
    ("doc_id % 8 = 1", "'{{\"type\": \"service_account\"}}'"),
    ("doc_id % 8 = 2", "'url https://hooks.slack.com/services/T' || substr({H}, 1, 8) || '/B' || substr({H}, 9, 8)"),
    ("doc_id % 8 = 3", "'Authorization: Bearer ' || {B}"),
    ("doc_id % 8 = 4", "'eyJ' || substr({H}, 1, 20) || '.' || substr({H}, 5, 20) || '.' || substr({H}, 9, 20)"),
    ("doc_id % 8 = 5", "'DB=postgres://user:p' || substr({H}, 1, 6) || '@db' || cast(doc_id % 10 as varchar(9)) || '.internal/app'"),
    ("doc_id % 8 = 6", "'mysql://root:p@ss' || substr({H}, 1, 6) || '@10.0.0.1:3306/shop?x=1'"),
    ("doc_id % 8 = 7", "'mongodb+srv://svc:p' || substr({H}, 1, 6) || '@cluster0/test'"),
    ("doc_id % 4 = 0", "'const apiToken = \"' || {B} || '\"'"),
    ("doc_id % 12 = 1", "'export API_TOKEN=' || {B}"),
    ("doc_id % 12 = 5", "'// example: your_key ' || {B}"),
    ("doc_id % 12 = 7", "'  \"api_key\": \"' || substr({H}, 1, 24) || '\", os.environ.get'"),
    ("doc_id % 3 = 0", "'shared = \"AKIA' || upper(substr({G}, 1, 16)) || '\"'"),
    ("doc_id % 21 = 4", "'two AKIA' || upper(substr({H}, 1, 16)) || ' akia' || substr({H}, 17, 16) || ' end'"),
)

PATHS = (
    "'config/app' || {I} || '.yml'",
    "'src/m' || {I} || '.py'",
    "'pkg/tests/t' || {I} || '.py'",
    "'docs/readme' || {I} || '.md'",
    "'svc' || {I} || '/.env'",
    "'node_modules/a' || {I} || '.js'",
    "'x/node_modules/b' || {I} || '.js'",
    "'img/l' || {I} || '.PNG'",
    "'lib/' || {I} || '/Settings.java'",
    "'web/dist/c' || {I} || '.js'",
    "'examples/demo' || {I} || '.go'",
)


def _digests(dialect: str) -> dict[str, str]:
    if dialect == "spark":
        return {
            "H": "sha2(cast(doc_id as string), 256)",
            "B": "base64(unhex(sha2(cast(doc_id as string), 256)))",
            "G": "sha2(cast(doc_id % 20 as string), 256)",
            "I": "cast(doc_id as string)",
        }
    return {
        "H": "sha256(cast(doc_id as varchar))",
        "B": "to_base64(unhex(sha256(cast(doc_id as varchar))))",
        "G": "sha256(cast(doc_id % 20 as varchar))",
        "I": "cast(doc_id as varchar)",
    }


def content_sql(dialect: str) -> str:
    d = _digests(dialect)
    parts = [f"CASE WHEN {cond} THEN {NL} || {text.format(**d)} ELSE '' END" for cond, text in PLANTS]
    return "text || " + " || ".join(parts) + f" || {NL}"


def path_sql(dialect: str) -> str:
    d = _digests(dialect)
    whens = " ".join(f"WHEN {i} THEN {p.format(**d)}" for i, p in enumerate(PATHS))
    return f"CASE doc_id % {len(PATHS)} {whens} END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plant(documents: DataFrame) -> DataFrame:
    """The files table of a documents table, batch or stream."""
    d = _digests("spark")
    return (
        documents.selectExpr(
            "doc_id", "source AS repo", f"substr({d['H']}, 1, 40) AS commit_sha",
            f"{path_sql('spark')} AS file_path", f"{content_sql('spark')} AS content",
        )
        .withColumn("size", F.octet_length("content").cast("long"))
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The planted secrets make the scan cost far more than moving the text of these few files.
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return plant(documents.repartition(spark.sparkContext.defaultParallelism, "doc_id"))


def files_cte() -> str:
    d = _digests("duckdb")
    return (
        f"files AS MATERIALIZED (SELECT *, CAST(strlen(content) AS BIGINT) AS size FROM (SELECT doc_id, source AS repo, "
        f"substr({d['H']}, 1, 40) AS commit_sha, {path_sql('duckdb')} AS file_path, {content_sql('duckdb')} AS content "
        "FROM documents))"
    )


# Columns shared by both dialects.
_SIGHTING = {
    "repo": "concat('r', cast(user_id % 7 as varchar(9)))",
    "file_path": "concat('src/f', cast(event_id % 3 as varchar(9)), '.py')",
    "type": "CASE event_type WHEN 'click' THEN 'aws_access_key' WHEN 'view' THEN 'aws_secret_key' "
            "WHEN 'error' THEN 'github_token' WHEN 'signup' THEN 'slack_token' ELSE 'password' END",
    "severity": "CASE WHEN event_type = 'view' THEN 'CRITICAL' WHEN event_type = 'purchase' THEN 'MEDIUM' "
                "WHEN event_type = 'signup' THEN 'LOW' ELSE 'HIGH' END",
    "confidence": "CAST((event_id % 10) AS DOUBLE) / 10",
    "status": "CASE WHEN event_type = 'click' THEN 'ACKNOWLEDGED' WHEN event_type = 'view' THEN 'RESOLVED' "
              "WHEN event_type = 'error' THEN 'FALSE_POSITIVE' WHEN event_type = 'signup' THEN 'BOGUS' ELSE 'NEW' END",
}


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding sighting per event."""
    cols = [f"{sql} AS {name}" for name, sql in _SIGHTING.items()]
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "sha2(cast(user_id as string), 256) AS fingerprint", "cast(ts as timestamp) AS seen_at",
        "sha2(cast(event_id as string), 256) AS commit_sha", *cols,
    )


def sightings_cte() -> str:
    cols = ", ".join(f"{sql} AS {name}" for name, sql in _SIGHTING.items())
    return (
        "sightings AS (SELECT event_id, user_id, sha256(cast(user_id as varchar)) AS fingerprint, ts AS seen_at, "
        f"sha256(cast(event_id as varchar)) AS commit_sha, {cols} FROM events)"
    )


_SCAN = {
    "repo_url": "concat('https://github.com/acme/r', cast(user_id % 7 as varchar(9)))",
    "branch": "'main'",
    "status": "CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'error' THEN 'error' ELSE 'done' END",
    "total_files": "event_id % 9",
    "scanned_files": "(event_id % 9) * (event_id % 4) / 3",
    "risk_score": "value",
}


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan per event."""
    cols = [f"{sql} AS {name}" for name, sql in _SCAN.items() if name != "scanned_files"]
    return table(spark, sf_dir, "events").selectExpr(
        "concat('scan-', cast(event_id as string)) AS id", *cols,
        "(event_id % 9) * (event_id % 4) div 3 AS scanned_files",
        "cast(ts as timestamp) AS started_at",
        "cast(timestampadd(MICROSECOND, event_id * 1234567, ts) as timestamp) AS finished_at",
    )


def scans_cte() -> str:
    cols = ", ".join(f"{sql} AS {name}" for name, sql in _SCAN.items() if name != "scanned_files")
    return (
        f"scans AS (SELECT concat('scan-', cast(event_id as varchar)) AS id, {cols}, "
        "(event_id % 9) * (event_id % 4) // 3 AS scanned_files, ts AS started_at, "
        "ts + to_microseconds(event_id * 1234567) AS finished_at FROM events)"
    )


def repo_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan per document source, and one per nation, which has no files and so no findings."""
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.max("doc_id").alias("n")).selectExpr(
        "concat('scan-', source) AS id", "concat('https://github.com/acme/', source) AS repo_url", "'main' AS branch",
        "'done' AS status", "timestampadd(MINUTE, n, timestamp '2024-01-01 00:00:00') AS started_at",
    )
    empty = table(spark, sf_dir, "nation").selectExpr(
        "concat('scan-nation-', cast(n_nationkey as string)) AS id",
        "concat('https://github.com/none/', n_name) AS repo_url", "'dev' AS branch", "'done' AS status",
        "timestampadd(MINUTE, n_nationkey, timestamp '2023-12-01 00:00:00') AS started_at",
    )
    return docs.unionByName(empty)


def repo_scans_cte() -> str:
    return (
        "repo_scans AS (SELECT concat('scan-', source) AS id, concat('https://github.com/acme/', source) AS repo_url, "
        "'main' AS branch, 'done' AS status, timestamp '2024-01-01' + to_minutes(max(doc_id)) AS started_at "
        "FROM documents GROUP BY source UNION ALL SELECT concat('scan-nation-', cast(n_nationkey as varchar)), "
        "concat('https://github.com/none/', n_name), 'dev', 'done', "
        "timestamp '2023-12-01' + to_minutes(cast(n_nationkey as bigint)) FROM nation)"
    )
