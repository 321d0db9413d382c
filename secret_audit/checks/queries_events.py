"""Lifecycle, runs, usage and streaming over the event and conversation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from secret_audit.checks import corpus, oracle as o
from secret_audit.checks.registry import query
from secret_audit.functions import text as T
from secret_audit.operators import listing as L
from secret_audit.operators import merge as J
from secret_audit.operators import metrics as A
from secret_audit.operators import verdicts as V
from secret_audit.session import shared_dir
from secret_audit.streaming import findings as SF
from secret_audit.streaming import status as SS

_KEY = "repo, fingerprint, file_path"
_SPLIT = "timestamp '2024-01-15 00:00:00'"


# --- dedupe and lifecycle --------------------------------------------------------------------------------------------

@query("first_per_key", o.with_(
    o.SIGHTINGS, select="SELECT repo, file_path, type, event_id, confidence FROM sightings QUALIFY row_number() OVER "
                        "(PARTITION BY repo, file_path, type ORDER BY seen_at, event_id) = 1"))
def first_per_key(spark, sf):
    s = corpus.sightings(spark, sf)
    return J.first_per_key(s, ["repo", "file_path", "type"], ["seen_at", "event_id"]).select(
        "repo", "file_path", "type", "event_id", "confidence")


@query("commit_dedupe", o.with_(
    o.SIGHTINGS,
    select="SELECT commit_day, repo, fingerprint, file_path, event_id FROM (SELECT *, CAST(CAST(seen_at AS DATE) AS VARCHAR) AS commit_day, "
           "CASE WHEN type = 'password' THEN 2 ELSE 1 END AS rank FROM sightings) QUALIFY row_number() OVER "
           "(PARTITION BY commit_day, repo, fingerprint, file_path ORDER BY rank, event_id) = 1"))
def commit_dedupe(spark, sf):
    hits = corpus.sightings(spark, sf).withColumns({
        "commit_sha": F.to_date("seen_at").cast("string"),
        "engine": F.when(F.col("type") == "password", "entropy").otherwise("regex"),
        "line_start": F.col("event_id"), "rule_ord": F.lit(0), "match_ord": F.lit(0),
    })
    return J.dedupe_commit(hits).select(
        F.col("commit_sha").alias("commit_day"), "repo", "fingerprint", "file_path", "event_id")


_LIFE = f"SELECT {_KEY}, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at, arg_min(event_id, (seen_at, commit_sha)) AS first_event FROM sightings"


@query("finding_lifecycle", o.with_(o.SIGHTINGS, select=f"{_LIFE} GROUP BY {_KEY}"))
def finding_lifecycle(spark, sf):
    return J.lifecycle(corpus.sightings(spark, sf)).select(
        "repo", "fingerprint", "file_path", "first_seen_at", "last_seen_at", F.col("event_id").alias("first_event"))


@query("finding_lifecycle_legacy_key", o.with_(
    o.SIGHTINGS, select="SELECT fingerprint, file_path, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at FROM sightings GROUP BY ALL"))
def finding_lifecycle_legacy_key(spark, sf):
    return J.lifecycle(corpus.sightings(spark, sf), legacy_key=True).select(
        "fingerprint", "file_path", "first_seen_at", "last_seen_at")


def _early_late(spark, sf):
    s = corpus.sightings(spark, sf)
    # Keys of the first part are thinned by time so that the second part also brings new keys.
    early = s.where("seen_at < timestamp '2024-01-03 00:00:00'")
    late = s.where("seen_at >= timestamp '2024-01-03 00:00:00'")
    return early, late


@query("finding_upsert", o.with_(o.SIGHTINGS, select=f"{_LIFE} GROUP BY {_KEY}"))
def finding_upsert(spark, sf):
    early, late = _early_late(spark, sf)
    merged, _ = J.upsert(J.lifecycle(early), late)
    return merged.select("repo", "fingerprint", "file_path", "first_seen_at", "last_seen_at",
                         F.col("event_id").alias("first_event"))


_NEW_KEYS = f"{_LIFE} WHERE seen_at >= timestamp '2024-01-03' GROUP BY {_KEY}"


@query("upsert_new_rows", o.with_(
    o.SIGHTINGS, f"late AS ({_NEW_KEYS})",
    select="SELECT l.* FROM late l ANTI JOIN (SELECT * FROM sightings WHERE seen_at < timestamp '2024-01-03') e USING (repo, fingerprint, file_path)"))
def upsert_new_rows(spark, sf):
    early, late = _early_late(spark, sf)
    _, added = J.upsert(J.lifecycle(early), late)
    return added.select("repo", "fingerprint", "file_path", "first_seen_at", "last_seen_at",
                        F.col("event_id").alias("first_event"))


@query("insert_if_absent", o.with_(
    o.SIGHTINGS, f"late AS ({_NEW_KEYS})",
    select=f"SELECT {_KEY} FROM late l ANTI JOIN (SELECT * FROM sightings WHERE seen_at < timestamp '2024-01-03') e USING (repo, fingerprint, file_path)"))
def insert_if_absent(spark, sf):
    early, late = _early_late(spark, sf)
    return J.insert_if_absent(J.lifecycle(early), late).select("repo", "fingerprint", "file_path")


def _updates(spark, sf):
    """Findings are fingerprints, updates are events; every third update carries no status, every second no note."""
    s = corpus.sightings(spark, sf)
    found = s.groupBy("fingerprint").agg(F.min("seen_at").alias("last_seen_at")).select(
        F.col("fingerprint").alias("id"), F.lit("NEW").alias("status"), F.lit("").alias("notes"), "last_seen_at")
    updates = s.select(
        F.col("fingerprint").alias("id"), F.when(F.col("event_id") % 3 != 0, F.col("status")).alias("status"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("note "), F.col("event_id").cast("string"))).alias("notes"),
        F.col("seen_at").alias("ts"))
    return found, updates


_UPDATES = (
    o.SIGHTINGS,
    "updates AS (SELECT fingerprint AS id, CASE WHEN event_id % 3 <> 0 THEN status END AS status, "
    "CASE WHEN event_id % 2 = 0 THEN 'note ' || event_id END AS notes, seen_at AS ts FROM sightings)",
    "valid AS (SELECT * FROM updates WHERE status IS NULL OR status IN ('NEW', 'ACKNOWLEDGED', 'RESOLVED'))",
)


@query("status_updates", o.with_(
    *_UPDATES,
    select="SELECT f.id, coalesce(s.status, 'NEW') AS status, coalesce(n.notes, '') AS notes, coalesce(t.ts, f.seen) AS last_seen_at FROM "
           "(SELECT fingerprint AS id, min(seen_at) AS seen FROM sightings GROUP BY 1) f "
           "LEFT JOIN (SELECT id, arg_max(status, ts) AS status FROM valid WHERE status IS NOT NULL GROUP BY id) s USING (id) "
           "LEFT JOIN (SELECT id, arg_max(notes, ts) AS notes FROM valid WHERE notes IS NOT NULL GROUP BY id) n USING (id) "
           "LEFT JOIN (SELECT id, max(ts) AS ts FROM valid GROUP BY id) t USING (id)"))
def status_updates(spark, sf):
    updated, _ = J.apply_updates(*_updates(spark, sf))
    return updated


@query("rejected_status_updates", o.with_(
    *_UPDATES, select="SELECT id, status, ts, 'invalid_status' AS reason FROM updates WHERE status NOT IN ('NEW', 'ACKNOWLEDGED', 'RESOLVED')"))
def rejected_status_updates(spark, sf):
    _, rejected = J.apply_updates(*_updates(spark, sf))
    return rejected.select("id", "status", "ts", "reason")


# --- scans -----------------------------------------------------------------------------------------------------------

@query("scan_progress", o.with_(
    o.SCANS,
    select="SELECT id, status, CAST(CASE status WHEN 'running' THEN CASE WHEN total_files > 0 THEN least(90, trunc(scanned_files / total_files * 90)) "
           "ELSE 50 END WHEN 'done' THEN 100 ELSE 0 END AS INTEGER) AS progress FROM scans"))
def scan_progress(spark, sf):
    return corpus.scans(spark, sf).select(
        "id", "status", L.progress(F.col("status"), F.col("scanned_files"), F.col("total_files")).alias("progress"))


@query("risk_bands", o.with_(
    o.SCANS, select="SELECT id, CASE WHEN risk_score >= 80 THEN 'Critical' WHEN risk_score >= 60 THEN 'High' WHEN risk_score >= 40 THEN 'Medium' "
                    "ELSE 'Low' END AS band FROM scans"))
def risk_bands(spark, sf):
    return corpus.scans(spark, sf).select("id", T.risk_band(F.col("risk_score")).alias("band"))


@query("recent_scans", o.with_(o.SCANS, select="SELECT id, started_at FROM scans ORDER BY started_at DESC, id LIMIT 10"))
def recent_scans(spark, sf):
    return L.recent_scans(corpus.scans(spark, sf).select("id", "started_at"))


@query("scan_totals", o.with_(o.SCANS, select="SELECT least(count(*), 50) AS total_scans, count(*) AS all_scans FROM scans"))
def scan_totals(spark, sf):
    return L.scan_totals(corpus.scans(spark, sf))


@query("latest_scan", o.with_(o.SCANS, select="SELECT id, status, started_at FROM scans ORDER BY started_at DESC, id DESC LIMIT 1"))
def latest_scan(spark, sf):
    return L.latest(corpus.scans(spark, sf)).select("id", "status", "started_at")


@query("latest_scan_per_repo", o.with_(
    o.SCANS, select="SELECT repo_url, id, started_at FROM scans QUALIFY row_number() OVER (PARTITION BY repo_url ORDER BY started_at DESC, id DESC) = 1"))
def latest_scan_per_repo(spark, sf):
    return L.latest(corpus.scans(spark, sf).select("id", "repo_url", "started_at"), "started_at", "repo_url").select(
        "repo_url", "id", "started_at")


@query("scan_listing", o.with_(
    o.SCANS, select="SELECT id AS scan_id, finished_at AS stored_at FROM scans ORDER BY finished_at DESC, id LIMIT 100"))
def scan_listing(spark, sf):
    stored = corpus.scans(spark, sf).select(F.col("id").alias("scan_id"), F.col("finished_at").alias("stored_at"))
    return L.list_scans(stored)


# --- requests --------------------------------------------------------------------------------------------------------

_WORDS = "len(list_filter(regexp_split_to_array(trim(text, E' \\t\\n\\r'), '[\\t-\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{2028}\\x{2029}\\x{3000}]+'), lambda w: w <> ''))"
_USAGE = (
    "usage AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'gpt-3.5-turbo' WHEN 1 THEN 'gemini-1.5-flash' ELSE 'local' END AS model, "
    "CASE conv_id % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'gemini' ELSE 'none' END AS provider, "
    f"CAST(CASE WHEN role = 'assistant' THEN 0 ELSE {_WORDS} END AS INTEGER) AS prompt_tokens, "
    f"CAST(CASE WHEN role = 'assistant' THEN {_WORDS} ELSE 0 END AS INTEGER) AS completion_tokens FROM conversations)"
)


def _usage(spark, sf):
    words = T.word_count(F.col("text"))
    reply = F.col("role") == "assistant"
    part = F.col("conv_id") % 3
    return corpus.table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.when(part == 0, "gpt-3.5-turbo").when(part == 1, "gemini-1.5-flash").otherwise("local").alias("model"),
        F.when(part == 0, "openai").when(part == 1, "gemini").otherwise("none").alias("provider"),
        F.when(reply, 0).otherwise(words).alias("prompt_tokens"), F.when(reply, words).otherwise(0).alias("completion_tokens"))


@query("token_estimates", o.with_(_USAGE, select="SELECT conv_id, turn, prompt_tokens, completion_tokens FROM usage"))
def token_estimates(spark, sf):
    return _usage(spark, sf).select("conv_id", "turn", "prompt_tokens", "completion_tokens")


@query("usage_totals", o.with_(
    _USAGE, select="SELECT provider, model, count(*) AS requests, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS "
                   "completion_tokens, sum(prompt_tokens + completion_tokens)::BIGINT AS total_tokens FROM usage GROUP BY ROLLUP (provider, model)"))
def usage_totals(spark, sf):
    return A.usage_totals(_usage(spark, sf))


@query("cost_estimates", o.with_(
    _USAGE, select="SELECT conv_id, turn, model, round(CASE model WHEN 'gpt-3.5-turbo' THEN (prompt_tokens * 0.0015 + completion_tokens * 0.002) / 1000 "
                   "WHEN 'gemini-1.5-flash' THEN (prompt_tokens * 0.00075 + completion_tokens * 0.003) / 1000 END, 9)::DOUBLE AS cost_usd FROM usage"))
def cost_estimates(spark, sf):
    return T.with_cost(_usage(spark, sf)).select("conv_id", "turn", "model", F.round("cost_usd", 9).alias("cost_usd"))


@query("first_user_message",
       "SELECT conv_id, arg_min(text, turn) AS user_message FROM conversations WHERE role = 'user' GROUP BY conv_id HAVING length(arg_min(text, turn)) > 0")
def first_user_message(spark, sf):
    return V.first_user_message(corpus.table(spark, sf, "conversations"))


@query("last_requests", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 10")
def last_requests(spark, sf):
    events = corpus.table(spark, sf, "events").select("event_id", "ts")
    return L.page(events, "ts", 10, 0, "event_id").select("event_id", F.col("ts").cast("timestamp").alias("ts"))


def _requests(spark, sf):
    """Events are requests, purchases have been answered before; the prompt repeats per user and property."""
    e = corpus.table(spark, sf, "events")
    prompt = F.concat_ws(" ", F.lit("check"), F.col("user_id").cast("string"), "props")
    key = V.cache_key(prompt, F.lit("gpt-4"), F.lit("openai"))
    requests = e.select(
        F.col("event_id").alias("request_id"), key.alias("cache_key"), prompt.alias("prompt"), F.col("ts").cast("timestamp").alias("ts"))
    cache = e.where(F.col("event_type") == "purchase").select(
        key.alias("cache_key"), F.concat(F.lit("answer "), F.col("event_id").cast("string")).alias("response"),
        F.expr("timestampadd(SECOND, 90, cast(ts as timestamp))").alias("stored_at"))
    return requests, cache


_CACHE = (
    "keyed AS (SELECT event_id, event_type, ts, 'check ' || user_id || ' ' || props AS prompt, "
    "md5('check ' || user_id || ' ' || props || '_gpt-4_openai') AS cache_key FROM events)",
    # An answer is stored 90 seconds after its request, so it can't serve that request itself.
    "cache AS (SELECT cache_key, 'answer ' || event_id AS answer, ts + INTERVAL 90 SECOND AS stored_at FROM keyed WHERE event_type = 'purchase')",
    "requests AS (SELECT k.event_id AS request_id, k.cache_key, k.prompt, k.ts, arg_max(c.answer, (c.stored_at, c.answer)) AS response "
    "FROM keyed k LEFT JOIN cache c ON c.cache_key = k.cache_key AND c.stored_at <= k.ts "
    "AND epoch_us(k.ts) - epoch_us(c.stored_at) < 864000 * 1000000::BIGINT GROUP BY ALL)",
)


@query("cached_responses", o.with_(*_CACHE, select="SELECT request_id, cache_key, response FROM requests"))
def cached_responses(spark, sf):
    requests, cache = _requests(spark, sf)
    return V.reuse_responses(requests, cache, 864000).select("request_id", "cache_key", "response")


@query("uncached_requests", o.with_(
    *_CACHE, "waiting AS (SELECT cache_key, ts, request_id FROM requests WHERE response IS NULL)",
    "calls AS (SELECT cache_key, min((ts, request_id)) AS c FROM waiting GROUP BY cache_key UNION ALL "
    "SELECT w.cache_key, min((w.ts, w.request_id)) FROM calls p JOIN waiting w ON w.cache_key = p.cache_key "
    "AND epoch_us(w.ts) - epoch_us(p.c[1]) >= 864000 * 1000000::BIGINT GROUP BY w.cache_key, p.c)",
    select="SELECT cache_key, c[2] AS request_id FROM calls").replace("WITH ", "WITH RECURSIVE ", 1))
def uncached_requests(spark, sf):
    requests, cache = _requests(spark, sf)
    return V.uncached(requests, cache, 864000).select("cache_key", "request_id")


# --- streaming -------------------------------------------------------------------------------------------------------

def _stream(spark, sf, name):
    schema = corpus.table(spark, sf, name).schema
    return SF.read_new_files(spark, f"{sf}/{name}.parquet", schema)


def _sightings_stream(spark, sf):
    cols = [f"{sql} AS {name}" for name, sql in corpus._SIGHTING.items()]
    return _stream(spark, sf, "events").selectExpr(
        "event_id", "sha2(cast(user_id as string), 256) AS fingerprint", "cast(ts as timestamp) AS seen_at",
        "sha2(cast(event_id as string), 256) AS commit_sha", *cols)


@query("streaming_scan", o.with_(
    o.FILES, o.content_hits(), select="SELECT file_path, rule, line_start, match_ord, sha256(secret) AS fingerprint FROM hits"))
def streaming_scan(spark, sf):
    files = corpus.plant(_stream(spark, sf, "documents"))
    out, state = shared_dir(spark, "stream"), shared_dir(spark, "state")
    found = SF.scan_stream(files, partitions=spark.sparkContext.defaultParallelism)
    SF.run_available(found, state, out)
    return spark.read.schema(found.schema).parquet(out).select("file_path", "rule", "line_start", "match_ord", "fingerprint")


@query("streaming_dedupe", o.with_(o.SIGHTINGS, select=f"SELECT DISTINCT {_KEY} FROM sightings"))
def streaming_dedupe(spark, sf):
    out, state = shared_dir(spark, "stream"), shared_dir(spark, "state")
    kept = SF.dedupe_stream(_sightings_stream(spark, sf), "seen_at", "40 days").select("repo", "fingerprint", "file_path")
    SF.run_available(kept, state, out)
    return spark.read.schema(kept.schema).parquet(out)


@query("streaming_first_sightings", o.with_(
    o.SIGHTINGS, f"gaps AS (SELECT *, CASE WHEN seen_at - lag(seen_at) OVER w <= INTERVAL 2 DAY THEN 0 ELSE 1 END AS fresh FROM sightings WINDOW w AS "
    f"(PARTITION BY {_KEY} ORDER BY seen_at))", f"runs AS (SELECT *, sum(fresh) OVER (PARTITION BY {_KEY} ORDER BY seen_at) AS run FROM gaps)",
    select=f"SELECT {_KEY}, min(seen_at) AS seen_at, arg_min(event_id, (seen_at, event_id)) AS event_id, arg_min(type, (seen_at, event_id)) AS type, "
           f"count(*) AS sightings, max(seen_at) AS last_seen_at FROM runs GROUP BY {_KEY}, run "
           "HAVING max(seen_at) + INTERVAL 2 DAY <= (SELECT max(seen_at) - INTERVAL 2 DAY FROM sightings)"))
def streaming_first_sightings(spark, sf):
    """The earliest row of each run of sightings, not only its key."""
    out, state = shared_dir(spark, "stream"), shared_dir(spark, "state")
    rows = _sightings_stream(spark, sf).select("repo", "fingerprint", "file_path", "seen_at", "event_id", "type")
    first = SF.first_sightings_stream(rows, "seen_at", "2 days")
    SF.run_available(first, state, out)
    return spark.read.schema(first.schema).parquet(out)


@query("streaming_upsert", o.with_(
    o.SIGHTINGS, select=f"SELECT {_KEY}, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at FROM sightings GROUP BY {_KEY}"))
def streaming_upsert(spark, sf):
    base, state = shared_dir(spark, "snapshot"), shared_dir(spark, "state")
    SF.run_upsert(_sightings_stream(spark, sf), state, base)
    return SF.read_lifecycle(spark, base).select("repo", "fingerprint", "file_path", "first_seen_at", "last_seen_at")


@query("streaming_daily_rollup", o.with_(
    o.SIGHTINGS,
    select="SELECT * FROM (SELECT CAST(seen_at AS DATE) AS day, repo, count(*) AS findings_total, "
           + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))
           + " FROM sightings GROUP BY ALL) WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(seen_at) - INTERVAL 1 HOUR FROM sightings)"))
def streaming_daily_rollup(spark, sf):
    out, state = shared_dir(spark, "stream"), shared_dir(spark, "state")
    rolled = SF.daily_rollup_stream(_sightings_stream(spark, sf), "seen_at")
    SF.run_available(rolled, state, out)
    return spark.read.schema(rolled.schema).parquet(out)


@query("streaming_status", o.with_(
    o.SIGHTINGS,
    select="SELECT fingerprint, arg_max(status, (seen_at, status)) AS status, count(*) AS changes, min(seen_at) AS first_seen_at, "
           "max(seen_at) AS last_seen_at FROM sightings WHERE status <> 'BOGUS' GROUP BY fingerprint"))
def streaming_status(spark, sf):
    base, state = shared_dir(spark, "snapshot"), shared_dir(spark, "state")
    updates = _sightings_stream(spark, sf).select("fingerprint", "status", F.col("seen_at").alias("ts"))
    SS.run_status(updates, state, base)
    return SS.read_status(spark, base)


@query("streaming_resume", o.with_(o.SIGHTINGS, select="SELECT type, count(*) AS sightings FROM sightings GROUP BY type"))
def streaming_resume(spark, sf):
    """A second run with the same checkpoint takes nothing twice."""
    out, state = shared_dir(spark, "stream"), shared_dir(spark, "state")
    stream = _sightings_stream(spark, sf).select("event_id", "type")
    for _ in range(2):
        SF.run_available(stream, state, out)
    return spark.read.schema(stream.schema).parquet(out).groupBy("type").agg(F.count("*").alias("sightings"))
