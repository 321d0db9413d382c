"""Detection, masks, entropy, context and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from secret_audit.checks import corpus, oracle as o
from secret_audit.checks.registry import query
from secret_audit.functions import entropy as E
from secret_audit.functions import mask as M
from secret_audit.functions import text as T
from secret_audit.operators import detect as D
from secret_audit.operators import scoring
from secret_audit.operators.merge import suppress_regex_hits
from secret_audit.plans import commit_scan
from secret_audit.plugins import Registry, checksum_numbers, get_classifier, registry, row_detector, row_table_function
from secret_audit.rules import COMMIT_PACK, CONTENT_PACK, PLUGIN_PACK, Rule

_HIT = "file_path, rule, type, severity, confidence, match_ord, line_start, line_end, secret"


@query("content_scan", o.with_(o.FILES, o.content_hits(), select=f"SELECT {_HIT} FROM hits"))
def content_scan(spark, sf):
    return D.scan_content(corpus.files(spark, sf)).select(*_HIT.split(", "))


@query("line_split", o.with_(
    o.FILES, o.LINES,
    select="SELECT repo, count(*) AS lines, sum(line_no)::BIGINT AS line_numbers, sum(length(line))::BIGINT AS characters, "
           "count(*) FILTER (WHERE line = '') AS empty_lines FROM lines GROUP BY repo"))
def line_split(spark, sf):
    lines = D.split_lines(corpus.files(spark, sf))
    return lines.groupBy("repo").agg(
        F.count("*").alias("lines"), F.sum("line_no").alias("line_numbers"), F.sum(F.length("line")).alias("characters"),
        F.count_if(F.col("line") == "").alias("empty_lines"))


_LINE_HIT = "file_path, rule, type, confidence, line_start, match_ord, secret, line"


@query("line_scan", o.with_(o.FILES, o.LINES, o.line_hits(), select=f"SELECT {_LINE_HIT} FROM line_hits"))
def line_scan(spark, sf):
    return D.scan_lines(corpus.files(spark, sf), COMMIT_PACK).select(*_LINE_HIT.split(", "))


@query("line_scan_plugin_pack", o.with_(
    o.FILES, o.LINES, o.line_hits(rules=PLUGIN_PACK), select=f"SELECT {_LINE_HIT} FROM line_hits"))
def line_scan_plugin_pack(spark, sf):
    return D.scan_lines(corpus.files(spark, sf), PLUGIN_PACK).select(*_LINE_HIT.split(", "))


def _text_scan_sql(table: str, key: str, text: str) -> str:
    source = f"src AS (SELECT {key}, {text} AS content FROM {table})"
    return o.with_(
        source, o.content_hits("hits", "src", columns=key),
        select=f"SELECT {key}, '<input>' AS file_path, rule, match_ord, 1 AS line_start, 1 AS line_end, secret FROM hits")


def _text_scan(df, key, text):
    return D.scan_text(df.select(key, text), text).select(
        key, "file_path", "rule", "match_ord", "line_start", "line_end", "secret")


@query("scan_pages", _text_scan_sql("pages", "page_id", "html"))
def scan_pages(spark, sf):
    return _text_scan(corpus.table(spark, sf, "pages"), "page_id", "html")


@query("scan_documents", _text_scan_sql("documents", "doc_id", "text"))
def scan_documents(spark, sf):
    return _text_scan(corpus.table(spark, sf, "documents"), "doc_id", "text")


_CHAT = "text || CASE WHEN turn % 2 = 0 THEN ' Password: \"hunter' || conv_id || 'xx\"' ELSE '' END"


@query("scan_conversations", o.with_(
    f"src AS (SELECT conv_id, turn, {_CHAT} AS content FROM conversations)", o.content_hits("hits", "src", columns="conv_id, turn"),
    select="SELECT conv_id, turn, rule, match_ord, line_start, secret FROM (SELECT *  EXCLUDE(line_start), 1 AS line_start FROM hits)"))
def scan_conversations(spark, sf):
    chat = corpus.table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{_CHAT} AS body")
    return D.scan_text(chat, "body").select("conv_id", "turn", "rule", "match_ord", "line_start", "secret")


@query("context_snippet", o.with_(
    o.FILES, o.content_hits(),
    "numbered AS (SELECT h.file_path, h.rule, h.match_ord, n, printf('%s%4d: %s', CASE WHEN n BETWEEN line_start AND line_end "
    "THEN '>>> ' ELSE '    ' END, n, ls[n]) AS shown FROM (SELECT h.*, string_split(f.content, chr(10)) AS ls, "
    "unnest(range(greatest(1, line_start - 3), least(len(string_split(f.content, chr(10))), line_end + 3) + 1)) AS n "
    "FROM hits h JOIN files f USING (doc_id)) h)",
    select="SELECT file_path, rule, match_ord, string_agg(shown, chr(10) ORDER BY n) AS context FROM numbered GROUP BY ALL"))
def context_snippet(spark, sf):
    return D.scan_content(corpus.files(spark, sf), context=True).select("file_path", "rule", "match_ord", "context")


@query("hit_line_text", o.with_(
    o.FILES, "numbered AS (SELECT doc_id, CAST(1 + doc_id % 40 AS INTEGER) AS line_no, string_split(content, chr(10)) AS ls FROM files)",
    select="SELECT doc_id, line_no, coalesce(ls[line_no], '') AS line FROM numbered"))
def hit_line_text(spark, sf):
    files = corpus.files(spark, sf).withColumn("line_no", (F.col("doc_id") % 40 + 1).cast("int"))
    return files.select("doc_id", "line_no", D.line_at(F.col("content"), F.col("line_no")).alias("line"))


@query("rule_summary", o.with_(
    o.FILES, o.content_hits(), "pack(ord, name, kind, severity, confidence) AS (VALUES " + ", ".join(
        f"({i}, {o.lit(r.name)}, {o.lit(r.kind)}, {o.lit(r.severity)}, {r.confidence}::DOUBLE)" for i, r in enumerate(CONTENT_PACK)) + ")",
    select="SELECT 'content' AS pack, count(*) AS total_patterns, string_agg(name || '/' || kind || '/' || severity || '/' || "
           "CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR), ',' ORDER BY ord) AS patterns, count(n) AS matched_patterns "
           "FROM pack LEFT JOIN (SELECT rule, count(*) AS n FROM hits GROUP BY rule) h ON h.rule = pack.name"))
def rule_summary(spark, sf):
    """The whole pack with confidence, and how many of its rules match anything."""
    from secret_audit.rules import rules_table

    matched = D.scan_content(corpus.files(spark, sf)).agg(F.countDistinct("rule").alias("matched_patterns"))
    percent = lambda p: F.round(p["confidence"] * 100).cast("int").cast("string")
    line = F.transform("patterns", lambda p: F.concat_ws("/", p["name"], p["type"], p["severity"], percent(p)))
    summary = D.rule_summary(rules_table(spark, {"content": CONTENT_PACK})).withColumn("one", F.lit(1))
    return summary.join(matched.withColumn("one", F.lit(1)), "one").select(
        "pack", "total_patterns", F.array_join(line, ",").alias("patterns"), "matched_patterns")


# --- entropy ---------------------------------------------------------------------------------------------------------

@query("shannon_entropy",
       f"SELECT conv_id, turn, round({o.entropy('text')}, 6) AS entropy FROM conversations")
def shannon_entropy(spark, sf):
    chat = corpus.table(spark, sf, "conversations")
    return chat.select("conv_id", "turn", F.round(E.shannon_entropy(F.col("text")), 6).alias("entropy"))


@query("entropy_candidates", o.with_(
    o.FILES, o.LINES, o.CANDIDATES,
    select="SELECT file_path, line_start, match_ord, secret, round(entropy, 6) AS entropy FROM candidates WHERE round(entropy, 12) >= 4.5"))
def entropy_candidates(spark, sf):
    return D.entropy_candidates(corpus.files(spark, sf)).select(
        "file_path", "line_start", "match_ord", "secret", F.round("entropy", 6).alias("entropy"))


def _tokens(spark, sf):
    return D.entropy_candidates(corpus.files(spark, sf), threshold=0.0)


def _on_tokens(select: str) -> str:
    return o.with_(o.FILES, o.LINES, o.CANDIDATES, select=select)


@query("likely_secret_score", _on_tokens(
    f"SELECT file_path, line_start, match_ord, round({o.score('secret', 'entropy')}, 6) AS score, "
    f"round({o.score('secret', 'entropy')}, 12) >= 4.5 AS is_secret FROM candidates"))
def likely_secret_score(spark, sf):
    score = E.likely_secret_score(F.col("secret"), F.col("entropy"))
    return _tokens(spark, sf).select(
        "file_path", "line_start", "match_ord", F.round(score, 6).alias("score"), E.passes(score).alias("is_secret"))


@query("entropy_false_positives", _on_tokens(
    f"SELECT file_path, line_start, match_ord, secret, {o.false_positive('secret')} AS false_positive FROM candidates"))
def entropy_false_positives(spark, sf):
    return _tokens(spark, sf).select(
        "file_path", "line_start", "match_ord", "secret", E.is_false_positive(F.col("secret")).alias("false_positive"))


@query("entropy_confidence", _on_tokens(
    "SELECT file_path, line_start, match_ord, round(least(0.9, entropy / 6.0), 6) AS confidence FROM candidates "
    "WHERE least(0.9, entropy / 6.0) >= 0.3"))
def entropy_confidence(spark, sf):
    tokens = _tokens(spark, sf).withColumn("confidence", E.entropy_confidence(F.col("entropy")))
    return tokens.where(F.col("confidence") >= E.MIN_CONFIDENCE).select(
        "file_path", "line_start", "match_ord", F.round("confidence", 6).alias("confidence"))


@query("entropy_rule_shapes", _on_tokens(
    f"SELECT file_path, line_start, match_ord, secret FROM candidates WHERE NOT {o.starts_like_rule('secret')}"))
def entropy_rule_shapes(spark, sf):
    tokens = _tokens(spark, sf)
    return tokens.where(~E.starts_like_rule(F.col("secret"))).select("file_path", "line_start", "match_ord", "secret")


@query("regex_hit_suppression", o.with_(
    *o.COMMIT_BASE,
    select="SELECT file_path, line_start, match_ord, sha256(secret) AS fingerprint FROM candidates c WHERE round(entropy, 12) >= 4.5 "
           "AND NOT EXISTS (SELECT 1 FROM line_hits h WHERE h.doc_id = c.doc_id AND h.secret = c.secret)"))
def regex_hit_suppression(spark, sf):
    files = corpus.files(spark, sf)
    finger = M.fingerprint(F.col("secret"))
    found = D.entropy_candidates(files).withColumn("fingerprint", finger)
    rules = D.scan_lines(files, COMMIT_PACK).withColumn("fingerprint", finger)
    return suppress_regex_hits(found, rules).select("file_path", "line_start", "match_ord", "fingerprint")


# --- masks and hashes ------------------------------------------------------------------------------------------------

@query("masked_previews", o.with_(
    o.FILES, o.LINES, o.line_hits(),
    select=f"SELECT file_path, rule, line_start, match_ord, {o.mask('secret', 'mask')} AS masked_preview, sha256(secret) AS fingerprint FROM line_hits"))
def masked_previews(spark, sf):
    return D.mask_hits(D.scan_lines(corpus.files(spark, sf), COMMIT_PACK)).select(
        "file_path", "rule", "line_start", "match_ord", "masked_preview", "fingerprint")


@query("masks_by_kind", o.with_(
    o.FILES, o.LINES, o.line_hits(), "kinds(k) AS (VALUES ('generic'), ('aws'), ('url'), ('bearer'), ('jwt'), ('pem'), ('db'))",
    select=f"SELECT file_path, rule, line_start, match_ord, k AS kind, {o.mask('secret', 'k')} AS masked FROM line_hits, kinds"))
def masks_by_kind(spark, sf):
    hits = D.scan_lines(corpus.files(spark, sf), COMMIT_PACK)
    masked = F.array(*[
        F.struct(F.lit(k).alias("kind"), fn(F.col("secret")).alias("masked")) for k, fn in M.MASKS.items()])
    return hits.select("file_path", "rule", "line_start", "match_ord", F.inline(masked))


@query("evidence_hashes", o.on_findings("SELECT file_path, rule, match_ord, evidence_hash, fingerprint FROM raw_findings"))
def evidence_hashes(spark, sf):
    return D.findings_from_content(corpus.files(spark, sf)).select(
        "file_path", "rule", "match_ord", "evidence_hash", "fingerprint")


def _redact_sql(expr: str) -> str:
    for name, pattern in M.REDACTIONS:
        expr = f"regexp_replace({expr}, {o.re2(pattern)}, '{name}=***REDACTED***', 'g')"
    return expr


@query("redact_documents", o.with_(o.FILES, select=f"SELECT doc_id, sha256({_redact_sql('content')}) AS redacted FROM files"))
def redact_documents(spark, sf):
    return corpus.files(spark, sf).select("doc_id", F.sha2(M.redact_text(F.col("content")), 256).alias("redacted"))


@query("redact_conversations",
       f"SELECT conv_id, turn, {_redact_sql('text')} AS redacted FROM conversations")
def redact_conversations(spark, sf):
    return corpus.table(spark, sf, "conversations").select(
        "conv_id", "turn", M.redact_text(F.col("text")).alias("redacted"))


@query("prefix_redaction",
       "SELECT conv_id, turn, CASE WHEN length(text) > 0 THEN text[1:8] || '...' END AS short, "
       "CASE WHEN length(text) > 0 THEN text[1:20] || '...' END AS long FROM conversations")
def prefix_redaction(spark, sf):
    t = F.col("text")
    return corpus.table(spark, sf, "conversations").select(
        "conv_id", "turn", M.redact_prefix(t).alias("short"), M.redact_prefix(t, 20).alias("long"))


@query("location_and_names", o.on_findings(
    "SELECT id, file_path || ':' || line_start AS location, upper(regexp_replace(type, '_', ' ')) AS display_name, "
    "regexp_replace(type, '_', '-') AS rule_id FROM findings"))
def location_and_names(spark, sf):
    from secret_audit.checks.queries_findings import findings

    return findings(spark, sf).select(
        "id", T.location(F.col("file_path"), F.col("line_start")).alias("location"),
        T.display_name(F.col("type")).alias("display_name"), T.sarif_rule_id(F.col("type")).alias("rule_id"))


@query("iso_times_and_durations", o.with_(
    o.SCANS,
    select="SELECT id, CASE WHEN epoch_us(started_at) % 1000000 = 0 THEN strftime(started_at, '%Y-%m-%dT%H:%M:%S') "
           "ELSE strftime(started_at, '%Y-%m-%dT%H:%M:%S.%f') END AS started, "
           "(epoch_us(finished_at) - epoch_us(started_at)) // 1000 AS duration_ms FROM scans"))
def iso_times_and_durations(spark, sf):
    return corpus.scans(spark, sf).select(
        "id", T.iso_time(F.col("started_at")).alias("started"),
        T.duration_ms(F.col("started_at"), F.col("finished_at")).alias("duration_ms"))


# --- context and classification --------------------------------------------------------------------------------------

_CTX_SELECT = (
    f"SELECT file_path, rule, line_start, match_ord, round({o.adjustment('file_path', 'line')}, 6) AS adjustment, "
    f"{o.reason('file_path', 'line')} AS context_reason FROM line_hits"
)


@query("context_score", o.with_(o.FILES, o.LINES, o.line_hits(), select=_CTX_SELECT))
def context_score(spark, sf):
    scored = scoring.score_context(D.scan_lines(corpus.files(spark, sf), COMMIT_PACK))
    return scored.select(
        "file_path", "rule", "line_start", "match_ord", F.round("context_adjustment", 6).alias("adjustment"), "context_reason")


_CTX_CONF = o.clamp(f"confidence + {o.adjustment('file_path', 'line')}")


@query("context_filter", o.with_(
    o.FILES, o.LINES, o.line_hits(),
    select=f"SELECT file_path, rule, line_start, match_ord, round(c, 6) AS confidence FROM (SELECT *, {_CTX_CONF} AS c FROM line_hits) WHERE c >= 0.3"))
def context_filter(spark, sf):
    kept = scoring.filter_by_context(D.scan_lines(corpus.files(spark, sf), COMMIT_PACK))
    return kept.select("file_path", "rule", "line_start", "match_ord", F.round("confidence", 6).alias("confidence"))


@query("rule_classifier", o.with_(
    o.FILES, o.LINES, o.line_hits(),
    select=f"SELECT file_path, rule, line_start, match_ord, round({o.rule_confidence('type', 'file_path', 'line')}, 6) AS class_confidence, "
           "type AS label, 'Rule-based classification for ' || type AS reasoning FROM line_hits"))
def rule_classifier(spark, sf):
    hits = get_classifier("rule")(D.scan_lines(corpus.files(spark, sf), COMMIT_PACK))
    return hits.select("file_path", "rule", "line_start", "match_ord", F.round("class_confidence", 6).alias("class_confidence"),
                       "label", "reasoning")


@query("confidence_merge", o.with_(
    o.FILES, o.LINES, o.line_hits(),
    select=f"SELECT file_path, rule, line_start, match_ord, round(greatest(c, {o.rule_confidence('type', 'file_path', 'line')}), 6) AS confidence, "
           "'Rule-based classification for ' || type AS classification_reason "
           f"FROM (SELECT *, {_CTX_CONF} AS c FROM line_hits) WHERE c >= 0.3"))
def confidence_merge(spark, sf):
    hits = scoring.filter_by_context(D.scan_lines(corpus.files(spark, sf), COMMIT_PACK))
    return scoring.merge_confidence(get_classifier("ml")(hits)).select(
        "file_path", "rule", "line_start", "match_ord", F.round("confidence", 6).alias("confidence"), "classification_reason")


def _commit_sql(legacy: bool) -> str:
    raw = o.score("secret", "entropy")
    conf = raw if legacy else "least(0.9, entropy / 6.0)"
    keep = f"round(entropy, 12) >= 4.5 AND NOT {o.false_positive('secret')}"
    return o.with_(
        *o.COMMIT_BASE,
        "everything AS (SELECT doc_id, repo, commit_sha, file_path, line_start, line, rule_ord, match_ord, type, confidence, secret, "
        "0 AS rank, mask FROM line_hits UNION ALL SELECT doc_id, repo, commit_sha, file_path, line_start, line, 1000000, match_ord, "
        f"'high_entropy_string', {conf}, secret, 1, 'generic' FROM candidates c WHERE {keep} "
        "AND NOT EXISTS (SELECT 1 FROM line_hits h WHERE h.doc_id = c.doc_id AND h.secret = c.secret))",
        f"scored AS (SELECT *, {_CTX_CONF} AS c, {o.reason('file_path', 'line')} AS context_reason, "
        f"{o.rule_confidence('type', 'file_path', 'line')} AS k FROM everything)",
        select="SELECT repo, commit_sha, file_path, type, line_start, sha256(secret) AS fingerprint, "
               f"{o.mask('secret', 'mask')} AS masked_preview, round(greatest(c, k), 6) AS confidence, context_reason "
               "FROM scored WHERE c >= 0.3 QUALIFY row_number() OVER (PARTITION BY repo, commit_sha, file_path, secret "
               "ORDER BY rank, line_start, rule_ord, match_ord) = 1")


def _commit_cols(df):
    return df.select("repo", "commit_sha", "file_path", "type", "line_start", "fingerprint", "masked_preview",
                     F.round("confidence", 6).alias("confidence"), "context_reason")


@query("commit_findings", _commit_sql(False))
def commit_findings(spark, sf):
    return _commit_cols(commit_scan.commit_findings(corpus.files(spark, sf)))


@query("commit_findings_legacy", _commit_sql(True))
def commit_findings_legacy(spark, sf):
    return _commit_cols(commit_scan.commit_findings(corpus.files(spark, sf), legacy_confidence=True))


@query("plugin_findings", o.with_(
    *o.PLUGIN_BASE,
    select="SELECT file_path || ':' || line_start AS location, 'regex' AS engine, type, match_ord, sha256(secret) AS fingerprint, "
           "round(confidence, 6) AS confidence FROM line_hits UNION ALL SELECT file_path || ':' || line_start, 'entropy', "
           "'high_entropy_string', match_ord, sha256(secret), round(least(0.9, entropy / 6.0), 6) FROM candidates "
           f"WHERE round(entropy, 12) >= 4.5 AND NOT {o.false_positive('secret')} AND NOT {o.starts_like_rule('secret')}"))
def plugin_findings(spark, sf):
    return commit_scan.plugin_findings(corpus.files(spark, sf)).select(
        "location", "engine", "type", "match_ord", "fingerprint", F.round("confidence", 6).alias("confidence"))


@query("plugin_cycles", o.with_(
    *o.PLUGIN_BASE,
    "found AS (SELECT doc_id, repo, commit_sha, file_path, sha256(secret) AS fingerprint, type FROM line_hits UNION ALL "
    "SELECT doc_id, repo, commit_sha, file_path, sha256(secret), 'high_entropy_string' FROM candidates "
    f"WHERE round(entropy, 12) >= 4.5 AND NOT {o.false_positive('secret')} AND NOT {o.starts_like_rule('secret')}), "
    "seen AS (SELECT repo, fingerprint, file_path, CASE WHEN bool_or(doc_id % 2 = 0) THEN 1 ELSE 2 END AS v FROM found GROUP BY ALL)",
    select="SELECT 'cycle-000000000' || c.v AS run_id, c.n AS contexts_processed, coalesce(s.n, 0) AS findings_detected FROM "
           "(SELECT 1 AS v, count(*) FILTER (WHERE doc_id % 2 = 0) AS n FROM files UNION ALL SELECT 2, count(*) FROM files) c "
           "LEFT JOIN (SELECT v, count(*) AS n FROM seen GROUP BY v) s USING (v)"))
def plugin_cycles(spark, sf):
    """Two cycles: the second sees all files and stores only what the first, with half of them, did not."""
    from secret_audit.plans.jobs import run_plugin_cycle
    from secret_audit.session import shared_dir

    base = shared_dir(spark, "cycles")
    files = corpus.files(spark, sf).withColumn("seen_at", F.to_timestamp(F.lit("2024-01-01"))).withColumn("metadata", F.lit(None))
    first = run_plugin_cycle(files.where("doc_id % 2 = 0"), base, 1)["cycle"]
    return first.unionByName(run_plugin_cycle(files, base, 2)["cycle"]).select("run_id", "contexts_processed", "findings_detected")


# --- plugins ---------------------------------------------------------------------------------------------------------

@query("registered_detectors", o.with_(
    o.FILES, o.LINES, o.line_hits(rules=PLUGIN_PACK), o.content_hits(),
    select="SELECT file_path, type, line_start, match_ord, sha256(secret) AS fingerprint FROM line_hits UNION ALL "
           "SELECT file_path, type, line_start, match_ord, sha256(secret) FROM hits"))
def registered_detectors(spark, sf):
    return registry.detect(corpus.files(spark, sf), ["regex", "content"]).select(
        "file_path", "type", "line_start", "match_ord", "fingerprint")


_TOKENS = "text || chr(10) || 'see doc' || doc_id || '_' || substr({0}, 1, 6) || ' and DOC' || (doc_id * 7) % 9000 || '_' || substr({0}, 7, 6) || ' xdoc1_abcdef'"


@query("large_rule_pack",
       "WITH src AS (SELECT doc_id, " + _TOKENS.format("sha256(CAST(doc_id AS VARCHAR))") + " AS content FROM documents), "
       "found AS (SELECT doc_id, content, unnest(regexp_extract_all(content, '(?i)\\bdoc[0-9]+_[0-9a-f]{6}')) AS secret FROM src) "
       "SELECT doc_id, 'doc' || n AS rule, line_start, secret FROM (SELECT doc_id, secret, CAST(regexp_extract(secret, '[0-9]+') AS BIGINT) AS n, "
       "CAST(1 + length(content) - length(replace(content, chr(10), '')) AS INTEGER) AS line_start FROM found) WHERE n < 5000")
def large_rule_pack(spark, sf):
    """Five thousand rules, found by the literals that they need."""
    rules = [Rule(f"doc{i}", "token", 0.5, rf"\bdoc{i}_[0-9a-f]{{6}}") for i in range(5000)]
    digest = "sha2(cast(doc_id as string), 256)"
    docs = corpus.table(spark, sf, "documents").selectExpr("doc_id", _TOKENS.format(digest) + " AS content")
    return D.scan_content(docs, rules).select("doc_id", "rule", "line_start", "secret")


@query("failing_detectors", o.with_(
    o.FILES, o.content_hits(),
    select="SELECT 'content' AS detector, type, count(*) AS n FROM hits GROUP BY type UNION ALL SELECT 'broken', 'rejected', 1 UNION ALL SELECT 'lost', 'rejected', 1"))
def failing_detectors(spark, sf):
    """A detector whose tasks fail and one that gives no plan are skipped; the others' matches stay."""
    own = Registry()
    own.register("detector", "broken")(lambda f: f.select("file_path", F.raise_error(F.lit("no model")).cast("string").alias("type")))
    own.register("detector", "content")(registry.get("detector", "content"))
    own.register("detector", "lost")(lambda f: f.select("no_such_column"))
    found, rejects = own.detect_each(corpus.files(spark, sf))
    kept = found.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("content").alias("detector"), "type", "n")
    return kept.unionByName(rejects.select("detector", F.lit("rejected").alias("type"), F.lit(1).cast("long").alias("n")))


_DIGIT = "CAST(s[length(s) - i] AS INTEGER)"
_LUHN = (
    "runs AS (SELECT file_path, line_no, unnest(regexp_extract_all(line, '[0-9]{6,}')) AS s FROM lines)",
    "checked AS (SELECT file_path, line_no AS line_start, s FROM runs WHERE list_sum(list_transform(range(length(s)), lambda i: "
    f"CASE WHEN i % 2 = 0 THEN {_DIGIT} WHEN {_DIGIT} > 4 THEN 2 * {_DIGIT} - 9 ELSE 2 * {_DIGIT} END)) % 10 = 0)",
)


@query("row_detector", o.with_(
    o.FILES, o.LINES, *_LUHN, select="SELECT file_path, 'checksum_number' AS type, line_start, sha256(s) AS fingerprint FROM checked"))
def row_detector_query(spark, sf):
    return row_detector(checksum_numbers)(corpus.files(spark, sf)).select("file_path", "type", "line_start", "fingerprint")


@query("row_detector_table_function", o.with_(
    o.FILES, o.LINES, *_LUHN, select="SELECT file_path, line_start, length(s) AS digits FROM checked"))
def row_detector_table_function(spark, sf):
    matches = row_table_function(checksum_numbers)
    files = corpus.files(spark, sf).select("file_path", "content")
    found = files.lateralJoin(matches(F.col("file_path").outer(), F.col("content").outer()))
    return found.select("file_path", "line_start", F.length("secret").cast("long").alias("digits"))


@query("model_classifier", o.with_(
    o.FILES, o.LINES, o.line_hits(),
    select="SELECT file_path, rule, line_start, match_ord, CASE doc_id % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 ELSE "
           f"round({o.rule_confidence('type', 'file_path', 'line')}, 6) END AS class_confidence, "
           "CASE doc_id % 3 WHEN 0 THEN 'api_key' WHEN 1 THEN 'unknown' ELSE type END AS label, "
           "CASE doc_id % 3 WHEN 0 THEN 'LLM analysis' WHEN 1 THEN 'LLM parsing error' ELSE 'Rule-based classification for ' || type END AS reasoning "
           "FROM line_hits"))
def model_classifier(spark, sf):
    reply = F.when(F.col("doc_id") % 3 == 0, '{"confidence": 0.25, "secret_type": "api_key"}').when(
        F.col("doc_id") % 3 == 1, "sorry, no")
    hits = D.scan_lines(corpus.files(spark, sf), COMMIT_PACK).withColumn("llm_reply", reply)
    return get_classifier("llm")(hits).select(
        "file_path", "rule", "line_start", "match_ord", F.round("class_confidence", 6).alias("class_confidence"), "label", "reasoning")
