"""Building blocks of the check SQL for DuckDB, written independently of the Spark expressions."""

from __future__ import annotations

import re

from secret_audit.checks import corpus
from secret_audit.rules import COMMIT_PACK, CONTENT_PACK, PLUGIN_PACK

# The same character sets in RE2 syntax.
RE2_SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_BODIES = {"s": RE2_SPACE, "w": r"\p{L}\p{N}_", "d": r"\p{Nd}"}


def lit(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


# A bracketed class, an escape or any other character.
_TOKEN = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]|\\.|.", re.DOTALL)
_ITEM = re.compile(r"\\.|.", re.DOTALL)


def _spelled_out(pattern: str) -> str:
    """The shorthand classes as character sets. The engine writes patterns from their parsed tree, so the two can differ."""
    def token(m: re.Match) -> str:
        t = m.group()
        if t[0] == "[":
            return "".join(_BODIES.get(x[1:], x) if x[0] == "\\" else "\\[" if x == "[" and i else x for i, x in enumerate(_ITEM.findall(t)))
        return f"[{_BODIES[t[1:]]}]" if t[1:] in _BODIES else f"[^{_BODIES[t[1:].lower()]}]" if t[0] == "\\" and t[1:].lower() in _BODIES else t

    return _TOKEN.sub(token, pattern)


def re2(pattern: str, ignore_case: bool = True) -> str:
    """SQL literal of a Python pattern in RE2 syntax."""
    return lit(("(?i)" if ignore_case else "") + _spelled_out(pattern))


def nl(expr: str) -> str:
    return f"(length({expr}) - length(replace({expr}, chr(10), '')))"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


FILES = corpus.files_cte()
SIGHTINGS = corpus.sightings_cte()
SCANS = corpus.scans_cte()
REPO_SCANS = corpus.repo_scans_cte()


def rule_fields(i: int, r) -> str:
    return (
        f"{i} AS rule_ord, {lit(r.name)} AS rule, {lit(r.kind)} AS type, {lit(r.severity)} AS severity, "
        f"CAST({r.confidence} AS DOUBLE) AS confidence, {lit(r.mask)} AS mask, {lit(r.description)} AS description, "
        f"{lit(r.remediation)} AS remediation"
    )


def content_hits(name: str = "hits", source: str = "files", rules=CONTENT_PACK, columns: str = "doc_id, repo, commit_sha, file_path") -> str:
    """Whole-text matches with their lines."""
    branches = []
    for i, r in enumerate(rules):
        p = re2(r.pattern)
        branches.append(
            f"SELECT {columns}, {rule_fields(i, r)}, regexp_extract_all(content, {p}) AS m, "
            f"regexp_split_to_array(content, {p}) AS g FROM {source} WHERE regexp_matches(content, {p})"
        )
    before = nl("array_to_string(g[1:i + 1], '')") + " + " + nl("array_to_string(m[1:i], '')")
    keep = columns + ", rule_ord, rule, type, severity, confidence, mask, description, remediation"
    return (
        f"{name} AS MATERIALIZED (SELECT {keep}, CAST(i AS INTEGER) AS match_ord, m[i + 1] AS secret, "
        f"CAST(1 + {before} AS INTEGER) AS line_start, "
        f"CAST(1 + {before} + {nl('m[i + 1]')} AS INTEGER) AS line_end "
        f"FROM (SELECT *, unnest(range(len(m))) AS i FROM ({' UNION ALL '.join(branches)})))"
    )


LINES = (
    "lines AS MATERIALIZED (SELECT doc_id, repo, commit_sha, file_path, "
    "CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INTEGER) AS line_no, "
    "unnest(string_split(content, chr(10))) AS line FROM files)"
)


def line_hits(name: str = "line_hits", rules=COMMIT_PACK) -> str:
    """Per-line matches of a pack."""
    branches = [
        f"SELECT doc_id, repo, commit_sha, file_path, line_no AS line_start, line, {rule_fields(i, r)}, "
        f"regexp_extract_all(line, {re2(r.pattern)}) AS m FROM lines"
        for i, r in enumerate(rules)
    ]
    return (
        f"{name} AS MATERIALIZED (SELECT * EXCLUDE (m, i), CAST(i AS INTEGER) AS match_ord, m[i + 1] AS secret FROM "
        f"(SELECT *, unnest(range(len(m))) AS i FROM ({' UNION ALL '.join(branches)})))"
    )


def entropy(s: str) -> str:
    """Shannon entropy of a string expression, 0 for the empty string."""
    p = f"(CAST(length({s}) - length(replace({s}, c, '')) AS DOUBLE) / length({s}))"
    return f"coalesce(list_sum(list_transform(list_distinct(string_split({s}, '')), lambda c: -{p} * log2({p}))), 0.0)"


CANDIDATES = (
    "candidates AS MATERIALIZED (SELECT *, " + entropy("secret") + " AS entropy FROM (SELECT * EXCLUDE (m, i), "
    "CAST(i AS INTEGER) AS match_ord, m[i + 1] AS secret FROM (SELECT *, unnest(range(len(m))) AS i FROM "
    "(SELECT *, line_no AS line_start, regexp_extract_all(line, '[A-Za-z0-9+/=_-]{20,}') AS m FROM lines))))"
)

# The same as in functions/entropy.py and functions/context.py, stated again for the checks, here and below.
FP_SHAPES = (
    "^[0-9]+$", "^[A-Z]+$", "^[a-z]+$", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "^[0-9]{2}:[0-9]{2}:[0-9]{2}$",
    r"^[0-9]+\.[0-9]+\.[0-9]+$", "^[A-Za-z0-9]{8}-[A-Za-z0-9]{4}-[A-Za-z0-9]{4}-[A-Za-z0-9]{4}-[A-Za-z0-9]{12}$",
)


def false_positive(s: str) -> str:
    shapes = " OR ".join(f"regexp_matches({s}, {lit(p)})" for p in FP_SHAPES)
    return f"({shapes} OR len(list_distinct(string_split({s}, ''))) < length({s}) * 0.3)"


def starts_like_rule(s: str) -> str:
    shapes = (
        "AKIA[0-9A-Z]{16}", "gh[ops]_[A-Za-z0-9_]{36}", r"https://hooks\.slack\.com/services/",
        r"eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*", r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----",
    )
    return "(" + " OR ".join(f"regexp_matches({s}, {lit('(?i)^(?:' + p + ')')})" for p in shapes) + ")"


def score(s: str, e: str) -> str:
    return (
        f"CASE WHEN length({s}) < 10 THEN 0.0 ELSE {e} "
        f"+ CASE WHEN regexp_matches({s}, '[a-z]') AND regexp_matches({s}, '[A-Z]') THEN 0.1 ELSE 0.0 END "
        f"+ CASE WHEN regexp_matches({s}, '[0-9]') THEN 0.1 ELSE 0.0 END "
        f"+ CASE WHEN regexp_matches({s}, '[+/=_-]') THEN 0.1 ELSE 0.0 END END"
    )


def mask(s: str, kind: str) -> str:
    n = f"length({s})"
    stars = f"repeat('*', {n})"
    return (
        f"CASE {kind} "
        f"WHEN 'aws' THEN CASE WHEN {n} >= 4 THEN {s}[1:4] || repeat('*', {n} - 4) ELSE {stars} END "
        f"WHEN 'url' THEN CASE WHEN contains({s}, '://') THEN split_part({s}, '://', 1) || '://***' ELSE {stars} END "
        f"WHEN 'bearer' THEN CASE WHEN starts_with({s}, 'Bearer ') THEN 'Bearer ' || repeat('*', {n} - 7) ELSE {stars} END "
        f"WHEN 'jwt' THEN CASE WHEN len(string_split({s}, '.')) >= 3 THEN split_part({s}, '.', 1) || '.' || "
        f"repeat('*', length(split_part({s}, '.', 2))) || '.' || repeat('*', length(split_part({s}, '.', 3))) ELSE {stars} END "
        f"WHEN 'pem' THEN '-----BEGIN PRIVATE KEY-----***' "
        f"WHEN 'db' THEN CASE WHEN contains({s}, '://') AND contains({s}, '@') THEN split_part({s}, '://', 1) || '://***@' || "
        f"split_part(string_split({s}, '@')[-1], '/', 1) || '/***' ELSE {stars} END "
        f"ELSE CASE WHEN {n} <= 8 THEN {stars} ELSE {s}[1:4] || repeat('*', {n} - 8) || right({s}, 4) END END"
    )


def any_of(expr: str, words, fn: str = "contains") -> str:
    return "(" + " OR ".join(f"{fn}({expr}, {lit(w)})" for w in words) + ")"


def context_flags(path: str, line: str) -> list[tuple[str, str, str]]:
    p, t = f"lower({path})", f"lower({line})"
    env = (r"export\s+\w+=", r"ENV\s+\w+", r"process\.env\.", r"os\.environ\.", r"getenv\(", r"System\.getenv\(")
    hard = (r"[\"']\w+[\"']\s*[:=]\s*[\"']", r"const\s+\w+\s*=\s*[\"']", r"let\s+\w+\s*=\s*[\"']", r"var\s+\w+\s*=\s*[\"']")

    def rx(patterns):
        return "(" + " OR ".join(f"regexp_matches({line}, {re2(x)})" for x in patterns) + ")"

    return [
        ("allowlisted_path", "-0.3", any_of(p, ("/tests/", "/examples/", "/fixtures/"))),
        ("denylist_pattern", "-0.4", any_of(p, ("dummy", "example", "test", "mock"))),
        ("test_content", "-0.2", any_of(t, ("test", "mock", "fake", "dummy", "sample", "example", "placeholder"))),
        ("example_content", "-0.3", any_of(t, ("example", "sample", "demo", "placeholder", "your_", "replace_", "change_", "update_"))),
        ("config_file", "0.1", "(" + any_of(p, (".conf", ".config", ".cfg", ".ini", ".yaml", ".yml", ".json", ".toml"), "ends_with")
         + " OR " + any_of(p, ("config", "settings", "secrets", "credentials", "env")) + ")"),
        ("source_file", "0.05", any_of(path, (".py", ".js", ".ts", ".java", ".go", ".rs", ".cpp", ".c", ".cs"), "ends_with")),
        ("documentation_file", "-0.2", "(" + any_of(p, (".md", ".txt", ".rst", ".doc", ".docx"), "ends_with")
         + " OR " + any_of(p, ("readme", "changelog", "license", "contributing")) + ")"),
        ("commented_secret", "-0.1", f"regexp_matches({line}, {lit('^[' + RE2_SPACE + ']*(#|//|/[*])')})"),
        ("env_var_pattern", "0.1", rx(env)),
        ("hardcoded_secret", "0.15", rx(hard)),
    ]


def adjustment(path: str, line: str) -> str:
    return "(0.0::DOUBLE" + "".join(
        f" + CASE WHEN {flag} THEN ({delta})::DOUBLE ELSE 0.0::DOUBLE END" for _, delta, flag in context_flags(path, line)
    ) + ")"


def reason(path: str, line: str) -> str:
    parts = ", ".join(f"CASE WHEN {flag} THEN {lit(name)} END" for name, _, flag in context_flags(path, line))
    return f"coalesce(nullif(concat_ws(', ', {parts}), ''), 'no_context_indicators')"


def clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def rule_confidence(kind: str, path: str, line: str) -> str:
    return clamp(
        f"(CASE WHEN {kind} IN ('aws_access_key','aws_secret_key','slack_webhook','github_token','rsa_private_key') THEN 0.9::DOUBLE "
        f"WHEN {kind} IN ('bearer_token','jwt_token','postgres_url','mysql_url','mongodb_url') THEN 0.7::DOUBLE "
        f"WHEN {kind} IN ('generic_token','api_key','password') THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END "
        f"* CASE WHEN contains(lower({path}), '/test') THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END "
        f"* CASE WHEN contains(lower({line}), 'example') THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END "
        f"* CASE WHEN contains(lower({path}), 'config') THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END)"
    )


RAW_FINDINGS = (
    "raw_findings AS MATERIALIZED (SELECT *, concat('scan-', repo) AS scan_id, 'regex' AS engine, "
    "sha256(secret) AS fingerprint, sha256(secret || ':' || line_start || ':' || line_end) AS evidence_hash, "
    + mask("secret", "mask") + " AS masked_preview, "
    "sha256(concat_ws('|', concat('scan-', repo), file_path, type, line_start, rule_ord, match_ord, sha256(secret))) AS id "
    "FROM hits)"
)
MERGED = (
    "merged AS MATERIALIZED (SELECT * FROM raw_findings QUALIFY row_number() OVER "
    "(PARTITION BY scan_id, file_path, line_start, type ORDER BY rule_ord, match_ord) = 1)"
)
FINDINGS = (
    "findings AS MATERIALIZED (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'NEW' WHEN 1 THEN 'ACKNOWLEDGED' "
    "WHEN 2 THEN 'RESOLVED' ELSE 'FALSE_POSITIVE' END AS status, timestamp '2024-01-01' + to_minutes(doc_id) AS created_at, "
    "timestamp '2024-01-01' + to_minutes(doc_id) AS first_seen_at, "
    "timestamp '2024-01-01' + to_minutes(doc_id * 3) AS last_seen_at FROM merged)"
)
BASE = (FILES, content_hits(), RAW_FINDINGS, MERGED, FINDINGS)
COMMIT_BASE = (FILES, LINES, line_hits("line_hits", COMMIT_PACK), CANDIDATES)
PLUGIN_BASE = (FILES, LINES, line_hits("line_hits", PLUGIN_PACK), CANDIDATES)


def on_findings(select: str, *more: str) -> str:
    return with_(*BASE, *more, select=select)


def risk(weight_of: str = "severity", confidence: str = "confidence") -> str:
    return (
        f"least(100.0, sum(CASE {weight_of} WHEN 'CRITICAL' THEN 10.0 WHEN 'HIGH' THEN 7.0 WHEN 'MEDIUM' THEN 4.0 ELSE 1.0 END "
        f"* coalesce({confidence}, 0.5)) / (count(*) * 10.0) * 100.0)"
    )
