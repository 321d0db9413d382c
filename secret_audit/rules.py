"""Rule packs as data."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secret_audit.functions.patterns import parse


@dataclass(frozen=True)
class Rule:
    """One detection rule.

    ``hints`` are lower-case literals of which every match contains at least one, ``min_length`` the shortest possible
    match; both only let the scan skip text early, and come from the pattern where they are not given. ``java_plain`` is the
    form for texts without letters that fold to ASCII. ``line`` and ``line_plain`` find in a whole text the matches in its
    lines; None where the pattern has no such form.
    """

    name: str
    kind: str
    confidence: float
    pattern: str
    severity: str = "LOW"
    mask: str = "generic"
    description: str = ""
    remediation: str = ""
    hints: tuple[str, ...] = ()
    min_length: int = 0
    java: str = field(init=False, default="")
    java_plain: str = field(init=False, default="")
    line: str | None = field(init=False, default=None)
    line_plain: str | None = field(init=False, default=None)

    def __post_init__(self):
        found = parse(self.pattern)
        forms = {"java": found.java, "java_plain": found.plain, "line": found.line, "line_plain": found.line_plain}
        forms |= {"hints": tuple(h.lower() for h in self.hints) or found.literals, "min_length": self.min_length or found.min_length}
        for name, value in forms.items():
            object.__setattr__(self, name, value)


# Whole-content pack, scanned over the file text as one string.
CONTENT_PACK = (
    Rule("aws_access_key", "aws_access_key", 0.9, r"AKIA[0-9A-Z]{16}", "HIGH", "aws",
         "AWS Access Key ID",
         "Rotate the AWS access key immediately and update all references.", ("akia",), 20),
    Rule("aws_secret_key", "aws_secret_key", 0.95,
         r"aws(.{0,20})?(secret|access).{0,20}['\"][0-9a-zA-Z/+=]{40}['\"]", "CRITICAL", "generic",
         "AWS Secret Access Key",
         "Rotate the AWS secret key immediately and update all references.", ("aws",), 51),
    Rule("google_api_key", "google_api_key", 0.9, r"AIza[0-9A-Za-z\-_]{35}", "HIGH", "generic",
         "Google API Key",
         "Regenerate the Google API key and update all references.", ("aiza",), 39),
    Rule("slack_token", "slack_token", 0.9, r"xox[baprs]-[0-9a-zA-Z]{10,48}", "HIGH", "generic",
         "Slack Token",
         "Revoke the Slack token and generate a new one.", ("xox",), 15),
    Rule("github_token", "github_token", 0.9, r"ghp_[0-9a-zA-Z]{36}", "HIGH", "generic",
         "GitHub Personal Access Token",
         "Revoke the GitHub token and generate a new one.", ("ghp_",), 40),
    Rule("private_key", "private_key", 0.95,
         r"-----BEGIN (?:RSA|EC|DSA|OPENSSH) PRIVATE KEY-----", "CRITICAL", "pem",
         "Private Key",
         "Remove the private key from the repository and use secure key management.", ("private key",), 30),
    Rule("password_env", "password", 0.7, r"password\s*[:=]\s*['\"][^'\"]{6,}['\"]", "MEDIUM", "generic",
         "Password in Environment Variable",
         "Use environment variables or secure secret management instead of hardcoded passwords.",
         ("password",), 17),
    Rule("stripe_key", "stripe_key", 0.95, r"sk_live_[0-9a-zA-Z]{24}", "CRITICAL", "generic",
         "Stripe Live Secret Key",
         "Regenerate the Stripe key and update all references.", ("sk_live_",), 32),
    Rule("twilio_token", "twilio_token", 0.8, r"[0-9a-fA-F]{32}", "HIGH", "generic",
         "Twilio Token",
         "Regenerate the Twilio token and update all references.", (), 32),
    Rule("jwt_secret", "jwt_secret", 0.8, r"jwt.{0,20}secret.{0,20}['\"][^'\"]{16,}['\"]", "HIGH", "generic",
         "JWT Secret",
         "Use a strong, randomly generated JWT secret and store it securely.", ("jwt",), 27),
)

_DB_TAIL = r"://[^:\s]+:[^@\s]+@[^/\s]+/[^\s]+"

# Per-line packs.
_AWS_ACCESS = Rule("aws_access_key", "aws_access_key", 0.9, r"AKIA[0-9A-Z]{16}", mask="aws", hints=("akia",), min_length=20)
_AWS_SECRET = Rule("aws_secret_key", "aws_secret_key", 0.8, r"[A-Za-z0-9/+=]{40}", min_length=40)
_GITHUB = Rule("github_token", "github_token", 0.9, r"gh[ops]_[A-Za-z0-9_]{36}",
               hints=("gho_", "ghp_", "ghs_"), min_length=40)
_SLACK_HOOK = Rule("slack_webhook", "slack_webhook", 0.9, r"https://hooks\.slack\.com/services/[A-Za-z0-9_/]+",
                   mask="url", hints=("hooks.slack.com",), min_length=34)
_JWT = Rule("jwt_token", "jwt_token", 0.8, r"eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*",
            mask="jwt", hints=("eyj",), min_length=5)
_RSA = Rule("rsa_private_key", "rsa_private_key", 0.95, r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----",
            mask="pem", hints=("-----begin",), min_length=27)
_BEARER = Rule("bearer_token", "bearer_token", 0.7, r"Bearer\s+[A-Za-z0-9\-._~+/]+=*",
               mask="bearer", hints=("bearer",), min_length=8)

COMMIT_PACK = (
    _AWS_ACCESS,
    _AWS_SECRET,
    Rule("gcp_service_account", "gcp_service_account", 0.7, r"\"type\":\s*\"service_account\"",
         hints=("service_account",), min_length=24),
    _SLACK_HOOK,
    _GITHUB,
    _BEARER,
    _JWT,
    _RSA,
    Rule("postgres_url", "postgres_url", 0.8, "postgres" + _DB_TAIL, mask="db", hints=("postgres://",), min_length=18),
    Rule("mysql_url", "mysql_url", 0.8, "mysql" + _DB_TAIL, mask="db", hints=("mysql://",), min_length=15),
    Rule("mongodb_url", "mongodb_url", 0.8, r"mongodb(?:\+srv)?" + _DB_TAIL, mask="db", hints=("mongodb",), min_length=17),
)

PLUGIN_PACK = (
    _AWS_ACCESS,
    _AWS_SECRET,
    _GITHUB,
    _SLACK_HOOK,
    _JWT,
    _RSA,
    Rule("database_url", "database_url", 0.8, r"(postgres|mysql|mongodb)(?:\+srv)?" + _DB_TAIL, mask="db",
         hints=("postgres", "mysql", "mongodb"), min_length=15),
    _BEARER,
)

PACKS = {"content": CONTENT_PACK, "commit": COMMIT_PACK, "plugin": PLUGIN_PACK}

RULE_SCHEMA = T.StructType([
    T.StructField("pack", T.StringType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("mask", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("remediation", T.StringType()),
])


def check_pack(rules) -> tuple[Rule, ...]:
    """Refuse duplicate rule names."""
    rules = tuple(rules)
    if len({r.name for r in rules}) != len(rules):
        raise ValueError("rule names must be unique within a pack")
    return rules


def rules_table(spark: SparkSession, packs: dict[str, tuple[Rule, ...]] | None = None) -> DataFrame:
    """The packs as a DataFrame."""
    names = [f.name for f in RULE_SCHEMA]
    rows = []
    for pack, rules in (packs or PACKS).items():
        for i, rule in enumerate(check_pack(rules)):
            record = asdict(rule) | {"pack": pack, "ord": i}
            rows.append(tuple(record[n] for n in names))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def java_reason(spark: SparkSession, pattern: str) -> str | None:
    """Why Java does not compile a pattern, or None: found on the driver instead of in a task."""
    try:
        spark.range(1).select(F.lit("").rlike(pattern)).first()
    except Exception as e:  # whatever the plan or the job reports
        return f"Java: {str(e).strip().splitlines()[0]}"
    return None


def compile_pack(spark: SparkSession, records: list[dict]) -> tuple[tuple[Rule, ...], list[dict]]:
    """Rules of a user pack and, beside them, the records that make none, each with a ``reason``.

    All patterns are compiled by Java in one small plan; only if that fails, they are tried one by one.
    """
    rules, rejects, names = [], [], set()
    for record in records:
        try:
            if record.get("name") in names:
                raise ValueError("a rule of this name came before")
            rules.append((Rule(**record), record))
            names.add(record["name"])
        except (TypeError, ValueError) as e:
            rejects.append(record | {"reason": str(e)})
    forms = lambda r: [x for x in dict.fromkeys((r.java, r.java_plain, r.line, r.line_plain)) if x]

    def failing(part: list) -> list:
        """The rules of a part that Java refuses, found by halves."""
        joined = "|".join(f"(?:{x})" for r, _ in part for x in forms(r) if "\\" not in x or not _refers(x))
        alone = [x for r, _ in part for x in forms(r) if "\\" in x and _refers(x)]
        if all(java_reason(spark, x) is None for x in ([joined] if joined else []) + alone):
            return []
        if len(part) == 1:
            return part
        middle = len(part) // 2
        return failing(part[:middle]) + failing(part[middle:])

    bad = failing(rules) if rules else []
    for r, record in bad:
        reason = next((why for why in (java_reason(spark, x) for x in forms(r)) if why), "Java: not compiled")
        rejects.append(record | {"reason": reason})
    gone = {r.name for r, _ in bad}
    return check_pack(r for r, _ in rules if r.name not in gone), rejects


def _refers(java: str) -> bool:
    """The pattern refers to a group by number, so it can't be joined with others."""
    return "(?:\\" in java


REJECT_SCHEMA = T.StructType([*RULE_SCHEMA, T.StructField("reason", T.StringType())])


def _records(spark: SparkSession, path: str) -> list[dict]:
    rows = spark.read.schema(RULE_SCHEMA).json(path).orderBy("ord", "name").toJSON().collect()  # a pack is a list on the driver
    return [json.loads(r) for r in rows]


def read_rules_with_rejects(spark: SparkSession, path: str) -> tuple[tuple[Rule, ...], DataFrame]:
    """A user pack from JSON lines with the columns of ``RULE_SCHEMA``, and the rules left out as a table with reasons.

    Missing fields take the rule defaults. A rule is left out where it lacks a name, kind, confidence or pattern, repeats a
    name, or its pattern is wrong, matches the empty text or has no Java form.
    """
    records = _records(spark, path)
    own = [{k: v for k, v in r.items() if k not in ("pack", "ord")} for r in records]
    rules, rejects = compile_pack(spark, own)
    columns = [f.name for f in REJECT_SCHEMA]
    return rules, spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rejects], REJECT_SCHEMA)


def read_rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """As ``read_rules_with_rejects``, but a rule that can't be used raises an error that names it and the reason."""
    rules, rejects = read_rules_with_rejects(spark, path)
    wrong = rejects.collect()
    if wrong:
        raise ValueError("; ".join(f"{r['name']}: {r['reason']}" for r in wrong))
    return rules
