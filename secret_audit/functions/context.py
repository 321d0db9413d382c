"""Context predicates over a path and a line, and the score they add up to."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from secret_audit.functions.patterns import to_java
from secret_audit.functions.regex import SPACE


@dataclass(frozen=True)
class ContextConfig:
    allowlist_paths: tuple[str, ...] = ("/tests/", "/examples/", "/fixtures/")
    denylist_patterns: tuple[str, ...] = ("dummy", "example", "test", "mock")
    min_confidence: float = 0.3


# Indicator words and extensions.
TEST_WORDS = ("test", "mock", "fake", "dummy", "sample", "example", "placeholder")
EXAMPLE_WORDS = ("example", "sample", "demo", "placeholder", "your_", "replace_", "change_", "update_")
CONFIG_EXTENSIONS = (".conf", ".config", ".cfg", ".ini", ".yaml", ".yml", ".json", ".toml")
CONFIG_NAMES = ("config", "settings", "secrets", "credentials", "env")
SOURCE_EXTENSIONS = (".py", ".js", ".ts", ".java", ".go", ".rs", ".cpp", ".c", ".cs")
DOC_EXTENSIONS = (".md", ".txt", ".rst", ".doc", ".docx")
DOC_NAMES = ("readme", "changelog", "license", "contributing")
COMMENT_MARKS = ("#", "//", "/*")
ENV_PATTERNS = (
    r"export\s+\w+=",
    r"ENV\s+\w+",
    r"process\.env\.",
    r"os\.environ\.",
    r"getenv\(",
    r"System\.getenv\(",
)
HARDCODED_PATTERNS = (
    r"[\"']\w+[\"']\s*[:=]\s*[\"']",
    r"const\s+\w+\s*=\s*[\"']",
    r"let\s+\w+\s*=\s*[\"']",
    r"var\s+\w+\s*=\s*[\"']",
)


def _words(words) -> str:
    return "|".join(re.escape(w) for w in words)


def _matches(text: Column, patterns) -> Column:
    return text.rlike("|".join(to_java(p) for p in patterns))


def is_commented(line: Column) -> Column:
    return line.rlike(f"^[{SPACE}]*({_words(COMMENT_MARKS)})")


def context_predicates(path: Column, line: Column, config: ContextConfig = ContextConfig()):
    """(reason, adjustment, predicate) in the order in which adjustments are added."""
    lower_path, lower_line = F.lower(path), F.lower(line)

    def named(extensions, names) -> Column:
        return lower_path.rlike(rf"({_words(extensions)})\z|{_words(names)}")

    return [
        ("allowlisted_path", -0.3, lower_path.rlike(_words(config.allowlist_paths))),
        ("denylist_pattern", -0.4, lower_path.rlike(_words(config.denylist_patterns))),
        ("test_content", -0.2, lower_line.rlike(_words(TEST_WORDS))),
        ("example_content", -0.3, lower_line.rlike(_words(EXAMPLE_WORDS))),
        ("config_file", 0.1, named(CONFIG_EXTENSIONS, CONFIG_NAMES)),
        ("source_file", 0.05, path.rlike(rf"({_words(SOURCE_EXTENSIONS)})\z")),
        ("documentation_file", -0.2, named(DOC_EXTENSIONS, DOC_NAMES)),
        ("commented_secret", -0.1, is_commented(line)),
        ("env_var_pattern", 0.1, _matches(line, ENV_PATTERNS)),
        ("hardcoded_secret", 0.15, _matches(line, HARDCODED_PATTERNS)),
    ]


def adjustment_of(predicates) -> Column:
    """Sum of adjustments as doubles, in a fixed order, because results sit on the 0.3 threshold."""
    total = F.lit(0.0)
    for _, delta, flag in predicates:
        total = total + F.when(flag, F.lit(delta)).otherwise(F.lit(0.0))
    return total


def reason_of(predicates) -> Column:
    reasons = F.concat_ws(", ", *[F.when(flag, name) for name, _, flag in predicates])
    return F.when(reasons == "", "no_context_indicators").otherwise(reasons)


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


# Base confidence by kind.
RULE_TIERS = {
    0.9: ("aws_access_key", "aws_secret_key", "slack_webhook", "github_token", "rsa_private_key"),
    0.7: ("bearer_token", "jwt_token", "postgres_url", "mysql_url", "mongodb_url"),
    0.5: ("generic_token", "api_key", "password"),
}
BASE_CONFIDENCE = 0.3


def rule_confidence(kind: Column, path: Column, line: Column) -> Column:
    """Rule-based classifier confidence."""
    base = F.lit(BASE_CONFIDENCE)
    for value, kinds in RULE_TIERS.items():
        base = F.when(kind.isin(*kinds), F.lit(value)).otherwise(base)
    lower_path = F.lower(path)
    factors = (
        (lower_path.contains("/test"), 0.5),
        (F.lower(line).contains("example"), 0.3),
        (lower_path.contains("config"), 1.2),
    )
    for flag, factor in factors:
        base = base * F.when(flag, F.lit(factor)).otherwise(F.lit(1.0))
    return clamp(base)
