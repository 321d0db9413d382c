"""Shannon entropy and the filters around it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from secret_audit.functions.patterns import to_java

# Fixed values.
CANDIDATE_CHARS = r"[A-Za-z0-9+/=_-]"
ENTROPY_THRESHOLD = 4.5
MIN_LENGTH = 20
MIN_CONFIDENCE = 0.3
FALSE_POSITIVE_SHAPES = (
    r"^[0-9]+$",
    r"^[A-Z]+$",
    r"^[a-z]+$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    r"^[0-9]{2}:[0-9]{2}:[0-9]{2}$",
    r"^[0-9]+\.[0-9]+\.[0-9]+$",
    r"^[A-Za-z0-9]{8}-[A-Za-z0-9]{4}-[A-Za-z0-9]{4}-[A-Za-z0-9]{4}-[A-Za-z0-9]{12}$",
)
RULE_SHAPES = (
    r"AKIA[0-9A-Z]{16}",
    r"gh[ops]_[A-Za-z0-9_]{36}",
    r"https://hooks\.slack\.com/services/",
    r"eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*",
    r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----",
)


def token_pattern(min_length: int = MIN_LENGTH) -> str:
    return f"{CANDIDATE_CHARS}{{{min_length},}}"


def candidate_pattern(min_length: int = MIN_LENGTH) -> str:
    return to_java(token_pattern(min_length), ignore_case=False)


def _distinct_chars(s: Column) -> Column:
    return F.array_distinct(F.split(s, ""))


def shannon_entropy(s: Column) -> Column:
    """Bits per character; 0 for the empty string.

    The characters are sorted and each run of equal ones counted once.
    """
    n = F.length(s)
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(s, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))

    def subtract_term(acc: Column, run: Column) -> Column:
        p = F.length(run) / n
        return acc - p * F.log2(p)

    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(runs, F.lit(0.0), subtract_term))


def passes(entropy: Column, threshold: float = ENTROPY_THRESHOLD) -> Column:
    """Threshold test that ignores the last-digit noise of the logarithm."""
    return F.round(entropy, 12) >= F.lit(threshold)


def likely_secret_score(s: Column, entropy: Column) -> Column:
    """Entropy plus 0.1 for mixed case, a digit and a symbol; 0 below ten characters."""
    mixed = s.rlike(r"\p{javaLowerCase}") & s.rlike(r"\p{javaUpperCase}")
    digit = s.rlike(r"\p{Nd}")
    symbol = s.rlike(r"[+/=_-]")
    boost = F.lit(0.0)
    for flag in (mixed, digit, symbol):
        boost = boost + F.when(flag, 0.1).otherwise(0.0)
    return F.when(F.length(s) < 10, F.lit(0.0)).otherwise(entropy + boost)


def is_false_positive(s: Column) -> Column:
    shape = F.lit(False)
    for pattern in FALSE_POSITIVE_SHAPES:
        # Python's $ also accepts one trailing line feed, as Java's does under the d flag.
        shape = shape | s.rlike("(?d)" + pattern)
    # Splitting '' yields one empty piece, so the empty string is decided by its length.
    few = (F.length(s) > 0) & (F.size(_distinct_chars(s)) < F.length(s) * F.lit(0.3))
    return shape | few


def entropy_confidence(entropy: Column) -> Column:
    return F.least(F.lit(0.9), entropy / F.lit(6.0))


def starts_like_rule(s: Column) -> Column:
    """The candidate begins with the shape of a known rule."""
    hit = F.lit(False)
    for pattern in RULE_SHAPES:
        java = to_java(pattern)
        flags, body = java[: java.index(")") + 1], java[java.index(")") + 1 :]
        hit = hit | s.rlike(f"{flags}^(?:{body})")
    return hit
