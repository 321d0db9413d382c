"""Masking, fingerprints and redaction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from secret_audit.functions.patterns import to_java


def stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n)


def mask_generic(s: Column) -> Column:
    """First and last four characters stay when there are more than eight."""
    n = F.length(s)
    return F.when(n <= 8, stars(n)).otherwise(
        F.concat(F.substring(s, 1, 4), stars(n - 8), F.substring(s, -4, 4))
    )


def mask_aws(s: Column) -> Column:
    n = F.length(s)
    return F.when(n >= 4, F.concat(F.substring(s, 1, 4), stars(n - 4))).otherwise(stars(n))


def mask_url(s: Column) -> Column:
    return F.when(s.contains("://"), F.concat(F.substring_index(s, "://", 1), F.lit("://***"))).otherwise(
        stars(F.length(s))
    )


def mask_bearer(s: Column) -> Column:
    n = F.length(s)
    return F.when(s.startswith("Bearer "), F.concat(F.lit("Bearer "), stars(n - 7))).otherwise(stars(n))


def mask_jwt(s: Column) -> Column:
    parts = F.split(s, r"\.")
    body = F.transform(F.slice(parts, 2, 2), lambda p: stars(F.length(p)))
    return F.when(
        F.size(parts) >= 3, F.concat_ws(".", F.element_at(parts, 1), body)
    ).otherwise(stars(F.length(s)))


def mask_pem(s: Column) -> Column:
    return F.when(s.isNotNull(), F.lit("-----BEGIN PRIVATE KEY-----***"))


def mask_db_url(s: Column) -> Column:
    """Protocol and host stay; the host follows the last ``@``."""
    host = F.substring_index(F.substring_index(s, "@", -1), "/", 1)
    shown = F.concat(F.substring_index(s, "://", 1), F.lit("://***@"), host, F.lit("/***"))
    return F.when(s.contains("://") & s.contains("@"), shown).otherwise(stars(F.length(s)))


MASKS = {
    "generic": mask_generic,
    "aws": mask_aws,
    "url": mask_url,
    "bearer": mask_bearer,
    "jwt": mask_jwt,
    "pem": mask_pem,
    "db": mask_db_url,
}


def mask_by_kind(secret: Column, kind: Column) -> Column:
    """Masked preview chosen by the rule's mask name; unknown names mask generically."""
    out = None
    for name, fn in MASKS.items():
        if name != "generic":
            out = F.when(kind == name, fn(secret)) if out is None else out.when(kind == name, fn(secret))
    return out.otherwise(mask_generic(secret))


def fingerprint(secret: Column) -> Column:
    return F.sha2(secret, 256)


def evidence_hash(text: Column, start: Column, end: Column) -> Column:
    return F.sha2(F.concat_ws(":", text, start.cast("string"), end.cast("string")), 256)


# Log redaction, applied in this order.
REDACTIONS = (
    ("api_key", r"api[_-]?key[\"\s]*[:=][\"\s]*([a-zA-Z0-9_-]{20,})"),
    ("token", r"token[\"\s]*[:=][\"\s]*([a-zA-Z0-9_-]{20,})"),
    ("secret", r"secret[\"\s]*[:=][\"\s]*([a-zA-Z0-9_-]{20,})"),
    ("password", r"password[\"\s]*[:=][\"\s]*([^\s]{8,})"),
)


def redact_text(text: Column) -> Column:
    for name, pattern in REDACTIONS:
        text = F.regexp_replace(text, to_java(pattern), f"{name}=***REDACTED***")
    return text


def redact_prefix(text: Column, keep: int = 8) -> Column:
    """First ``keep`` characters and dots; empty or missing values stay missing."""
    return F.when(F.length(text) > 0, F.concat(F.substring(text, 1, keep), F.lit("...")))
