"""Small text, time, band and cost expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secret_audit.functions.regex import SPACE


def decode_ignore(content: Column) -> Column:
    """Bytes to text, dropping undecodable bytes. A genuine U+FFFD is dropped too."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def decode_strict(content: Column) -> Column:
    """Bytes to text, null when they are not UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def decode_base64(blob: Column) -> Column:
    """Base64 file body, line breaks allowed, to text; null when it is not base64 or not UTF-8."""
    clean = F.regexp_replace(blob, "[\r\n]", "")
    return decode_strict(F.try_to_binary(clean, F.lit("base64")))


def location(path: Column, line: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"))


def display_name(kind: Column) -> Column:
    """First underscore becomes a space, upper case."""
    return F.upper(F.regexp_replace(kind, "^([^_]*)_", "$1 "))


def sarif_rule_id(kind: Column) -> Column:
    """First underscore becomes a hyphen."""
    return F.regexp_replace(kind, "^([^_]*)_", "$1-")


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH"), "error").when(severity == "MEDIUM", "warning").otherwise("note")


def iso_time(ts: Column) -> Column:
    """ISO text; the fraction appears only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(ts.cast("timestamp")) % 1_000_000
    return F.when(micros == 0, whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds, truncated."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return (micros / 1000).cast("long")


def word_count(text: Column) -> Column:
    """Whitespace-separated words; 0 for blank text."""
    words = F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))
    return F.size(words)


def repo_name(url: Column) -> Column:
    """Text between the first and second ``github.com/``, trailing slashes dropped; null when absent."""
    return F.when(
        url.contains("github.com/"), F.regexp_replace(F.get(F.split(url, r"github\.com/"), F.lit(1)), "/+$", "")
    )


def is_repo_url(url: Column) -> Column:
    return url.rlike(r"(?d)^https://github\.com/[^/]+/[^/]+/?$")


def risk_band(score: Column) -> Column:
    return F.when(score >= 80, "Critical").when(score >= 60, "High").when(score >= 40, "Medium").otherwise("Low")


def confidence_percent(confidence: Column) -> Column:
    return (confidence * 100).cast("int")


def confidence_band(confidence: Column) -> Column:
    p = confidence_percent(confidence)
    return F.when(p >= 80, "high").when(p >= 50, "medium").otherwise("low")


# Dollars per 1000 tokens, (input, output).
MODEL_PRICES = {
    "gpt-3.5-turbo": (0.0015, 0.002),
    "gpt-3.5-turbo-16k": (0.003, 0.004),
    "gpt-4": (0.03, 0.06),
    "gpt-4-turbo": (0.01, 0.03),
    "gemini-1.5-flash": (0.00075, 0.003),
    "gemini-1.0-pro": (0.0005, 0.0015),
    "gemini-1.5-pro": (0.00125, 0.005),
}


def price_table(spark: SparkSession) -> DataFrame:
    rows = [(m, i, o) for m, (i, o) in MODEL_PRICES.items()]
    return spark.createDataFrame(rows, "model string, input_per_1k double, output_per_1k double")


def with_cost(usage: DataFrame) -> DataFrame:
    """Adds ``cost_usd`` from model, prompt_tokens and completion_tokens; null for a model without a price."""
    # The price list is a fixed seven rows.
    priced = usage.join(F.broadcast(price_table(usage.sparkSession)), "model", "left")
    cost = (
        F.col("prompt_tokens") * F.col("input_per_1k") + F.col("completion_tokens") * F.col("output_per_1k")
    ) / 1000
    return priced.withColumn("cost_usd", cost).drop("input_per_1k", "output_per_1k")
