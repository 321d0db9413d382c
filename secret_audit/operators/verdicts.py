"""Model verdicts: request batches out, verdict text in. Calling the model is outside Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secret_audit.operators.merge import first_per_key
from secret_audit.operators.numbering import sequence
from secret_audit.schemas import VERDICT
from secret_audit.sources.store import materialize

BATCH_SIZE = 5
CACHE_SECONDS = 3600
_SLOTS = 4

# Prompt text.
BATCH_SYSTEM = "You are a security expert analyzing code for secrets and vulnerabilities. Respond with JSON only."
BATCH_HEAD = """Analyze these code snippets for secrets and vulnerabilities. For each snippet, determine:
1. Is this a real secret or vulnerability? (true/false)
2. What type is it? (aws_access_key, github_token, password, etc.)
3. Severity level (CRITICAL, HIGH, MEDIUM, LOW)
4. Confidence (0.0-1.0)
5. Brief remediation advice
6. Reasoning

"""
BATCH_TAIL = """Respond with JSON array format:
[
  {
    "candidate_index": 0,
    "is_secret": true,
    "is_vulnerability": false,
    "type": "aws_access_key",
    "severity": "HIGH",
    "confidence": 0.9,
    "remediation": "Rotate the AWS access key immediately",
    "reasoning": "This appears to be a valid AWS access key format"
  }
]"""
TEXT_SYSTEM = (
    "You are a security expert. Analyze the provided text for secrets or vulnerabilities. Respond with JSON only."
)
TEXT_HEAD = 'Analyze this text for secrets or vulnerabilities:\n\nText: "'
TEXT_TAIL = """"

Respond with JSON:
{
  "is_secret": true/false,
  "is_vulnerability": true/false,
  "type": "secret_type_or_vulnerability",
  "severity": "CRITICAL/HIGH/MEDIUM/LOW",
  "confidence": 0.0-1.0,
  "remediation": "brief_remediation_advice",
  "reasoning": "brief_explanation"
}"""
SECRET_SYSTEM = "You are a security expert analyzing potential secrets. Respond with JSON only."
SECRET_HEAD = "\nAnalyze this potential secret and determine if it's a real security risk.\n\n"
SECRET_TAIL = """
Consider:
1. Is this a real secret or a placeholder/example?
2. What's the confidence level (0.0-1.0)?
3. What type of secret is it?

Respond with JSON:
{
    "is_secret": true/false,
    "confidence": 0.0-1.0,
    "secret_type": "aws_access_key|github_token|etc",
    "reasoning": "brief explanation"
}
"""

# Defaults of a verdict with missing fields, and the verdict used when none can be read.
DEFAULTS = {
    "is_secret": False,
    "is_vulnerability": False,
    "type": "unknown",
    "severity": "LOW",
    "confidence": 0.5,
    "remediation": "Review and secure this item",
    "reasoning": "No reasoning provided",
}
FALLBACK = DEFAULTS | {
    "confidence": 0.1,
    "remediation": "Manual review recommended",
    "reasoning": "MCP classification failed, manual review required",
}


def number_batches(findings: DataFrame, group: str = "scan_id", size: int = BATCH_SIZE, id_col: str = "id") -> DataFrame:
    """Adds batch_id and position: groups of ``size`` per scan in id order."""
    return (
        sequence(findings, group, id_col)
        .withColumn("batch_id", F.floor(F.col("seq") / size))
        .withColumn("position", (F.col("seq") % size).cast("int"))
        .drop("seq")
    )


def batch_requests(numbered: DataFrame, group: str = "scan_id") -> DataFrame:
    """One prompt per batch with its candidates numbered from 1, and the candidates' ids; a batch never exceeds the batch size."""
    snippet = F.col("context") if "context" in numbered.columns else F.lit("")
    block = F.concat(
        F.lit("Candidate "), F.col("position") + 1, F.lit(":\nFile: "), F.col("file_path"),
        F.lit("\nLine: "), F.col("line_start"), F.lit("\nContext: "), snippet, F.lit("\nSnippet: \n\n"),
    )
    blocks = F.sort_array(F.collect_list(F.struct("position", block.alias("block"))))
    prompt = F.concat(F.lit(BATCH_HEAD), F.array_join(F.col("_blocks.block"), ""), F.lit(BATCH_TAIL))
    return (
        numbered.groupBy(group, "batch_id").agg(
            blocks.alias("_blocks"), F.count("*").alias("candidates"),
            F.sort_array(F.collect_list(F.struct("position", "id")))["id"].alias("finding_ids"),
        )
        .select(group, "batch_id", "candidates", "finding_ids", F.lit(BATCH_SYSTEM).alias("system"), prompt.alias("prompt"))
    )


def text_prompt(text: Column) -> Column:
    return F.concat(F.lit(TEXT_HEAD), text, F.lit(TEXT_TAIL))


def secret_prompt(text: Column, path: Column, kind: Column) -> Column:
    return F.concat(
        F.lit(SECRET_HEAD), F.lit('Text: "'), text, F.lit('"\nFile: '), F.coalesce(path, F.lit("unknown")),
        F.lit("\nDetected as: "), F.coalesce(kind, F.lit("unknown")), F.lit("\n"), F.lit(SECRET_TAIL),
    )


def messages(system: str, prompt: Column) -> Column:
    """Conversation of a system and a user message."""
    def message(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(system)), message("user", prompt))


def _object(text: Column) -> Column:
    """The JSON object of a reply: the text itself, or the first item where the reply is a list."""
    first = F.try_element_at(F.from_json(text, "array<string>"), F.lit(1))
    return F.when(text.rlike(r"^\s*\["), first).otherwise(text)


def parse_verdict(text: Column) -> Column:
    """Verdict struct from JSON text: missing fields take their defaults, unreadable text gives null.

    A number or truth value may be quoted; a list counts with its first item. A confidence that is no number makes the
    verdict unreadable.
    """
    kinds = {f.name: f.dataType for f in VERDICT}
    source = _object(text)
    parsed = F.from_json(source, ", ".join(f"{n} string" for n in DEFAULTS) + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    number = parsed["confidence"].isNull() | parsed["confidence"].try_cast("double").isNotNull()
    readable = F.coalesce(source.rlike(r"^\s*\{") & parsed["_bad"].isNull() & number, F.lit(False))
    fields = [F.coalesce(parsed[name].try_cast(kinds[name]), F.lit(value)).alias(name) for name, value in DEFAULTS.items()]
    return F.when(readable, F.struct(*fields))


def split_reply(reply: Column) -> Column:
    """Verdict texts of a batch reply: a JSON array, or an object with ``choices``; null for anything else."""
    choices = F.get_json_object(reply, "$.choices")
    array = F.when(reply.rlike(r"^\s*\["), reply).when(reply.rlike(r"^\s*\{"), choices)
    return F.from_json(array, "array<string>")


def reply_verdicts(replies: DataFrame, group: str = "scan_id", reply: str = "reply") -> DataFrame:
    """One row per verdict of each reply, by position."""
    texts = replies.select(group, "batch_id", F.posexplode(split_reply(F.col(reply))).alias("position", "json"))
    return texts


def verdicts_of_requests(requests: DataFrame, replies: DataFrame, group: str = "scan_id", reply: str = "reply") -> DataFrame:
    """(id, json): the verdict texts of the replies with the finding that each is about; what has no finding is left out."""
    asked = requests.select(group, "batch_id", F.posexplode("finding_ids").alias("position", "id"))
    return reply_verdicts(replies, group, reply).join(asked, [group, "batch_id", "position"]).select("id", "json")


def align_verdicts(numbered: DataFrame, verdicts: DataFrame, group: str = "scan_id", text: str = "json") -> DataFrame:
    """Every candidate with its verdict; a missing or unreadable one is replaced by the fallback.

    Verdicts that carry the finding's ``id`` are joined by it, others by batch and position.
    """
    keys = ["id"] if "id" in verdicts.columns else [group, "batch_id", "position"]
    fallback = F.struct(*[F.lit(v).alias(k) for k, v in FALLBACK.items()])
    # A reply that was stored twice counts once; readable texts come before others.
    texts = verdicts.groupBy(*keys).agg(F.min_by(text, F.struct(parse_verdict(F.col(text)).isNull(), text)).alias(text))
    read = texts.select(*keys, parse_verdict(F.col(text)).alias("_read"))
    return (
        numbered.join(read, keys, "left")
        .withColumn("verdict", F.coalesce("_read", fallback)).drop("_read")
    )


def apply_verdicts(judged: DataFrame) -> DataFrame:
    """Findings the model confirmed; the type stays the rule's type."""
    v = F.col("verdict")
    return judged.where(v["is_secret"] | v["is_vulnerability"]).withColumns({
        "severity": v["severity"],
        "confidence": v["confidence"],
        "description": F.concat("description", F.lit(" (MCP verified)")),
        "remediation": v["remediation"],
        "classification_reason": v["reasoning"],
        "engine": F.lit("mcp"),
    }).drop("verdict")


def parse_classification(text: Column) -> Column:
    """Reply of the single-secret prompt as confidence, label and reasoning."""
    source = F.trim(_object(text))
    parsed = F.from_json(
        source, "confidence string, secret_type string, reasoning string, _bad string", {"columnNameOfCorruptRecord": "_bad"}
    )
    confidence = parsed["confidence"].try_cast("double")
    number = parsed["confidence"].isNull() | confidence.isNotNull()
    ok = F.coalesce(source.rlike(r"^\s*\{") & parsed["_bad"].isNull() & number, F.lit(False))

    def either(value, default, failed):
        return F.when(ok, F.coalesce(value, F.lit(default))).otherwise(F.lit(failed))

    return F.struct(
        either(confidence, 0.5, 0.5).alias("confidence"),
        either(parsed["secret_type"], "unknown", "unknown").alias("label"),
        either(parsed["reasoning"], "LLM analysis", "LLM parsing error").alias("reasoning"),
    )


def cache_key(prompt: Column, model: Column, provider: Column) -> Column:
    return F.md5(F.concat_ws("_", prompt, model, provider))


def reuse_responses(requests: DataFrame, cache: DataFrame, ttl_seconds: int = CACHE_SECONDS) -> DataFrame:
    """Requests with the newest response to an equal request that was stored before, less than the lifetime ago, else null.

    Answers and requests of a key meet in slots of a quarter of the lifetime, so a key that is asked all the time is spread
    over many groups; each answer enters the slots that it can serve. Within a slot one pass in time order suffices.
    """
    width = max(1, ttl_seconds * 1_000_000 // _SLOTS)
    at, ttl = F.unix_micros("_t"), ttl_seconds * 1_000_000
    served = F.sequence(F.floor(at / width), F.floor((at + ttl) / width))
    answers = cache.select("cache_key", F.col("stored_at").alias("_t"), F.col("response").alias("_answer")).withColumn("_slot", F.explode(served))
    asked = requests.withColumn("_t", F.col("ts")).withColumn("_slot", F.floor(at / width)).withColumn("_asked", F.lit(1))
    both = asked.unionByName(answers.withColumn("_asked", F.lit(0)), allowMissingColumns=True)
    stored = F.when(F.col("_asked") == 0, F.struct(at.alias("t"), F.col("_answer").alias("response")))
    order = Window.partitionBy("cache_key", "_slot").orderBy("_t", "_asked", "_answer").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last(stored, ignorenulls=True).over(order)).where("_asked = 1")
    fresh = at - F.col("_last.t") < ttl
    return found.withColumn("response", F.when(fresh, F.col("_last.response"))).select(*requests.columns, "response")


def uncached(requests: DataFrame, cache: DataFrame, ttl_seconds: int = CACHE_SECONDS) -> DataFrame:
    """Requests that need a model call: those without a response, but not those that the answer to such a call serves.

    Per key the first request is asked, then the first one a lifetime or more after it, and so on. Every time of a key points
    to the first time a lifetime later, and the calls are what the first time leads to: they are found by doubling the
    pointers, so one key's requests spread over many tasks however many there are and however close together. Of requests
    at one time the one with the smallest id is asked. Requests without a time are not asked.
    """
    waiting = reuse_responses(requests, cache, ttl_seconds).where(F.col("response").isNull() & F.col("ts").isNotNull()).drop("response")
    waiting = materialize(waiting, "waiting-requests")
    times = materialize(waiting.select("cache_key", F.unix_micros("ts").alias("t")).distinct(), "request-times")
    jumps = materialize(_next_times(times, ttl_seconds * 1_000_000), "request-jumps")
    reached = materialize(times.groupBy("cache_key").agg(F.min("t").alias("t")), "request-calls")
    new = reached
    while True:
        # Jumps of 2^n calls from all calls found so far lead to the next 2^n.
        new = reached.join(jumps, ["cache_key", "t"]).select("cache_key", F.col("to").alias("t"))
        new = materialize(new.join(reached, ["cache_key", "t"], "left_anti").distinct(), "request-calls")
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        twice = jumps.join(jumps.select("cache_key", F.col("t").alias("to"), F.col("to").alias("_then")), ["cache_key", "to"])
        jumps = materialize(twice.select("cache_key", "t", F.col("_then").alias("to")), "request-jumps")
    calls = reached.select("cache_key", F.timestamp_micros("t").alias("ts"))
    return first_per_key(waiting.join(calls, ["cache_key", "ts"]), ["cache_key", "ts"], ["request_id"]).select(*waiting.columns)


def _next_times(times: DataFrame, ttl: int) -> DataFrame:
    """cache_key, t and the first time ``to`` of the key that is ``ttl`` or more later, where there is one.

    Times and the moments a lifetime after them are sorted in ranges, so a key may span many. Inside a range the next time
    is looked up in order; what finds none there takes the first one of the ranges behind.
    """
    events = times.select("cache_key", "t", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("origin")).unionByName(
        times.select("cache_key", (F.col("t") + ttl).alias("t"), F.lit(0).alias("kind"), F.col("t").alias("origin"))
    )
    order = ["cache_key", "t", "kind"]
    ranged = materialize(events.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "request-ranges")
    own = F.when(F.col("kind") == 1, F.col("t"))
    inside = Window.partitionBy("cache_key", "range").orderBy("t", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    behind = Window.partitionBy("cache_key").orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    firsts = ranged.groupBy("cache_key", "range").agg(F.min(own).alias("first"))
    firsts = firsts.select("cache_key", "range", F.min("first").over(behind).alias("after"))
    asked = ranged.withColumn("next", F.first(own, ignorenulls=True).over(inside)).where("kind = 0").join(firsts, ["cache_key", "range"])
    to = F.coalesce("next", "after")
    return asked.where(to.isNotNull()).select("cache_key", F.col("origin").alias("t"), to.alias("to"))


def first_user_message(turns: DataFrame, group: str = "conv_id") -> DataFrame:
    """The first user turn of each conversation that has one with text."""
    first = turns.where(F.col("role") == "user").groupBy(group).agg(
        F.min_by("text", "turn").alias("user_message")
    )
    return first.where(F.length("user_message") > 0)
