import json

from pyspark.sql import functions as F

from secret_audit.operators import verdicts as V


def parse(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(V.parse_verdict(F.col("t"))).collect()]


def test_parse_verdict_defaults_and_failures(spark):
    full = {"is_secret": True, "is_vulnerability": False, "type": "k", "severity": "HIGH", "confidence": 0.9, "remediation": "r", "reasoning": "w"}
    rows = parse(spark, [json.dumps(full), "{}", "text", "[1]", None, '{"confidence": 1, "extra": [1]}', "{broken"])
    assert rows[0].asDict() == full
    assert rows[1].asDict() == V.DEFAULTS
    assert rows[2] is None and rows[3] is None and rows[4] is None and rows[6] is None
    assert rows[5].confidence == 1.0 and rows[5].severity == "LOW"


def numbered(spark, n):
    df = spark.range(n).select(
        F.lit("s").alias("scan_id"), F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit("f").alias("file_path"),
        F.col("id").cast("int").alias("line_start"), F.lit("HIGH").alias("severity"), F.lit(0.9).alias("confidence"),
        F.lit("d").alias("description"), F.lit("r").alias("remediation"), F.lit("regex").alias("engine"), F.lit("t").alias("type"))
    return V.number_batches(df)


def test_batches_of_five(spark):
    rows = numbered(spark, 12).collect()
    assert sorted((r.batch_id, r.position) for r in rows) == [(i // 5, i % 5) for i in range(12)]
    requests = {r.batch_id: r for r in V.batch_requests(numbered(spark, 12)).collect()}
    assert {b: r.candidates for b, r in requests.items()} == {0: 5, 1: 5, 2: 2}
    assert requests[2].prompt.count("Candidate ") == 2 and "Candidate 1:\nFile: f\nLine: " in requests[2].prompt
    assert requests[0].prompt.startswith("Analyze these code snippets") and requests[0].prompt.endswith("}\n]")


def test_alignment_pads_and_drops_extra(spark):
    reply = json.dumps([{"is_secret": True, "confidence": 0.8, "severity": "CRITICAL"}, "not a verdict", {"is_vulnerability": True}] + [{}] * 9)
    replies = spark.createDataFrame([("s", 0, reply), ("s", 1, "down")], "scan_id string, batch_id long, reply string")
    judged = V.align_verdicts(numbered(spark, 7), V.reply_verdicts(replies)).collect()
    by = {(r.batch_id, r.position): r.verdict for r in judged}
    assert len(judged) == 7
    assert by[(0, 0)].is_secret and by[(0, 0)].remediation == "Review and secure this item"
    assert by[(0, 1)].asDict() == V.FALLBACK and by[(1, 0)].asDict() == V.FALLBACK
    assert by[(0, 2)].is_vulnerability and by[(0, 2)].confidence == 0.5
    applied = V.apply_verdicts(V.align_verdicts(numbered(spark, 7), V.reply_verdicts(replies))).collect()
    assert sorted((r.severity, r.confidence, r.type, r.description, r.engine) for r in applied) == [
        ("CRITICAL", 0.8, "t", "d (MCP verified)", "mcp"), ("LOW", 0.5, "t", "d (MCP verified)", "mcp")]


def test_classification_reply(spark):
    df = spark.createDataFrame([('{"confidence": 0.7, "secret_type": "x", "reasoning": "y"}',), ("{}",), ("oops",)], "t string")
    got = [tuple(r[0]) for r in df.select(V.parse_classification(F.col("t"))).collect()]
    assert got == [(0.7, "x", "y"), (0.5, "unknown", "LLM analysis"), (0.5, "unknown", "LLM parsing error")]


def test_cache_lifetime(spark):
    req = spark.sql("SELECT * FROM VALUES ('k', 1, timestamp'2024-01-01 01:00:00'), ('k', 2, timestamp'2024-01-01 00:59:59'), ('q', 3, timestamp'2024-01-01'), "
                    "('q', 4, timestamp'2024-01-02') AS t(cache_key, request_id, ts)")
    cache = spark.sql("SELECT * FROM VALUES ('k', 'old', timestamp'2023-12-31 00:00:00'), ('k', 'new', timestamp'2024-01-01 00:00:00') AS t(cache_key, response, stored_at)")
    got = {r.request_id: r.response for r in V.reuse_responses(req, cache).collect()}
    assert got == {1: None, 2: "new", 3: None, 4: None}
    # A day later the answer to request 3 has run out.
    assert sorted(r.request_id for r in V.uncached(req, cache).collect()) == [1, 3, 4]


def test_cache_as_of_the_request(spark):
    req = spark.sql("SELECT * FROM VALUES ('k', 1, timestamp'2024-01-01 00:10:00'), ('k', 2, timestamp'2024-01-01 00:50:00'), ('m', 3, timestamp'2024-01-01'), "
                    "('m', 4, timestamp'2024-01-01 00:59:59'), ('m', 5, timestamp'2024-01-01 01:00:00') AS t(cache_key, request_id, ts)")
    cache = spark.sql("SELECT * FROM VALUES ('k', 'a', timestamp'2024-01-01 00:00:00'), ('k', 'later', timestamp'2024-06-01 00:00:00'), "
                      "('k', 'b', timestamp'2024-01-01 00:50:00') AS t(cache_key, response, stored_at)")
    assert {r.request_id: r.response for r in V.reuse_responses(req, cache).collect()} == {1: "a", 2: "b", 3: None, 4: None, 5: None}
    assert sorted(r.request_id for r in V.uncached(req, cache).collect()) == [3, 5]


def test_quoted_numbers_and_lists(spark):
    rows = ['{"is_secret": "true", "confidence": "0.9"}', '[{"is_secret": true, "confidence": 1}]', '["{\\"confidence\\": 0.2}"]', '{"confidence": "high"}', "[]", "oops", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    got = {r.i: r.v and (r.v.is_secret, r.v.confidence) for r in df.select("i", V.parse_verdict(F.col("t")).alias("v")).collect()}
    assert got == {0: (True, 0.9), 1: (True, 1.0), 2: (False, 0.2), 3: None, 4: None, 5: None, 6: None}


def test_a_reply_stored_twice_counts_once(spark):
    numbered = spark.createDataFrame([("s", 0, 0, "x")], "scan_id string, batch_id long, position int, id string")
    replies = spark.createDataFrame([("s", 0, 0, "bad"), ("s", 0, 0, '{"confidence": 0.4}'), ("s", 0, 0, '{"confidence": 0.4}')],
                                    "scan_id string, batch_id long, position int, json string")
    assert [r.verdict.confidence for r in V.align_verdicts(numbered, replies).collect()] == [0.4]


def test_first_user_message(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 2, "user", "second"), (1, 1, "user", "first"), (2, 0, "user", ""), (3, 0, "assistant", "a")],
                               "conv_id int, turn int, role string, text string")
    assert [tuple(r) for r in V.first_user_message(df).collect()] == [(1, "first")]


def test_calls_of_a_hot_key(spark):
    """One key with nearly all requests, in bursts and far apart, beside one pass in time order."""
    import random
    from datetime import datetime, timedelta

    rnd, start, ttl = random.Random(4), datetime(2024, 1, 1), 600
    times = [rnd.choice([rnd.randint(0, 40_000), 5000 + rnd.randint(0, 30), 5600, 90_000]) for _ in range(600)]
    rows = [("k" if i % 30 else f"k{i % 7}", i, start + timedelta(seconds=t)) for i, t in enumerate(times)] + [("k", 1000, None)]
    req = spark.createDataFrame(rows, "cache_key string, request_id long, ts timestamp").repartition(4)
    cache = spark.createDataFrame([], "cache_key string, response string, stored_at timestamp")
    want, last = [], {}
    for key, i, ts in sorted((r for r in rows if r[2]), key=lambda r: (r[0], r[2], r[1])):
        if key not in last or (ts - last[key]).total_seconds() >= ttl:
            last[key] = ts
            want.append(i)
    got = V.uncached(req, cache, ttl)
    assert got.columns == req.columns and sorted(r.request_id for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
