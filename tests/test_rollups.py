"""Rollups kept by deltas beside a new count of the whole table."""

import random

from pyspark.sql import functions as F

from secret_audit.operators import rollups as U

SCHEMA = "id string, created_at timestamp, repo string, severity string, status string, confidence double"


def rows_of(df):
    return sorted((str(r.day), str(r.repo), str(r.severity), r.status, r.findings, round(float(r.weighted), 6)) for r in df.collect())


def test_deltas_equal_a_new_count(spark, tmp_path):
    from datetime import datetime, timedelta

    rnd, base = random.Random(1), str(tmp_path / "rollup")
    state = {}
    for batch in range(7):
        new = [(f"f{batch}-{i}", datetime(2024, 1, 1) + timedelta(hours=rnd.randint(0, 90)), rnd.choice(["a", "b", None]), rnd.choice(["HIGH", "LOW", "ODD", None]), "NEW",
                rnd.choice([0.3, 0.9, None])) for i in range(rnd.randint(0, 30))]
        current = spark.createDataFrame(list(state.values()), SCHEMA)
        chosen = [(k, rnd.choice(["RESOLVED", "NEW", "ACKNOWLEDGED"])) for k in rnd.sample(sorted(state), len(state) // 3)] + [("unknown", "RESOLVED")]
        changes = U.partials(spark.createDataFrame(new, SCHEMA)).unionByName(U.status_partials(current, spark.createDataFrame(chosen, "id string, status string")))
        for _ in range(1 + batch % 2):  # a repeated batch replaces itself
            U.append_partials(changes, base, batch, compact_every=3)
        state.update({r[0]: r for r in new})
        state.update({k: (*state[k][:4], s, state[k][5]) for k, s in chosen if k in state})
        whole = spark.createDataFrame(list(state.values()), SCHEMA)
        assert rows_of(U.read_partials(spark, base)) == rows_of(U.fold_partials(U.partials(whole)))
    summed = U.rollup(U.read_partials(spark, base), ("status",))
    assert {r.status: r.findings_total for r in summed.collect()} == {r.status: r["count"] for r in whole.groupBy("status").count().collect()}
    assert U.read_partials(spark, str(tmp_path / "none")) is None
    plan = U.status_partials(whole, whole.select("id", F.lit("X").alias("status")))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Python" not in plan
