import json
import shutil

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from secret_audit.sources import store
from secret_audit.sources.commits import read_commits
from secret_audit.streaming import findings as SF
from secret_audit.streaming import status as SS


def findings(spark, n=40):
    return spark.range(n).select(
        F.sha2(F.col("id").cast("string"), 256).alias("id"), F.when(F.col("id") < n - 3, "big").otherwise("small").alias("scan_id"),
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_path"), F.lit(0.5).alias("confidence"),
        F.expr("timestampadd(MICROSECOND, id, timestamp'2024-01-01 00:00:00')").alias("created_at"))


def test_raw_text_is_never_stored(spark, tmp_path):
    for column in ("secret", "content", "raw", "line"):
        df = findings(spark).withColumn(column, F.lit("x"))
        with pytest.raises(ValueError):
            store.append_findings(df, str(tmp_path / "f"))
        with pytest.raises(ValueError):
            store.materialize(df)


def test_documents_roundtrip_in_parts(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = store.finding_rows(findings(spark))
    store.write_finding_documents(rows, path, "2024-02-01 00:00:00", target=4)
    back = store.read_finding_documents(spark, path)
    key = ["id", "scan_id", "file_path", "created_at"]
    assert sorted(map(tuple, back.select(key).collect())) == sorted(map(tuple, rows.select(key).collect()))
    docs = spark.read.json(path)
    assert docs.where("scan_id = 'big'").count() > 1 and docs.where("scan_id = 'small'").count() == 1
    assert {r["count"] for r in docs.where("scan_id = 'big'").collect()} == {37}


def test_defaults_of_stored_rows(spark):
    row = store.finding_rows(findings(spark)).first()
    assert (row.repo, row.remediation, row.status, row.notes) == ("unknown", "", "NEW", "")


def test_snapshot_versions_and_incomplete_write(spark, tmp_path):
    base = str(tmp_path / "snap")
    assert store.read_snapshot(spark, base) is None
    store.write_snapshot(spark.range(3), base, 1)
    store.write_snapshot(spark.range(5), base, 2)
    (tmp_path / "snap" / "v0000000003").mkdir()
    assert store.read_snapshot(spark, base).count() == 5


def test_runs(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 'OK', timestamp'2024-01-01', CAST(null AS timestamp), timestamp'2024-01-01'), "
                   "('a', 'ERROR', null, timestamp'2024-01-02', timestamp'2024-01-02') AS t(id, status, started_at, ended_at, event_time)")
    r = store.current_runs(df).first()
    assert r.status == "ERROR" and str(r.started_at)[:10] == "2024-01-01" and str(r.ended_at)[:10] == "2024-01-02"


def test_commit_export(spark, tmp_path):
    def commit(repo, sha, day, *files):
        return json.dumps({"repo": repo, "sha": sha, "message": "m", "author": "a", "date": f"2024-01-{day:02d}T00:00:00Z", "files": [
            {"file_path": p, "status": s, "content": c} for p, s, c in files]})

    path = tmp_path / "commits.json"
    path.write_text("\n".join([
        commit("r", "a", 1, ("old.py", "added", "x")), commit("r", "b", 2, ("b.py", "modified", "x"), ("gone.py", "removed", None), ("i.PNG", "added", "x")),
        commit("r", "c", 2, ("c.py", "added", "yy"), ("empty.py", "added", "")), commit("q", "d", 1, ("d.py", "added", "z")),
    ]))
    rows = read_commits(spark, str(path), depth=2).collect()
    assert sorted((r.repo, r.commit_sha, r.file_path, r.size) for r in rows) == [("q", "d", "d.py", 1), ("r", "b", "b.py", 1), ("r", "c", "c.py", 2)]
    assert rows[0].metadata["file_status"] in ("added", "modified") and rows[0].metadata["date"].endswith("T00:00:00Z")
    assert {r.repo for r in read_commits(spark, str(path), since="2024-01-02", depth=2).collect()} == {"r"}


def stream_input(spark, tmp_path, days):
    """One Parquet file per day, so that the stream takes several batches."""
    folder = tmp_path / "in"
    for d in range(days):
        df = spark.range(30).select(
            F.lit("r").alias("repo"), F.concat(F.lit("p"), ((F.col("id") * (d + 3)) % (8 + d)).cast("string")).alias("fingerprint"), F.lit("f").alias("file_path"),
            F.expr(f"timestampadd(MINUTE, id, timestamp'2024-01-{d + 1:02d} 00:00:00')").alias("seen_at"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("commit_sha"),
            F.when(F.col("id") % 2 == 0, "HIGH").otherwise("LOW").alias("severity"),
            F.when(F.col("id") % 3 == 0, "RESOLVED").when(F.col("id") % 3 == 1, "NEW").otherwise("nonsense").alias("status"))
        df.coalesce(1).write.mode("append").parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    return spark.read.parquet(str(folder)), SF.read_new_files(spark, str(folder), schema, files_per_batch=1)


def test_streaming_upsert_with_compaction_equals_batch(spark, tmp_path):
    from secret_audit.operators.merge import lifecycle

    batch, stream = stream_input(spark, tmp_path, 7)
    base = str(tmp_path / "table")
    SF.run_upsert(stream, str(tmp_path / "cp"), base, compact_every=3)
    assert store._complete(spark, base, "v") == [2, 5] and store._complete(spark, base, "d") == list(range(7))
    cols = ["repo", "fingerprint", "file_path", "first_seen_at", "last_seen_at", "commit_sha", "status"]
    want = sorted(map(tuple, lifecycle(batch).select(cols).collect()))
    assert sorted(map(tuple, SF.read_lifecycle(spark, base).select(cols).collect())) == want
    # A batch that runs again after a failure leaves the table as it was.
    again = spark.read.parquet(store._folder(base, "d", 6))
    store.write_delta(store.materialize(again), base, 6)
    assert sorted(map(tuple, SF.read_lifecycle(spark, base).select(cols).collect())) == want


def test_streaming_status_equals_batch(spark, tmp_path):
    batch, stream = stream_input(spark, tmp_path, 5)
    base = str(tmp_path / "table")
    updates = lambda df: df.select("fingerprint", "status", F.col("seen_at").alias("ts"))
    SS.run_status(updates(stream), str(tmp_path / "cp"), base, compact_every=2)
    want = sorted(map(tuple, SS.track_status(updates(batch)).collect()))
    assert sorted(map(tuple, SS.read_status(spark, base).select("fingerprint", "status", "changes", "first_seen_at", "last_seen_at").collect())) == want


def test_streaming_dedupe_over_batches(spark, tmp_path):
    batch, stream = stream_input(spark, tmp_path, 4)
    out = SF.dedupe_stream(stream, "seen_at", "30 days").select("repo", "fingerprint", "file_path")
    SF.run_available(out, str(tmp_path / "cp"), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.distinct().count() == batch.select("repo", "fingerprint", "file_path").distinct().count()


def test_first_sightings_are_the_earliest_rows(spark, tmp_path):
    """Rows that arrive late and out of order, over several batches; equal to the batch minimum of closed runs."""
    start = datetime(2024, 1, 1)
    rows = [("r", f"k{i % 5}", "p", start + timedelta(minutes=(i * 37) % 600), i, "x") for i in range(100)]
    rows += [("r", "k1", "p", start + timedelta(hours=30), 200, "y"), ("r", "k1", "p", start + timedelta(hours=30), 150, "z"), ("q", "end", "p", start + timedelta(days=9), 300, "e")]
    schema = "repo string, fingerprint string, file_path string, seen_at timestamp, event_id long, type string"
    folder = tmp_path / "in"
    for n in range(4):
        part = rows[n::4] if n < 3 else rows[3::4]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(folder))
    first = SF.first_sightings_stream(stream, "seen_at", "12 hours")
    for _ in range(2):
        SF.run_available(first, str(tmp_path / "cp"), str(tmp_path / "out"))
    got = {(r.fingerprint, r.seen_at): (r.event_id, r.type, r.sightings) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {}
    for k in range(5):
        own = sorted((r[3], r[4], r[5]) for r in rows[:100] if r[1] == f"k{k}")
        want[(f"k{k}", own[0][0])] = (own[0][1], own[0][2], len(own))
    want[("k1", start + timedelta(hours=30))] = (150, "z", 2)
    assert got == want


def test_streaming_rollup_emits_closed_days_once(spark, tmp_path):
    batch, stream = stream_input(spark, tmp_path, 4)
    # The newest time is 29 minutes into day 4, so a delay of 10 minutes closes day 3.
    SF.run_available(SF.daily_rollup_stream(stream, "seen_at", "10 minutes"), str(tmp_path / "cp"), str(tmp_path / "out"))
    got = {str(r.day): (r.findings_total, r.high, r.low) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {f"2024-01-{d:02d}": (30, 15, 15) for d in (1, 2, 3)}


def test_streaming_scan_equals_batch_and_resumes(spark, tmp_path):
    rows = [("r", "c", f"f{i}", f"password = 'hunter{i}x'\n" * (i % 3)) for i in range(20)]
    folder = tmp_path / "in"
    schema = "repo string, commit_sha string, file_path string, content string"
    files = spark.createDataFrame(rows, schema)
    files.where("file_path < 'f15'").coalesce(1).write.parquet(str(folder))
    run = lambda: SF.run_available(SF.scan_stream(SF.read_new_files(spark, str(folder), files.schema)), str(tmp_path / "cp"), str(tmp_path / "out"))
    run()
    files.where("file_path >= 'f15'").coalesce(1).write.mode("append").parquet(str(folder))
    run()
    want = SF.scan_stream(files)
    got = spark.read.parquet(str(tmp_path / "out"))
    cols = ["file_path", "line_start", "fingerprint"]
    assert "secret" not in got.columns
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_streams_over_a_file_and_over_a_folder_of_files(spark, tmp_path):
    """A table is one Parquet file, or a folder with the table's name that holds several."""
    spark.range(9).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "one"))
    shutil.copyfile(next((tmp_path / "one").glob("part-*.parquet")), tmp_path / "one.parquet")
    for name, n in (("many", 9), ("one", 4)):
        stream = SF.read_new_files(spark, str(tmp_path / f"{name}.parquet"), "id long")
        SF.run_available(stream, str(tmp_path / f"cp-{name}"), str(tmp_path / f"out-{name}"))
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / f"out-{name}")).collect()) == list(range(n))


def test_streaming_scan_of_a_table_in_several_files(spark, tmp_path):
    from secret_audit.checks import load

    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    documents.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    scan = load()[0]["streaming_scan"]
    want = sorted(map(tuple, scan(spark, "/root/testdata/sf0.001").collect()))
    assert want and sorted(map(tuple, scan(spark, str(tmp_path)).collect())) == want
