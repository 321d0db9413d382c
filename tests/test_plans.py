"""What the physical plans have to look like."""

import re

import pytest
from pyspark.sql import functions as F

from secret_audit.operators import detect as D
from secret_audit.operators import merge as J
from secret_audit.operators import metrics as A
from secret_audit.operators.select import select_files, selection_flags
from secret_audit.plans.commit_scan import commit_findings
from secret_audit.plans.repo_scan import merged_findings, scan_findings
from secret_audit.rules import COMMIT_PACK
from secret_audit.operators.numbering import document_parts
from secret_audit.sources.files import read_files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "files")
    spark.range(100).select(
        F.lit("r").alias("repo"), F.lit("c").alias("commit_sha"), F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".py")).alias("file_path"),
        F.lit("password = 'hunter22'").alias("content"), F.lit(21).cast("long").alias("size"), F.lit(None).cast("map<string,string>").alias("metadata"),
    ).repartition(8).write.parquet(path)
    return read_files(spark, path)


def test_scan_has_no_shuffle_join_or_python(files):
    for df in (D.scan_content(files), D.scan_lines(files, COMMIT_PACK), D.entropy_candidates(files)):
        p = plan(df)
        assert not re.search(r"Exchange|Join|Python|Pandas|Window", p)


def test_first_step_of_a_scan_is_generated_code(files):
    for df in (D.scan_content(files), D.scan_lines(files, COMMIT_PACK)):
        first = [line for line in plan(df).split("\n") if "explode(array_remove(" in line]
        assert first and all(re.search(r"\*\(\d+\) Generate", line) for line in first)


def test_lower_case_copy_is_made_once(files):
    assert len(re.findall(r"[^_]lower\(", plan(D.scan_content(files)))) == 1
    assert len(re.findall(r"[^_]lower\(", plan(D.scan_lines(files, COMMIT_PACK)))) == 1


def test_scan_reads_only_the_columns_it_needs(files):
    schema = re.search(r"ReadSchema: (\S+)", plan(D.scan_content(files.select("file_path", "content")))).group(1)
    assert schema == "struct<file_path:string,content:string>"


def test_lines_are_searched_once_and_not_their_text(files):
    for df in (D.scan_lines(files, COMMIT_PACK), D.scan_lines_with_entropy(files, COMMIT_PACK), D.entropy_candidates(files)):
        p = plan(df)
        assert "regexp_replace" not in p and p.count("posexplode(split(content") == 1


def test_selection_does_not_read_text(files):
    for df in (selection_flags(files).select("file_path", "selection"), select_files(files, max_files=5).select("repo", "file_path")):
        for schema in re.findall(r"ReadSchema: (\S+)", plan(df)):
            assert "content" not in schema


def test_size_filter_reaches_the_scan(files):
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(size,200000\)", plan(select_files(files, max_bytes_per_file=200_000)))


def test_commit_scan_shuffles_hits_once(files):
    p = plan(commit_findings(files.drop("metadata")))
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1 and p.count("FileScan") == 1 and "Window" not in p


def test_merge_and_risk_use_partial_aggregation(files):
    p = plan(A.risk_scores(merged_findings(scan_findings(files.drop("metadata")))))
    assert p.count("FileScan") == 1 and "Window" not in p
    assert "partial_min_by" in p and "partial_sum" in p


def test_upsert_adds_one_exchange_per_side(spark, files):
    found = files.select("repo", F.sha2("content", 256).alias("fingerprint"), "file_path", F.lit("c").alias("commit_sha"),
                         F.to_timestamp(F.lit("2024-01-01")).alias("seen_at"))
    merged, _ = J.upsert(J.lifecycle(found), found)
    assert len(re.findall(r"Exchange hashpartitioning", plan(merged))) == 2


def test_parts_of_one_scan_go_to_many_tasks(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        one = spark.range(3000).select(F.lit("s").alias("scan_id"), F.sha2(F.col("id").cast("string"), 256).alias("id"))
        parts = document_parts(one, "scan_id", target=10).groupBy("scan_id", "part").agg(F.count("*").alias("n"))
        tasks = parts.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks > 1


def test_history_is_not_shuffled(spark, tmp_path):
    """Beside a stored history, only the run and the rows that it touches are exchanged."""
    key = [F.lit("r").alias("repo"), F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"), F.lit("p").alias("file_path")]
    spark.range(3000).select(*key).repartition(4).write.parquet(str(tmp_path / "old"))
    spark.range(2900, 3100).select(*key).write.parquet(str(tmp_path / "run"))
    history, run = (spark.read.parquet(str(tmp_path / x)) for x in ("old", "run"))
    keys = ("repo", "fingerprint", "file_path")
    for most in (1000, 5):
        assert J.not_stored(run, history, keys, most).count() == 100
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(J.not_stored(run, history, keys))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Upwards from the scan of the history: the join with the digests comes before any exchange.
    scans = [i for i, x in enumerate(p.split("\n")) if "FileScan" in x and "/old]" in x]
    assert len(scans) == 1
    found = [x for x in p.split("\n")[: scans[0]] if re.search(r"Exchange hashpartitioning|BroadcastHashJoin", x)]
    assert "BroadcastHashJoin" in found[-1] and "LeftSemi" in found[-1]
