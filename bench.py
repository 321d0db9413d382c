"""Time the headline queries at one scale and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the number of local cores. Each query runs once unmeasured and then
three times; the median counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from secret_audit.checks import corpus, load  # noqa: E402
from secret_audit.session import build_session  # noqa: E402

HEADLINE = (
    "content_scan", "line_scan", "entropy_candidates", "commit_findings", "plugin_findings", "context_snippet",
    "merged_findings", "repo_risk_scores", "select_files", "redact_documents", "finding_lifecycle", "finding_upsert",
    "daily_rollup", "alert_digest", "merged_with_verdicts", "sarif_export", "streaming_scan", "streaming_upsert",
)
TEXT = ("content_scan", "line_scan", "entropy_candidates", "commit_findings", "repo_risk_scores")


def run(fn, spark, sf_dir) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="secret-audit-bench-"),
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered, _ = load()
    size = corpus.files(spark, sf_dir).agg(F.count("*"), F.sum("size")).first()
    times = {}
    for name in HEADLINE:
        run(registered[name], spark, sf_dir)
        times[name] = round(median(run(registered[name], spark, sf_dir) for _ in range(3)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    rates = {
        name: {"rows_per_s": round(size[0] / times[name]), "mb_per_s": round(size[1] / 1e6 / times[name], 2)} for name in TEXT
    }
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "text_rows": size[0],
        "text_bytes": size[1], "rates": rates,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
