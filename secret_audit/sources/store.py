"""Stored findings, scan metadata, run log and versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secret_audit.operators.numbering import document_parts
from secret_audit.schemas import FINDINGS, SCAN_RUNS, SCANS
from secret_audit.session import shared_dir

# JSON keeps microseconds; Spark's default format would cut them.
_JSON_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
RAW_COLUMNS = {"secret", "content", "raw", "line"}


def _no_raw(df: DataFrame) -> DataFrame:
    leaked = RAW_COLUMNS & set(df.columns)
    if leaked:
        raise ValueError(f"raw text must not be stored: {sorted(leaked)}")
    return df


def materialize(df: DataFrame, name: str = "findings") -> DataFrame:
    """Write a result once to the shared folder and read it back.

    For results that feed several branches of a plan: without it the text would be scanned once per branch.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    _no_raw(df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finding_documents(findings: DataFrame, stored_at, target: int = 5000, scans: DataFrame | None = None) -> DataFrame:
    """Per scan {findings, count, stored_at}; a large scan spans several parts, ``count`` is that of the scan.

    With ``scans`` (scan_id) a scan without findings has a document with an empty list.
    """
    rest = [c for c in findings.columns if c != "scan_id"]
    parts = document_parts(_no_raw(findings), "scan_id", target=target)
    documents = parts.groupBy("scan_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("id", *[c for c in rest if c != "id"]))).alias("findings"),
        F.first("group_size").alias("count"),
    )
    if scans is not None:
        # Beside the documents, so that no join brings the parts of a large scan together again.
        clean = scans.select("scan_id").distinct().join(findings.select("scan_id").distinct(), "scan_id", "left_anti")
        empty = F.array().cast(documents.schema["findings"].dataType)
        documents = documents.unionByName(clean.withColumns({"part": F.lit(""), "findings": empty, "count": F.lit(0).cast("long")}))
    return documents.withColumn("stored_at", F.lit(stored_at).cast("timestamp"))


def write_finding_documents(findings: DataFrame, path: str, stored_at, target: int = 5000, scans: DataFrame | None = None) -> None:
    """Write the documents of some scans; those of other scans stay, those of the same scans are replaced."""
    documents = finding_documents(findings, stored_at, target, scans).hint("rebalance", "scan_id")
    writer = documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.options(**_JSON_TIME).partitionBy("scan_id").json(path)


def read_finding_documents(spark: SparkSession, path: str) -> DataFrame:
    """Findings from the documents, one row each."""
    item = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in FINDINGS if f.name != "scan_id")
    schema = f"scan_id string, part string, findings array<struct<{item}>>, count long, stored_at timestamp"
    return spark.read.schema(schema).options(**_JSON_TIME).json(path).select("scan_id", F.inline("findings"))


def write_scan_metadata(scans: DataFrame, path: str, stored_at) -> None:
    stamped = scans.withColumn("stored_at", F.lit(stored_at).cast("timestamp"))
    stamped.write.mode("append").options(**_JSON_TIME).json(path)


def read_scan_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Newest stored metadata of each scan."""
    schema = T.StructType([*SCANS.fields, T.StructField("stored_at", T.TimestampType())])
    stored = spark.read.schema(schema).options(**_JSON_TIME).json(path)
    return stored.groupBy("id").agg(F.max_by(F.struct(*stored.columns), "stored_at").alias("_s")).select("_s.*")


def finding_rows(findings: DataFrame) -> DataFrame:
    """Findings in table form: declared columns, ``unknown`` for a missing repo, empty remediation, status NEW."""
    have = set(_no_raw(findings).columns)
    defaults = {"repo": "unknown", "remediation": "", "status": "NEW", "notes": ""}

    def column(field):
        value = F.col(field.name) if field.name in have else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        return value.cast(field.dataType).alias(field.name)

    return findings.select(*[column(f) for f in FINDINGS])


def append_findings(findings: DataFrame, path: str) -> None:
    """Append to the findings table, one folder per day of creation.

    Rows are rebalanced by day: few files per day, and a large day is split over tasks.
    """
    rows = finding_rows(findings).withColumn("day", F.to_date("created_at")).hint("rebalance", "day")
    rows.write.mode("append").partitionBy("day").parquet(path)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_runs(events: DataFrame, path: str) -> None:
    """Append start and end records of scan runs."""
    events.select(*SCAN_RUNS.names).write.mode("append").parquet(path)


def current_runs(events: DataFrame) -> DataFrame:
    """State of each run: the latest non-null value of every field by event time."""
    fields = [c for c in events.columns if c not in ("id", "event_time")]
    latest = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("event_time"))).alias(c) for c in fields
    ]
    return events.groupBy("id").agg(*latest)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path that Spark's readers open."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def _complete(spark: SparkSession, base: str, kind: str) -> list[int]:
    """Numbers of the completely written folders ``<kind><number>`` of a table, ascending."""
    fs, root = hadoop_path(spark, base)
    if not fs.exists(root):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    done = [n for n in names if n[:1] == kind and n[1:].isdigit() and fs.exists(path(f"{base}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def _folder(base: str, kind: str, number: int) -> str:
    return f"{base}/{kind}{number:010d}"


def write_snapshot(df: DataFrame, base: str, version: int) -> None:
    """Write one version; writing the same version again replaces it."""
    _no_raw(df).write.mode("overwrite").parquet(_folder(base, "v", version))


def read_version(spark: SparkSession, base: str, version: int) -> DataFrame:
    return spark.read.parquet(_folder(base, "v", version))


def read_snapshot(spark: SparkSession, base: str) -> DataFrame | None:
    """Newest complete version."""
    versions = _complete(spark, base, "v")
    return read_version(spark, base, versions[-1]) if versions else None


def delta_folder(base: str, batch_id: int) -> str:
    return _folder(base, "d", batch_id)


def write_delta(df: DataFrame, base: str, batch_id: int) -> None:
    """Write the changes of one batch; a repeated batch replaces its own folder only."""
    _no_raw(df).write.mode("overwrite").parquet(_folder(base, "d", batch_id))


def read_changes(spark: SparkSession, base: str, below: int | None = None) -> DataFrame | None:
    """Newest version and the deltas after it as one bag, with the number of their folder in ``_batch``.

    ``below`` leaves out folders from that number on.
    """
    def numbers(kind: str) -> list[int]:
        return [n for n in _complete(spark, base, kind) if below is None or n < below]

    versions = numbers("v")
    newest = versions[-1] if versions else -1
    parts = [("v", newest)] if versions else []
    parts += [("d", n) for n in numbers("d") if n > newest]
    if not parts:
        return None
    number = F.regexp_extract(F.col("_metadata.file_path"), "/[vd]([0-9]{10})/[^/]*$", 1).cast("int")
    rows = spark.read.parquet(*[_folder(base, k, n) for k, n in parts])
    return rows.select("*", number.alias("_batch"))


def open_deltas(spark: SparkSession, base: str) -> int:
    """How many deltas have been written since the newest version."""
    versions = _complete(spark, base, "v")
    return sum(n > (versions[-1] if versions else -1) for n in _complete(spark, base, "d"))


def read_history(spark: SparkSession, base: str) -> DataFrame | None:
    """Rows of all versions, for tables whose versions are runs."""
    versions = _complete(spark, base, "v")
    return spark.read.parquet(*[_folder(base, "v", n) for n in versions]) if versions else None


def delta_writer(base: str, prepare, fold, compact_every: int = 50):
    """``foreachBatch`` function of a table kept as deltas.

    A batch writes only its own rows, ``prepare``d; once there are ``compact_every`` deltas the table is ``fold``ed into a
    new version, so a batch costs what it changes and reading never meets more than that many deltas.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        write_delta(prepare(batch), base, batch_id)
        if open_deltas(batch.sparkSession, base) >= compact_every:
            write_snapshot(fold(read_changes(batch.sparkSession, base)), base, batch_id)

    return apply
