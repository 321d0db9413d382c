"""Streaming forms of the scan, the dedupe, the upsert and the rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secret_audit.operators.detect import findings_from_content
from secret_audit.operators.merge import finding_key, fold_lifecycle, lifecycle
from secret_audit.rules import CONTENT_PACK
from secret_audit.schemas import SEVERITIES
from secret_audit.sources.store import delta_writer, hadoop_path, read_changes


def scan_stream(files: DataFrame, rules=CONTENT_PACK, context: bool = False, partitions: int | None = None) -> DataFrame:
    """Findings of a stream of files; stateless, so it scales like the batch scan.

    ``partitions`` spreads the texts of a micro-batch that comes in few large input files.
    """
    if partitions:
        files = files.repartition(partitions, *[c for c in files.columns if c in ("repo", "commit_sha", "file_path")])
    return findings_from_content(files, rules, context)


def dedupe_stream(
    findings: DataFrame, at: str, delay: str = "1 day", legacy_key: bool = False, salts: int = 16
) -> DataFrame:
    """One sighting per key, the one that arrives first; keys are forgotten once the watermark passes, so state stays bounded.

    ``first_sightings_stream`` gives the earliest by time. Copies of a key are first reduced in salted groups, so a key that makes up much of the stream is spread over tasks
    and at most ``salts`` of its rows meet in one.
    """
    keys = list(finding_key(legacy_key))
    keyed = findings.withColumn(at, F.col(at).cast("timestamp"))
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64(*keyed.columns), F.lit(salts))).withWatermark(at, delay)
    return salted.dropDuplicatesWithinWatermark([*keys, "_salt"]).drop("_salt").dropDuplicatesWithinWatermark(keys)


def first_sightings_stream(findings: DataFrame, at: str, delay: str = "1 day", legacy_key: bool = False) -> DataFrame:
    """The earliest row of every run of sightings of a key, emitted once the watermark has passed the run's end.

    A run is a session: sightings of a key that follow each other within ``delay``. Of rows at one time the smallest stays.
    State holds a row per key and open run; rows meet in partial aggregates first.
    """
    keys = list(finding_key(legacy_key))
    timed = findings.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    rest = [c for c in findings.columns if c not in keys and c != at]
    row = F.min(F.struct(at, *rest)).alias("_first")
    runs = timed.groupBy(*keys, F.session_window(at, delay).alias("_run")).agg(row, F.count("*").alias("sightings"), F.max(at).alias("last_seen_at"))
    return runs.select(*keys, "_first.*", "sightings", "last_seen_at")


def daily_rollup_stream(findings: DataFrame, at: str, delay: str = "1 hour") -> DataFrame:
    """Counts per day and repo, emitted once the day is closed."""
    counts = [F.count("*").alias("findings_total")] + [
        F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES
    ]
    timed = findings.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.groupBy(F.window(at, "1 day").alias("w"), "repo").agg(*counts).select(
        F.to_date("w.start").alias("day"), "repo", *[c for c in ("findings_total", *map(str.lower, SEVERITIES))]
    )


def run_available(stream: DataFrame, checkpoint: str, path: str, mode: str = "append") -> None:
    """Process all available input into a Parquet folder; rerun with the same checkpoint to take only what is new."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_upsert(
    stream: DataFrame, checkpoint: str, base: str, seen_at: str = "seen_at", legacy_key: bool = False,
    compact_every: int = 50,
) -> None:
    """Keep the lifecycle table of a stream of findings; read it with ``read_lifecycle``."""
    writer = delta_writer(
        base, lambda batch: lifecycle(batch, seen_at, legacy_key), lambda t: fold_lifecycle(t, legacy_key), compact_every
    )
    query = (
        stream.writeStream.foreachBatch(writer)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_lifecycle(spark: SparkSession, base: str, legacy_key: bool = False) -> DataFrame:
    return fold_lifecycle(read_changes(spark, base), legacy_key)


def read_new_files(spark: SparkSession, path: str, schema, name_filter: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Stream over the Parquet files of a folder, or over a single file; the checkpoint remembers which were taken."""
    fs, place = hadoop_path(spark, path)
    if fs.getFileStatus(place).isFile():  # a stream needs a folder
        path, name_filter = place.getParent().toString(), place.getName()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(path)
