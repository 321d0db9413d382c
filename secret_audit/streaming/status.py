"""Status lifecycle per fingerprint over a stream of status changes.

The lifecycle is a fold in which the latest change wins: changes of one fingerprint combine within each batch, and the folds of
the batches combine when the table is read or compacted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secret_audit.schemas import STATUSES
from secret_audit.sources.store import delta_writer, read_changes


def track_status(updates: DataFrame, statuses=STATUSES) -> DataFrame:
    """Current status, number of changes and first and last time per fingerprint; unknown statuses are ignored.

    Late changes are harmless because the order is by their own time.
    """
    valid = updates.withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("status").isin(*statuses))
    return valid.groupBy("fingerprint").agg(
        F.max_by("status", F.struct("ts", "status")).alias("status"),
        F.count("*").alias("changes"),
        F.min("ts").alias("first_seen_at"),
        F.max("ts").alias("last_seen_at"),
    )


def fold_status(partial: DataFrame) -> DataFrame:
    """One row per fingerprint from the folds of several batches."""
    return partial.groupBy("fingerprint").agg(
        F.max_by("status", F.struct("last_seen_at", "status")).alias("status"),
        F.sum("changes").alias("changes"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
    )


def run_status(updates: DataFrame, checkpoint: str, base: str, compact_every: int = 50) -> None:
    """Keep the status table of a stream of changes; read it with ``read_status``.

    Each batch is folded by itself and stored as a delta, so the stream keeps no state however many fingerprints there are.
    """
    query = (
        updates.writeStream.foreachBatch(delta_writer(base, track_status, fold_status, compact_every))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_status(spark: SparkSession, base: str) -> DataFrame:
    return fold_status(read_changes(spark, base))
