"""Exported commits as file versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secret_audit.operators.numbering import top_cutoff
from secret_audit.operators.select import has_content, is_binary_path, is_removed
from secret_audit.schemas import COMMITS

SCAN_DEPTH = 10


def newest_commits(commits: DataFrame, depth: int = SCAN_DEPTH, since=None) -> DataFrame:
    """The newest ``depth`` commits per repo since a time; equal dates are ordered by sha.

    Only dates and shas are ranked; the commits themselves are compared with the cut-off of repositories that have more.
    """
    if since is not None:
        commits = commits.where(F.col("date") >= F.lit(since).cast("timestamp"))
    key = F.struct("date", "sha")
    cut = top_cutoff(commits, "repo", key, depth, newest=True).withColumnRenamed("repo", "_scope")
    joined = commits.join(cut, commits["repo"].eqNullSafe(cut["_scope"]), "left")
    return joined.where(F.col("_cut").isNull() | (key >= F.col("_cut"))).select(*commits.columns)


def file_versions(commits: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """One row per added or modified text file of each commit, in the files columns.

    Removed and binary files are dropped before their content is looked at. ``contents`` (sha, file_path, content)
    supplies bodies that are not part of the export.
    """
    changes = commits.select(
        "repo", "sha", "message", "author", "date", F.explode("files").alias("f")
    ).select(
        "repo", F.col("sha").alias("commit_sha"), F.col("f.file_path").alias("file_path"),
        F.col("f.status").alias("status"), F.col("f.content").alias("content"),
        "message", "author", "date",
    ).where(~is_removed(F.col("status")) & ~is_binary_path(F.col("file_path")))
    if contents is not None:
        bodies = contents.select(F.col("sha").alias("commit_sha"), "file_path", F.col("content").alias("_body"))
        changes = changes.join(bodies, ["commit_sha", "file_path"], "left").withColumn(
            "content", F.coalesce("content", "_body")
        ).drop("_body")
    metadata = F.create_map(
        F.lit("commit_message"), "message", F.lit("author"), "author",
        F.lit("date"), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("file_status"), "status",
    )
    return changes.where(has_content(F.col("content"))).select(
        "repo", "commit_sha", "file_path", "content", F.octet_length("content").cast("long").alias("size"),
        metadata.alias("metadata"), F.col("date").alias("seen_at"),
    )


def read_commits(spark: SparkSession, path: str, since=None, depth: int = SCAN_DEPTH) -> DataFrame:
    """File versions of the newest commits in JSON lines."""
    return file_versions(newest_commits(spark.read.schema(COMMITS).json(path), depth, since))
