"""The files table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secret_audit.schemas import FILES


def read_files(spark: SparkSession, path: str, sized: bool = True, partitions: int | None = None) -> DataFrame:
    """Parquet files table.

    With ``sized=False`` the size is taken from the text. A stored size is better: the selection then reads paths and
    sizes and leaves the text column alone. ``partitions`` spreads a table with few input splits by one shuffle, which pays
    where scanning the text costs more than moving it.
    """
    df = spark.read.schema(FILES).parquet(path)
    if not sized:
        df = df.withColumn("size", F.octet_length("content").cast("long"))
    return df.repartition(partitions, "repo", "file_path") if partitions else df


def files_from_text(df: DataFrame, text: str, repo: str, path) -> DataFrame:
    """Any text table as files: ``repo`` names a column, ``path`` is a column expression."""
    return df.select(
        F.col(repo).alias("repo"),
        F.lit(None).cast("string").alias("commit_sha"),
        path.alias("file_path"),
        F.col(text).alias("content"),
        F.octet_length(text).cast("long").alias("size"),
    )
