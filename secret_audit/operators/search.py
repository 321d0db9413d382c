"""Substring search over stored findings that reads only blocks which may hold the text.

Findings are stored in blocks of neighbouring paths, and a posting table lists the blocks of every three characters (of the
lower-case searched columns). Blocks follow each other in files of their ranges, a page each: their number does not grow what
the driver samples, lists or hears from tasks. A text can only be in blocks that have all its trigrams; these are read and searched as
``listing.search`` does, so the rows are the same. Texts of fewer than three characters read every block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secret_audit.operators.listing import search

SEARCHED = ("type", "description", "file_path", "repo")
#: Folders of the posting table, and the most blocks that are named in a filter; more are joined.
_PARTS, _NAMED = 64, 10_000
#: Least rows and most number of the ranges that are sorted and written by one task each.
_RANGE_ROWS, _RANGES = 50_000, 1000
#: Bits of a row number that count inside its range.
_ROW_BITS = 33


def _part(gram):
    return F.pmod(F.xxhash64(gram), F.lit(_PARTS)).cast("int")


def write_search_index(findings: DataFrame, base: str, rows_per_block: int = 100_000, columns=SEARCHED) -> None:
    """Write blocks and postings; ``findings`` is read twice, so pass a stored table."""
    ranges = max(1, min(_RANGES, -(-findings.count() // max(rows_per_block, _RANGE_ROWS))))
    row = F.monotonically_increasing_id()
    # A block has the number of its first row.
    placed = findings.repartitionByRange(ranges, "repo", "file_path", "id").sortWithinPartitions("repo", "file_path", "id").select("*", row.alias("_row"))
    inside = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    blocks = placed.withColumn("_block", F.col("_row") - inside % rows_per_block).withColumn("_range", F.shiftright("_block", _ROW_BITS)).drop("_row")
    written = blocks.sortWithinPartitions("_range", "_block").write.option("parquet.page.row.count.limit", rows_per_block)
    written.partitionBy("_range").parquet(f"{base}/blocks")
    stored = findings.sparkSession.read.parquet(f"{base}/blocks")

    def grams(c: str):
        low = F.lower(c)
        return F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, 3)))

    every = F.concat(*[F.coalesce(grams(c), F.array().cast("array<string>")) for c in columns])
    postings = stored.select("_block", F.explode(F.array_distinct(every)).alias("gram")).distinct().withColumn("_part", _part("gram"))
    postings.repartition("_part").sortWithinPartitions("_part", "gram").write.partitionBy("_part").parquet(f"{base}/postings")


def candidate_blocks(spark: SparkSession, base: str, text: str) -> DataFrame | None:
    """_block of the blocks that have every trigram of the text; None if all may hold it."""
    low = text.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not grams:
        return None
    wanted = spark.createDataFrame([(g,) for g in grams], "gram string")
    parts = [r[0] for r in wanted.select(_part("gram")).distinct().collect()]  # one per trigram of the text at most
    postings = spark.read.parquet(f"{base}/postings").where(F.col("_part").isin(parts) & F.col("gram").isin(grams))
    return postings.groupBy("_block").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("_block")


def search_index(spark: SparkSession, base: str, text: str, columns=SEARCHED) -> DataFrame:
    """Findings with the text in one of the columns; the columns have to be among those of the index."""
    rows, blocks = spark.read.parquet(f"{base}/blocks"), candidate_blocks(spark, base, text)
    if blocks is not None:
        named = [r[0] for r in blocks.limit(_NAMED + 1).collect()]
        if len(named) <= _NAMED:
            rows = rows.where(F.col("_range").isin(sorted({b >> _ROW_BITS for b in named})) & F.col("_block").isin(named))
        else:
            rows = rows.join(blocks, "_block", "left_semi")
    return search(rows, text, columns).drop("_block", "_range")
