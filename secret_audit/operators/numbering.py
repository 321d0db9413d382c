"""Ranks, sequence numbers and document parts that stay spread out when one group is very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SALTS = 64
#: Most ranges that rows are sorted into at once; their bounds come from a sample of a hundred rows of each.
_RANGES = 1000


def top_cutoff(df: DataFrame, group: str, key: Column, n: int, newest: bool = False) -> DataFrame:
    """The n-th distinct ``key`` as ``_cut`` of each group that has more than n; smallest first, or largest with ``newest``.

    Keys are ranked in salted sub-groups first, so the final window sees at most n + 1 rows per salt. Groups within the limit
    have no row, which keeps the table small.
    """
    rows = df.select(group, key.alias("_key")).distinct()
    order = F.col("_key").desc() if newest else F.col("_key").asc()
    local = Window.partitionBy(group, "_salt").orderBy(order)
    overall = Window.partitionBy(group).orderBy(order)
    kept = (
        rows.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(_SALTS)))
        .withColumn("_rn", F.row_number().over(local)).where(F.col("_rn") <= n + 1)
        .withColumn("_rn", F.row_number().over(overall)).where(F.col("_rn") <= n + 1)
    )
    cut = F.max_by("_key", F.when(F.col("_rn") <= n, F.col("_rn"))).alias("_cut")
    return kept.groupBy(group).agg(cut, F.max("_rn").alias("_n")).where(F.col("_n") > n).drop("_n")


def sequence(df: DataFrame, group: str, id_col: str, out: str = "seq", digits: int = 3) -> DataFrame:
    """Number the rows of each group from 0 in ``id_col`` order; ids are hex digests and unique.

    ``df`` is read twice, so pass a stored table. The leading hex digits split a group evenly into buckets; rows are ranked inside a bucket and shifted by the sizes
    of the buckets before it, at most ``16 ** digits`` numbers per group.
    """
    bucketed = df.withColumn("_bucket", F.substring(id_col, 1, digits))
    sizes = bucketed.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_bucket").orderBy(id_col)
    return (
        bucketed.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [group, "_bucket"])
        .withColumn(out, F.col("_offset") + F.col("_rn") - 1)
        .drop("_bucket", "_rn", "_offset")
    )


def document_parts(df: DataFrame, group, id_col: str = "id", target: int = 5000, out: str = "part") -> DataFrame:
    """Give each row a document part so that a part holds about ``target`` rows however large its group is.

    ``df`` is read twice, so pass a stored table. A part is a prefix of the id, a hex digest; groups up to the target have the single part ``''``. No row is left
    out. ``group_size`` is the size of the whole group.
    """
    group = [group] if isinstance(group, str) else list(group)
    sizes = df.groupBy(*group).agg(F.count("*").alias("group_size"))
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("group_size") / F.lit(float(target)))).cast("int"))
    sized = sizes.withColumn("_digits", digits)
    parted = df.join(sized, group).withColumn(out, F.col(id_col).substr(F.lit(1), F.col("_digits"))).drop("_digits")
    # Without this the grouping by part would keep the join's partitioning, with a large group in one task.
    return parted.repartition(*group, out)


def ordered_pieces(df: DataFrame, order, target: int = 5000, out: str = "_piece") -> DataFrame:
    """Number pieces of about ``target`` rows, larger ones from ``target * 1000`` rows on, that follow each other in the order of the columns.

    Rows inside a piece are not sorted. ``df`` is read three times, so pass a stored table.
    """
    pieces = min(_RANGES, -(-df.count() // target))
    if pieces < 2:
        return df.withColumn(out, F.lit(0))
    return df.repartitionByRange(pieces, *order).withColumn(out, F.spark_partition_id())
