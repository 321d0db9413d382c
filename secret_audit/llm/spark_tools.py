"""Small Spark helpers of this package: stored intermediate tables, free column names, Arrow maps over texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, or under the context's checkpoint folder where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column name as Spark SQL reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


#: A key that more than one in so many rows have is hot; there are at most this many.
HOT_SHARE = 1000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join with a table that has each key once, and in ``weight`` how many rows of ``left`` have it.

    Hot keys are broadcast, so that their rows stay where they are; the others are shuffled.
    """
    hot = F.col(weight) * HOT_SHARE > total
    few = F.broadcast(right.where(hot))
    rest = left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti")
    return left.join(few, keys).unionByName(rest.join(right.where(~hot), keys))


#: Most bytes in an Arrow batch of texts.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of a few MB; the session's limit is lowered for that, never raised."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def map_slices(
    df: DataFrame, keep: list[str], column: str, fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
) -> DataFrame:
    """Run a function over slices of rows and add the columns it returns to those kept.

    ``make`` runs once per task; its result gets a slice and returns an Arrow array per field.
    """
    from secret_audit.llm.textkit import slices

    small_batches(df.sparkSession)
    kept = T.StructType([df.schema[c] for c in keep])
    schema = T.StructType([*kept.fields, *fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, column):
                arrays = [part.column(c) for c in keep] + fn(part)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    wanted = list(dict.fromkeys([*keep, column]))
    return df.select(*[quoted(c) for c in wanted]).mapInArrow(run, schema)
