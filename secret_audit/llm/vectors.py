"""Vectors in Arrow batches, and the nearest rows of blocks: shared by both vector searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, id_column: str, vector: str, nonzero: bool) -> DataFrame:
    """_id and _vector (array of double) of the rows that take part.

    Left out are rows without an id, null and empty vectors and those with a null or non-finite component, and on demand
    vectors of zeros.
    """
    v = F.col("_vector")
    df = df.select(F.col(f"`{id_column}`").cast("long").alias("_id"), F.col(f"`{vector}`").cast("array<double>").alias("_vector"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    df = df.filter(F.col("_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(good, F.lit(False)))
    return df.filter(F.exists(v, lambda x: x != 0)) if nonzero else df


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column whose lists are equally long, as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def distinct_rows(ids: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, and for each its smallest ids in ascending order (``most`` of them, filled up with -1 and a count).

    Of equal vectors only the ``most`` smallest ids can be among the first ``most`` of any ranking with ties to small ids.
    """
    raw = np.ascontiguousarray(rows)
    keys = raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel()
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    group = group.ravel()
    order = np.lexsort((ids, group))
    sorted_group, sorted_ids = group[order], ids[order]
    fresh = np.concatenate(([True], (sorted_group[1:] != sorted_group[:-1]) | (sorted_ids[1:] != sorted_ids[:-1])))
    sorted_group, sorted_ids = sorted_group[fresh], sorted_ids[fresh]
    begin = np.searchsorted(sorted_group, np.arange(len(first)))
    place = np.arange(len(sorted_group)) - begin[sorted_group]
    small = place < most
    out = np.full((len(first), most), -1, np.int64)
    out[sorted_group[small], place[small]] = sorted_ids[small]
    counts = np.minimum(np.bincount(sorted_group, minlength=len(first)), most)
    return raw[first], out, counts


def best_of(query: int, scores: np.ndarray, ids: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows for a query other than itself, given the distinct rows' scores."""
    own = np.repeat(scores, counts)
    flat = ids[np.arange(ids.shape[1])[None, :] < counts[:, None]]
    other = flat != query
    own, flat = own[other], flat[other]
    order = np.lexsort((flat, -own))[:k]
    return flat[order], own[order]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of the candidates found for each query, ties to the smaller vec_id."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
