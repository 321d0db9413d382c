"""Exact search of the highest integer inner products by columnar branch and bound.

Vectors become integers, floor(256 x). Rows are dealt out evenly into blocks, and every block of candidates meets every block
of queries once. In a block the candidates lie column by column. The products are summed up one group of columns after the
other; after each group the Cauchy-Schwarz bound of the columns that are left tells how much a candidate can still gain, and
only those that can reach the query's best are carried on. The search is exact: bounds only leave out what can't be among
the first ``k``.

Defined results: vectors of different lengths are not compared. Rows without an id and vectors that are null or empty or hold
a null or non-finite component take no part; all others do, however large. Products are exact: where they leave the range in
which doubles or longs are, bounds take the rounding into account and what they leave is summed up in Python integers. A score
that doesn't fit a long is given as the largest or smallest long, and ranked by its true value. Rows that repeat an id count as
one candidate, with their best score, and never meet themselves. A query without candidates has no rows; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secret_audit.llm.vectors import best_of, distinct_rows, matrix, valid_vectors

BLOCK_ROWS, QUERY_ROWS = 8192, 4096
COLUMN_GROUP, SEEDS = 8, 64
_MOST, _LEAST = (1 << 63) - 1, -(1 << 63)


def floored(rows: np.ndarray) -> np.ndarray:
    """floor(256 x) / 256, which is a double for every finite x; from 2^44 on x is a multiple of 1 / 256 itself."""
    small = np.abs(rows) < 2.0**44
    return np.where(small, np.floor(np.where(small, rows, 0.0) * 256.0) / 256.0, rows) + 0.0


def whole(row: np.ndarray) -> list[int]:
    """The integers 256 v of a floored vector."""
    return [int(v * 256) if abs(v) < 2.0**44 else int(v) * 256 for v in row.tolist()]


def long_and_key(score: int) -> tuple[int, str]:
    """The score as a long, and a text that ranks scores of the same long."""
    if score > _MOST:
        return _MOST, f"p{len(str(score)):06}{score}"
    if score < _LEAST:
        return _LEAST, "a" + f"{len(str(-score)):06}{-score}".translate(str.maketrans("0123456789", "9876543210"))
    return score, "m"


def _best_whole(query: int, q: np.ndarray, places: list[int], rows: np.ndarray, ids, counts, k: int, known: dict) -> list[tuple[int, int]]:
    """(id, score) of the k best of the rows at a few places, in Python integers; ``known`` keeps the integers of rows."""
    own, found = whole(q), []
    for place, rest, n in zip(places, ids[places], counts[places], strict=True):
        if place not in known:
            known[place] = whole(rows[place])
        score = sum(a * b for a, b in zip(own, known[place], strict=True))
        found += [(-score, i) for i in rest[:n].tolist() if i != query]
    return [(i, -s) for s, i in sorted(found)[:k]]


def block_search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """query id, id, score and key of the k best rows of a block for each query; vectors are floored ones."""
    rows, own_ids, counts = distinct_rows(ids, rows, k + 1)
    scale = [max(1.0, np.abs(x).max(initial=0.0)) for x in (rows, queries)]
    powers = [-int(np.frexp(s)[1]) for s in scale]
    units = [np.ldexp(x, p) for x, p in zip((rows, queries), powers, strict=True)]  # components of at most 1
    norms = [np.sqrt((x**2).sum(axis=1)) for x in units]
    top = norms[0].max(initial=0) * norms[1].max(initial=0)
    reached = np.log2(top) + 16 - sum(powers) if top > 0 else 0.0
    large = max(scale) >= 2.0**53
    exact = not large and reached < 62
    dims = np.arange(rows.shape[1])
    order = np.argsort(-(units[0] ** 2).sum(axis=0), kind="stable") if len(rows) else dims  # columns with most mass first
    if exact:
        kind = np.float64 if reached < 52 else np.int64  # whole numbers below 2^53 are exact in double precision
        columns, asked = np.ascontiguousarray((rows * 256.0).astype(kind)[:, order].T), (queries * 256.0).astype(kind)[:, order]
    else:
        columns, asked = np.ascontiguousarray(units[0][:, order].T), units[1][:, order]
    mass, query_mass = (x.astype(np.float64) ** 2 for x in (columns, asked))
    cuts = list(range(0, len(columns), COLUMN_GROUP)) + [len(columns)]
    rest = [np.sqrt(mass[c:].sum(axis=0)) for c in cuts[1:]]
    query_rest = [np.sqrt(query_mass[:, c:].sum(axis=1)) for c in cuts[1:]]
    # What a sum of rounded products may be off by, for a query of length 1; bounds are rounded as well.
    off = np.sqrt(mass.sum(axis=0)) * (1e-9 if exact else (len(columns) + 16) * 2.0**-52) + (0.0 if exact else 2.0**-900)
    length = np.sqrt(query_mass.sum(axis=1))
    known: dict[int, list[int]] = {}
    out: list[list[np.ndarray]] = [[], [], [], []]
    head = columns[: cuts[1]]
    for at in range(0, len(asked), 128):
        first = asked[at : at + 128, : cuts[1]] @ head
        for i, sums in enumerate(first, at):
            q, reach = asked[i], -np.inf
            slack = off * length[i] + (0.0 if exact else 2.0**-900)
            bound = sums + query_rest[0][i] * rest[0] + slack
            if len(sums) > k + 1:
                seeds = np.argpartition(-bound, min(SEEDS, len(bound)) - 1)[:SEEDS]
                full = q @ columns[:, seeds] - slack[seeds]
                if len(full) > k:  # at most one of k + 1 distinct rows is the query alone
                    reach = float(np.partition(full, len(full) - k - 1)[len(full) - k - 1])
            alive = np.flatnonzero(bound >= reach)
            sums = sums[alive]
            for g in range(1, len(cuts) - 1):
                sums = sums + q[cuts[g] : cuts[g + 1]] @ columns[cuts[g] : cuts[g + 1], alive]
                on = sums + query_rest[g][i] * rest[g][alive] + slack[alive] >= reach
                alive, sums = alive[on], sums[on]
            if exact:
                found, score = best_of(int(query_ids[i]), sums, own_ids[alive], counts[alive], k)
                pairs = [(found, score.astype(np.int64), np.full(len(found), "m", object))]
            else:
                if len(alive) > k + 1:  # the sums are complete now
                    low = sums - slack[alive]
                    on = sums + slack[alive] >= np.partition(low, len(low) - k - 1)[len(low) - k - 1]
                    alive = alive[on]
                best = _best_whole(int(query_ids[i]), queries[i], alive.tolist(), rows, own_ids, counts, k, known)
                told = [long_and_key(s) for _, s in best]
                pairs = [(np.array([i for i, _ in best], np.int64), np.array([s for s, _ in told], np.int64), np.array([t for _, t in told], object))]
            for found, score, key in pairs:
                for to, x in zip(out, (np.full(len(found), query_ids[i], np.int64), found, score, key), strict=True):
                    to.append(x)
    kinds = (np.int64, np.int64, np.int64, object)
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, kinds, strict=True))


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        data = [x.combine_chunks() for x in (left, right)]
        found = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, object)]
        if all(x.num_rows for x in data):
            (ids, rows), (query_ids, queries) = ((x.column("_id").to_numpy(), floored(matrix(x.column("_vector")))) for x in data)
            found = block_search(query_ids, queries, ids, rows, k)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("query_id", "vec_id", "score", "key"), found, kinds, strict=True)})

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "key")).alias("best"))
    order = Window.partitionBy("query_id").orderBy(F.col("best").desc(), "vec_id")
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int"), "vec_id", F.col("best.score").alias("score"))


def top_inner_products(
    df: DataFrame, queries: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = 5,
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that meet the condition ``queries``, against all other rows."""
    rows = valid_vectors(df, id_column, vector, nonzero=False)
    asked = valid_vectors(df.filter(queries), id_column, vector, nonzero=False)
    blocks, groups = (max(1, -(-x.count() // n)) for x, n in ((rows, block_rows), (asked, query_rows)))
    number, size = F.monotonically_increasing_id(), F.size("_vector").alias("_size")
    deal = lambda n: (F.pmod(number, F.lit(n)) if n > 1 else F.lit(0)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("_id", "_vector", size, deal(blocks).alias("_block")).withColumn("_group", every(groups))
    right = asked.select("_id", "_vector", size, deal(groups).alias("_group")).withColumn("_block", every(blocks))
    keys = ["_size", "_block", "_group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), "query_id long, vec_id long, score long, key string")
    return _ranked(found, k)
