"""Approximate nearest neighbours by balanced posting lists.

Index: centroids come from k-means with a penalty for full lists, on a sample of at most ``sample_rows`` vectors; there are
about ``list_rows`` rows per centroid, up to ``most_lists`` centroids. Every row goes to the list of its nearest centroid and,
where it lies near a border, to further lists whose distance is within a ratio of the nearest, unless a list already chosen
is closer to that centroid than the row is. Centroids are searched in a graph of neighbours held in memory.

Search: a query asks all lists whose centroids are within a ratio of its nearest one, however many they are. Lists and their queries are split into
blocks of a bounded size, so a list that holds a third of all rows is read by many tasks. Within a block the cosines are
computed for distinct vectors once.

Scores are exact cosines in double precision; which rows are found is approximate. Defined results: vectors of different
lengths are indexed apart and never compared. Rows without an id and vectors that are null, empty, zero or hold a null or
non-finite component take no part. Rows that repeat an id count as one candidate, with their best score, and never meet
themselves. If there are no more than ``k`` candidates, all are returned. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secret_audit.llm.spark_tools import stored
from secret_audit.llm.vectors import best_of, distinct_rows, matrix, ranked, valid_vectors

LIST_ROWS, MOST_LISTS = 200, 4096
#: Bounds of the sample: rows, and numbers in all of them.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 1 << 22
COPIES, COPY_RATIO = 4, 1.15
ASK_RATIO, ASK_WIDTH, COPY_WIDTH = 1.22, 96, 24
#: ASK_WIDTH is where the search of a query's lists begins, not where it ends; beyond it links are followed up to this share over the limit.
RANGE_MARGIN = 1.1
BLOCK_ROWS = 4096
_ROWS_AT_ONCE, _WIDE_ROWS, _PAIRS_AT_ONCE = 1024, 256, 32_768


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps very large and very small numbers in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def balanced_centroids(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of unit vectors; an assignment costs the distance and a share for how full the list already is."""
    rng = np.random.default_rng(11)
    distinct = np.unique(sample, axis=0)
    lists = min(lists, len(distinct))
    centers = distinct[rng.choice(len(distinct), lists, replace=False)]
    for _ in range(rounds):
        sums, sizes = np.zeros_like(centers), np.zeros(lists)
        for rows in np.array_split(rng.permutation(len(sample)), max(1, len(sample) // 512)):
            x = sample[rows]
            distance = 1 - x @ centers.T
            full = sizes / max(sizes.mean(), 1e-9) if sizes.any() else sizes
            own = (distance + 0.05 * np.maximum(full - 1, 0)[None, :]).argmin(axis=1)
            np.add.at(sums, own, x)
            sizes += np.bincount(own, minlength=lists)
        length = np.sqrt((sums * sums).sum(axis=1))
        good = length > 1e-9
        centers = np.where(good[:, None], sums / np.maximum(length, 1e-9)[:, None], distinct[rng.choice(len(distinct), lists)])
    return np.unique(centers, axis=0)


def neighbour_graph(centers: np.ndarray, degree: int = 16) -> np.ndarray:
    """Neighbours of each centroid (-1: none): near ones that no chosen neighbour is closer to, and links that connect all."""
    n = len(centers)
    chosen: list[list[int]] = [[] for _ in range(n)]
    for i in range(n):
        near = 1 - centers @ centers[i]
        order = np.argsort(near, kind="stable")[: 4 * degree + 1]
        for j in order[order != i].tolist():
            if len(chosen[i]) < degree and all(1 - centers[j] @ centers[m] > near[j] for m in chosen[i]):
                chosen[i].append(j)
        if i:
            j = int(near[:i].argmin())
            chosen[i].append(j)
            chosen[j].append(i)
    own = [list(dict.fromkeys(c)) for c in chosen]
    out = np.full((n, max(1, *map(len, own))), -1, np.int32)
    for i, c in enumerate(own):
        out[i, : len(c)] = c
    return out


def graph_search(x: np.ndarray, centers: np.ndarray, graph: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector the nearest centroids found by best-first search, nearest first, and their distances 1 - cosine."""
    width = min(width, len(centers))
    rows = np.arange(len(x))
    starts = np.unique(np.linspace(0, len(centers) - 1, min(4, width)).astype(int))
    ids = np.full((len(x), width), -1, np.int64)
    near, open_ = np.full((len(x), width), np.inf), np.zeros((len(x), width), bool)
    ids[:, : len(starts)], near[:, : len(starts)], open_[:, : len(starts)] = starts, 1 - x @ centers[starts].T, True
    seen = np.zeros((len(x), len(centers)), bool)
    seen[:, starts] = True
    active = rows
    while len(active):
        at = np.where(open_[active], near[active], np.inf).argmin(axis=1)
        node = ids[active, at]
        open_[active, at] = False
        next_ = graph[node]
        fresh = (next_ >= 0) & ~seen[active[:, None], next_]
        seen[np.broadcast_to(active[:, None], next_.shape)[fresh], next_[fresh]] = True
        distance = np.where(fresh, 1 - np.einsum("ad,agd->ag", x[active], centers[next_]), np.inf)
        all_near = np.hstack((near[active], distance))
        best = np.argpartition(all_near, width - 1, axis=1)[:, :width]
        near[active] = np.take_along_axis(all_near, best, 1)
        ids[active] = np.take_along_axis(np.hstack((ids[active], np.where(fresh, next_, -1))), best, 1)
        open_[active] = np.take_along_axis(np.hstack((open_[active], fresh)), best, 1)
        active = active[open_[active].any(axis=1)]
    order = np.argsort(near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def graph_range(x: np.ndarray, centers: np.ndarray, graph: np.ndarray, starts: np.ndarray, limit: np.ndarray) -> list[np.ndarray]:
    """For each unit vector all centroids within its limit that links lead to, over centroids a little beyond it as well."""
    seen, inside = np.zeros((len(x), len(centers)), bool), np.zeros((len(x), len(centers)), bool)
    row, node = np.nonzero(starts >= 0)
    node = starts[row, node]
    seen[row, node] = True
    while len(row):
        on_row, on_node = [], []
        for at in range(0, len(row), _PAIRS_AT_ONCE):
            r, n = row[at : at + _PAIRS_AT_ONCE], node[at : at + _PAIRS_AT_ONCE]
            distance = 1 - np.einsum("ad,ad->a", x[r], centers[n])
            inside[r, n] = distance <= limit[r]
            on = distance <= limit[r] * RANGE_MARGIN
            on_row.append(r[on])
            on_node.append(n[on])
        row, node = np.concatenate(on_row), np.concatenate(on_node)
        fresh = np.zeros_like(seen)
        for next_ in graph[node].T:
            fresh[row[next_ >= 0], next_[next_ >= 0]] = True
        fresh &= ~seen
        seen |= fresh
        row, node = np.nonzero(fresh)
    return [np.flatnonzero(own) for own in inside]


@dataclass
class ListIndex:
    """Centroids, their graph, and the number of rows whose nearest list each is."""

    centers: np.ndarray
    graph: np.ndarray
    sizes: np.ndarray | None = None

    def homes(self, x: np.ndarray) -> list[list[int]]:
        """Lists of each vector: the nearest, and further ones for vectors near a border."""
        ids, near = graph_search(x, self.centers, self.graph, COPY_WIDTH)
        limit = (COPY_RATIO**2) * near[:, :1] + 1e-12  # 1 - cosine is half the squared distance
        out = []
        for own, distance, ok in zip(ids, near, near <= limit, strict=True):
            kept = [int(own[0])]
            for j, d in zip(own[ok][1:].tolist(), distance[ok][1:].tolist(), strict=True):
                if len(kept) == COPIES:
                    break
                if all(1 - self.centers[j] @ self.centers[m] > d for m in kept):
                    kept.append(j)
            out.append(kept)
        return out

    def asked(self, x: np.ndarray, least: int) -> list[np.ndarray]:
        """Lists that each query asks: those within the ratio, and as many more as hold ``least`` rows."""
        ids, near = graph_search(x, self.centers, self.graph, ASK_WIDTH)
        limit = (ASK_RATIO**2) * near[:, :1] + 1e-12
        held = np.cumsum(np.where(ids >= 0, self.sizes[ids], 0), axis=1)
        enough = np.hstack((np.zeros((len(x), 1), bool), held[:, :-1] >= least))
        out = [own[ok & (own >= 0)] for own, ok in zip(ids, (near <= limit) | ~enough, strict=True)]
        # Where all that was found lies within the ratio there is more.
        wide = np.flatnonzero((near[:, -1:] <= limit)[:, 0]) if ids.shape[1] < len(self.centers) else []
        for at in range(0, len(wide), _WIDE_ROWS):
            rows = wide[at : at + _WIDE_ROWS]
            for row, lists in zip(rows.tolist(), graph_range(x[rows], self.centers, self.graph, ids[rows], limit[rows, 0]), strict=True):
                out[row] = lists
        return [lists if self.sizes[lists].sum() >= least else np.arange(len(self.centers)) for lists in out]


def build_index(vectors: DataFrame, rows: int, size: int) -> ListIndex:
    """Fit the centroids on a sample drawn by a hash of the id."""
    most = max(256, min(SAMPLE_ROWS, SAMPLE_NUMBERS // size))
    share = min(1.0, 1.2 * most / rows)
    draw = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    sample = vectors.filter(draw).select("_vector").limit(most).toArrow()
    if not sample.num_rows:  # a few rows whose hashes were not drawn
        sample = vectors.select("_vector").limit(most).toArrow()
    centers = balanced_centroids(unit(matrix(sample.column("_vector"))), max(1, min(MOST_LISTS, rows // LIST_ROWS)))
    return ListIndex(centers, neighbour_graph(centers))


def _placed(vectors: DataFrame, index: ListIndex, least: int | None) -> DataFrame:
    """_id, _vector, _list, _first: a row per list that a vector is kept in, or asks (``least`` given)."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)  # at most MOST_LISTS centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(at, _ROWS_AT_ONCE)
                x = unit(matrix(part.column("_vector")))
                lists = known.homes(x) if least is None else known.asked(x, least)
                counts = np.fromiter(map(len, lists), np.int64, len(lists))
                row = np.repeat(np.arange(len(lists)), counts)
                first = np.concatenate(([True], row[1:] != row[:-1]))
                taken = part.take(pa.array(row))
                arrays = [taken.column("_id"), taken.column("_vector"), pa.array(np.concatenate(lists).astype(np.int32)), pa.array(first)]
                yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_vector", "_list", "_first"])

    return vectors.select("_id", "_vector").mapInArrow(run, "_id long, _vector array<double>, _list int, _first boolean")


def cosine_search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """(query id, id, cosine) of the k best rows of a block for each query, as three arrays."""
    rows, own_ids, counts = distinct_rows(ids, rows, k + 1)
    fast = unit(rows)
    out: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, len(queries), 256):
        close = unit(queries[at : at + 256]) @ fast.T
        for i, near in enumerate(close, at):
            reach = np.partition(near, len(near) - k - 1)[len(near) - k - 1] - 1e-9 if len(near) > k + 1 else -np.inf
            some = np.flatnonzero(near >= reach)
            found, score = best_of(int(query_ids[i]), cosines(queries[i], rows[some]), own_ids[some], counts[some], k)
            for o, x in zip(out, (np.full(len(found), query_ids[i], np.int64), found, score), strict=True):
                o.append(x)
    return tuple(np.concatenate(o) if o else np.zeros(0, t) for o, t in zip(out, (np.int64, np.int64, np.float64), strict=True))


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of a vector with each row, alike for equal rows wherever they are."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        out = (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))
    odd = ~np.isfinite(out)
    if odd.any():
        out[odd] = (unit(rows[odd]) * unit(query[None, :])).sum(axis=1)
    return out


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if left.num_rows and right.num_rows:
            (ids, rows), (query_ids, queries) = ((x.column("_id").to_numpy(), matrix(x.column("_vector"))) for x in (left, right))
            found = cosine_search(query_ids, queries, ids, rows, k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    return run


def _blocked(placed: DataFrame, own: str, other: str, counts: DataFrame) -> DataFrame:
    """Deal the rows of each list into blocks of a bounded size, each with a copy for every block of the other side."""
    sized = placed.join(F.broadcast(counts), "_list")  # a row per list
    number = F.pmod(F.monotonically_increasing_id(), F.col(own)).cast("int")
    return sized.withColumn(f"{own}_at", number).withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))


def nearest_neighbours(
    df: DataFrame, queries: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = 5, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that meet the condition ``queries``, among all other rows."""
    rows = valid_vectors(df, id_column, vector, nonzero=True)
    asked = valid_vectors(df.filter(queries), id_column, vector, nonzero=True)
    sizes = {r["n"]: r["count"] for r in rows.groupBy(F.size("_vector").alias("n")).count().collect()}  # a row per vector length
    found = []
    for size, n in sorted(sizes.items()):
        own = F.size("_vector") == size
        index = build_index(rows.filter(own), n, size)
        posted = stored(_placed(rows.filter(own), index, None), "posting-lists")
        blocks = lambda c: F.ceil(F.count("*") / block_rows).cast("int").alias(c)
        held = posted.groupBy("_list").agg(blocks("_rows"), F.count_if("_first").alias("n"))
        index.sizes = np.zeros(len(index.centers), np.int64)
        for r in held.select("_list", "n").collect():  # a row per list
            index.sizes[r["_list"]] = r["n"]
        asking = stored(_placed(asked.filter(own), index, min(k + 1, n)), "asked-lists")
        counts = held.select("_list", "_rows").join(asking.groupBy("_list").agg(blocks("_asks")), "_list")
        keys = ["_list", "_rows_at", "_asks_at"]
        left = _blocked(posted, "_rows", "_asks", counts).select("_id", "_vector", *keys)
        right = _blocked(asking, "_asks", "_rows", counts).select("_id", "_vector", *keys)
        cogroups = left.groupBy(*keys).cogroup(right.groupBy(*keys))
        found.append(cogroups.applyInArrow(_search(k), "query_id long, vec_id long, score double"))
    if not found:
        empty = df.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
        return ranked(empty, k)
    return ranked(reduce(DataFrame.unionByName, found), k)
