"""Both vector searches beside brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from secret_audit.llm.ann import (
    balanced_centroids, graph_search, nearest_neighbours, neighbour_graph, unit,
)
from secret_audit.llm.topk import block_search, top_inner_products

SCHEMA = "vec_id long, embedding array<float>, label int, score string, _id int"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 0, "x", 7) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def brute(ids, scores, query, k=5):
    order = sorted((-s, i) for i, s in zip(ids, scores, strict=True) if i != query)[:k]
    return [(i, -s) for s, i in order]


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(12, 16)), 150, axis=0) + rng.normal(size=(1800, 16)) * 0.7
    x = x.astype(np.float32)
    got = found(nearest_neighbours(table(spark, x.tolist()), F.col("vec_id") % 50 == 0))
    u, hits = unit(x.astype(float)), 0
    for q in range(0, 1800, 50):
        want = brute(range(1800), u @ u[q], q)
        hits += len({i for i, _ in want} & {i for i, _ in got[q]})
        assert all(abs(s - u[i] @ u[q]) < 1e-12 for i, s in got[q])
    assert hits / (36 * 5) >= 0.9


def test_graph_reaches_all_centroids():
    rng = np.random.default_rng(5)
    centers = balanced_centroids(unit(rng.normal(size=(900, 8))), 60)
    ids, near = graph_search(unit(rng.normal(size=(20, 8))), centers, neighbour_graph(centers), len(centers))
    assert all(sorted(row) == list(range(len(centers))) for row in ids.tolist())
    assert (np.diff(near, axis=1) >= 0).all()


@pytest.mark.parametrize("search", [nearest_neighbours, top_inner_products])
def test_defined_cases(spark, search):
    same = [1.0, 2.0]
    vectors = [same] * 9 + [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0], [3.0, -1.0]]
    ids = [*range(9), 100, 150, 200, 250, 300, 350, 400, 10]
    got = found(search(table(spark, [*vectors, same], [*ids, 0]), F.col("vec_id") % 50 == 0))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]  # ties to the smaller id, a repeated row is the query's own
    assert set(got) == ({0, 200} if search is top_inner_products else {0})  # others take no part or have no partner
    few = found(search(table(spark, [[1.0, 0.0], [0.0, 1.0], [2.0, 0.1]]), F.col("vec_id") == 0))
    assert [i for i, _ in few[0]] == [2, 1]
    assert search(table(spark, [[1.0]]).limit(0), F.col("vec_id") == 0).count() == 0


def test_very_large_and_small_numbers(spark):
    vectors = [[1e38, 1e38], [1e38, 0.0], [1e-40, 1e-40], [2.0, 1.0]]
    got = found(nearest_neighbours(table(spark, vectors), F.col("vec_id") == 0))
    assert [i for i, _ in got[0]] == [2, 3, 1]


def test_exact_products(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(700, 20)), 1).astype(np.float32)  # many ties
    x[:200] = x[0]
    got = found(top_inner_products(table(spark, x.tolist()), F.col("vec_id") % 50 == 0, block_rows=100, query_rows=5))
    whole = np.floor(256 * x.astype(float)).astype(np.int64)
    for q in range(0, 700, 50):
        assert got[q] == brute(range(700), (whole @ whole[q]).tolist(), q)


def test_products_beyond_double_precision():
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 29), 1 << 29, size=(60, 6))
    q, i, s, _ = block_search(np.arange(60), x / 256, np.arange(60), x / 256, 3)
    for n in range(60):
        own = q == n
        want = brute(range(60), [sum(int(a) * int(b) for a, b in zip(x[n], r, strict=True)) for r in x], n, 3)
        assert list(zip(i[own].tolist(), s[own].tolist(), strict=True)) == want


def whole(x):
    return [math.floor(Fraction(v) * 256) for v in x]


@pytest.mark.parametrize("spread", [(-3, 12), (-3, 3), (5, 8), (14, 19), (-300, 307)])
def test_products_of_any_size(spark, spread):
    """Every finite vector takes part; ranks follow exact integers, also where a score doesn't fit a long."""
    rng = np.random.default_rng(4)
    x = rng.choice([-1.0, 1.0], (250, 5)) * 10.0 ** rng.uniform(*spread, (250, 5))
    x[:40] = x[0]
    x[40:60, 1:] = 0
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = found(top_inner_products(df, F.col("vec_id") % 25 == 0, block_rows=70, query_rows=6))
    rows = [whole(v) for v in x.tolist()]
    for q in range(0, 250, 25):
        want = brute(range(250), [sum(a * b for a, b in zip(rows[q], r, strict=True)) for r in rows], q)
        assert got[q] == [(i, max(-(1 << 63), min((1 << 63) - 1, s))) for i, s in want]


def test_one_huge_candidate(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1e8, 0.0]), (2, [3.0, 0.0]), (3, [1.7e308, -1.7e308])], "vec_id long, embedding array<double>")
    assert found(top_inner_products(df, F.col("vec_id") == 0))[0] == [(3, (1 << 63) - 1), (1, 6_553_600_000_000), (2, 196_608)]
