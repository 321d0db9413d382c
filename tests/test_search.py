"""Search by trigrams beside a scan of all findings."""

import random

import pytest
from pyspark.sql import functions as F

from secret_audit.operators import search as X
from secret_audit.operators.listing import search


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rnd = random.Random(3)
    rows = [(f"id{i:04}", f"Repo{i // 200}", f"src/{'dir' if i % 2 else 'lib'}{i // 100}/file{i}.py", rnd.choice(["jwt_secret", "aws_access_key"]),
             rnd.choice(["A Password", "Schlüssel Ä", None, "ab", ""])) for i in range(1000)]
    found = spark.createDataFrame(rows, "id string, repo string, file_path string, type string, description string")
    base = str(tmp_path_factory.mktemp("search") / "index")
    X.write_search_index(found, base, rows_per_block=50)
    return found, base


@pytest.mark.parametrize("text", ["file777", "DIR7/", "schlüssel ä", "a p", "ab", "", "x", "secret", "nowhere", "repo3", "le77", "key"])
def test_same_rows(spark, index, text):
    found, base = index
    got = sorted(tuple(r) for r in X.search_index(spark, base, text).select(found.columns).collect())
    assert got == sorted(tuple(r) for r in search(found, text).collect())


def test_only_candidate_blocks_are_read(spark, index, monkeypatch):
    found, base = index
    assert X.candidate_blocks(spark, base, "lib9/file992").count() == 1
    few = X.search_index(spark, base, "lib9/file992")
    assert "PartitionFilters: [" in few._jdf.queryExecution().executedPlan().toString() and few.count() == 1
    assert spark.read.parquet(f"{base}/blocks").select(F.countDistinct("_block")).first()[0] == 20
    monkeypatch.setattr(X, "_NAMED", 0)
    assert X.search_index(spark, base, "secret").count() == search(found, "secret").count()


def test_many_blocks_share_few_files(spark, index, tmp_path, monkeypatch):
    """The driver samples, lists and hears from ranges, whose number does not follow that of the blocks."""
    found, _ = index
    monkeypatch.setattr(X, "_RANGE_ROWS", 300)
    base = str(tmp_path / "index")
    X.write_search_index(found, base, rows_per_block=5)
    assert len(list((tmp_path / "index" / "blocks").glob("*/*.parquet"))) <= 4
    sizes = spark.read.parquet(f"{base}/blocks").groupBy("_block").agg(F.count("*").alias("n"), F.min("file_path").alias("a"), F.max("file_path").alias("z")).collect()
    assert len(sizes) >= 200 and max(r.n for r in sizes) == 5 and sum(r.n for r in sizes) == 1000
    for text in ("file777", "secret", "le77", "ab"):
        got = sorted(tuple(r) for r in X.search_index(spark, base, text).select(found.columns).collect())
        assert got == sorted(tuple(r) for r in search(found, text).collect())
