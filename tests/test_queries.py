"""Every registered query beside its check SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from secret_audit.checks import load
from secret_audit.checks.compare import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {name: entry.queries()[name] for name in load()[0]}
ORACLES = load()[1]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_check_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name in ("scan_pages", "scan_documents") and SF.endswith("sf0.001"):
        pytest.skip("the smallest tables hold no match")
    result = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert result["ok"], result["why"]
    assert result["rows"] > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
