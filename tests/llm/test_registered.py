"""The registered queries of this package, and the check SQL where there is one."""

import pytest

import __spark_entry__ as entry
from secret_audit.checks.compare import compare, duck
from secret_audit.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        result = compare(spark, duck(SF), name, entry.queries()[name], ORACLES[name], SF)
        assert result["ok"], result["why"]
    else:
        assert entry.queries()[name](spark, SF).count() > 0
