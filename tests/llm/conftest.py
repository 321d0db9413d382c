import pytest

EXTRA = {"score": "kept", "_id": 1, "Text_": "x"}


@pytest.fixture
def docs(spark):
    """Make a documents table with columns whose names clash with those that operators use inside."""
    def make(rows, schema="doc_id long, text string"):
        own = f"{schema}, score string, _id int, _row int, slot string, is_toxic string"
        return spark.createDataFrame([(*r, "s", 1, 2, "t", "u") for r in rows], own)

    return make
