import pytest

import __spark_entry__ as entry
from oracle import same
from quarry.queries import ORACLES, QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_are_those_of_the_sql(spark, data, name):
    same(QUERIES[name](spark, data), ORACLES[name], data)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["term", "doc_count", "occurrences"]
    assert df.count() > 0


def test_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
