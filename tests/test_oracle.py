import __spark_entry__ as entry
import oracle
import pytest

from gridweft import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect("/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, con, name):
    assert oracle.compare(queries.QUERIES[name](spark, "/root/testdata/sf0.01"), con, queries.ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
