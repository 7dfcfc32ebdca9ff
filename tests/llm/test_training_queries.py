import pytest
from compare import check, views

from driftwell.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(name, spark, data):
    check(Q.QUERIES[name], Q.SQL[name], spark, data, views(data))


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(name, spark, data):
    df = Q.QUERIES[name](spark, data)
    assert df.columns and df.count() > 0
