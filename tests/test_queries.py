import pytest
from compare import check, views

from driftwell.plans import formats, mining, probes, problems, selection, series, shots, signals

MODULES = (problems, series, mining, signals, probes, shots, formats, selection)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}


@pytest.fixture(scope="module")
def con(data):
    return views(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, data, con):
    check(QUERIES[name], SQL[name], spark, data, con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
