"""Every query against its SQL on the smallest tables; queries without SQL must run and keep a stable schema."""

import pytest

import __spark_entry__ as entry
from parity import compare, connect

SQL = entry.oracle_sql()
NAMES = [n for m in entry.MODULES if not m.__name__.endswith("llm.queries") for n in m.QUERIES]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, con, sf_dir):
    query = entry.queries()[name]
    if name in SQL:
        assert compare(spark, con, sf_dir, query, SQL[name]) == ""
    else:
        df = query(spark, sf_dir)
        assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["ref_table", "ref_field", "period", "orphans", "targets"]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
