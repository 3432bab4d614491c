"""Every registered query gives the same rows as its SQL twin."""

import pytest

from attest.queries import QUERIES
from compare import difference, duck, spark_rows, sql_rows


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_equals_sql(spark, sf_dir, connection, name):
    columns, rows = spark_rows(QUERIES[name].run(spark, sf_dir))
    sql_columns, expected = sql_rows(connection, QUERIES[name].sql)
    assert columns == sql_columns
    assert rows == expected, difference(rows, expected)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name].run(spark, sf_dir).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["doc_id", "source", "sha256", "action"]
