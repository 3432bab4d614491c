"""Every query of the subpackage with a SQL twin gives the same rows."""

import pytest
from attest.llm.queries import QUERIES
from compare import difference, duck, spark_rows, sql_rows


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_equals_sql(spark, sf_dir, name):
    columns, rows = spark_rows(QUERIES[name].run(spark, sf_dir))
    sql_columns, expected = sql_rows(duck(sf_dir), QUERIES[name].sql)
    assert columns == sql_columns
    assert rows == expected, difference(rows, expected)
