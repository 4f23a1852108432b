import pytest

from lifeloom.llm import queries
from tests.oracle import from_sql, rows

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    want = from_sql(sf_dir, SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) and rows(got) == rows(want)
