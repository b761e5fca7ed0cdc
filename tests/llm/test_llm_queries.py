import pytest

from tessella.llm import oracle, queries
from tests.compare import agree, connection


@pytest.fixture(scope="module")
def duck(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_agrees_with_sql(spark, small, duck, name):
    agree(queries.queries()[name](spark, small), duck, oracle.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracle.oracle_sql())))
def test_query_without_sql_runs(spark, small, name):
    assert queries.queries()[name](spark, small).count() > 0
