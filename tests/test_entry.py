import pytest

import __spark_entry__
from tessella import queries as core
from tests.compare import agree, connection


@pytest.fixture(scope="module")
def duck(small):
    return connection(small)


def test_flagship(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns[0] == "channel" and frame.count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_core_query_agrees_with_sql(spark, small, duck, name):
    agree(core.queries()[name](spark, small), duck, core.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_core_query_without_sql_runs(spark, small, name):
    assert core.queries()[name](spark, small).count() > 0
