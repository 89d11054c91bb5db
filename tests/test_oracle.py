import pytest

from tamarack.plans.registry import ORACLE_SQL, QUERIES

from .oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name], SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(QUERIES) <= set(e.queries())
