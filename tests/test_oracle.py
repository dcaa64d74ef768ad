import pytest

from quern.plans.catalogue import ORACLE_SQL, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    same(spark, tables, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"bfr_assign", "hybrid_predict", "competition_predict"}))
def test_query_without_sql_has_rows(spark, tables, name):
    assert QUERIES[name](spark, tables).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
