import pytest

from quern.llm.registry import ORACLE_SQL, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    same(spark, tables, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_covers_the_table(spark, tables, name):
    table = "conversations" if name.startswith("op5") else "documents"
    key = "conv_id" if name.startswith("op5") else "doc_id"
    want = {r[0] for r in spark.read.parquet(f"{tables}/{table}.parquet").select(key).distinct().collect()} | ({-1} if key == "conv_id" else set())
    assert {r[0] for r in QUERIES[name](spark, tables).select(key).collect()} == want
