import pytest
from oracle import same

from strandloom.plans import intervals_and_load, registry

QUERIES = {**registry.QUERIES, **intervals_and_load.QUERIES}
SQL = {**registry.SQL, **intervals_and_load.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, small, name):
    same(QUERIES[name](spark, small), SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    assert registry.flagship(spark, small).count() > 0
