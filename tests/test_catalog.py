import pytest
from conftest import rows_of

from granary.plans import catalog

ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, data, duck, name):
    got, wanted = catalog.queries()[name](spark, data).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows_of(got) == rows_of(wanted)


def test_queries_without_sql_run(spark, data):
    for name in sorted(set(catalog.queries()) - set(ORACLES)):
        assert catalog.queries()[name](spark, data).count() >= 0


def test_entry_imports():
    import __spark_entry__

    assert "copied_phrase" in __spark_entry__.queries()
