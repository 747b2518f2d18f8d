import pytest

from loomledger import oracles, queries
from tests.compare import of_duck, of_spark

SQL = oracles.oracle_sql()


def test_every_query_has_sql():
    assert set(queries.queries()) == set(SQL)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_against_sql(spark, sf, duck, name):
    assert of_spark(queries.queries()[name](spark, sf)) == of_duck(duck, SQL[name])


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["actor", "balance", "entries", "conflicts"]
