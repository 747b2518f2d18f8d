import pytest

from loomledger.llm import queries
from tests.compare import of_duck, of_spark

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, sf, duck, name):
    assert of_spark(queries.queries()[name](spark, sf)) == of_duck(duck, SQL[name])
