import pytest

from docloom.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_small, name):
    assert compare(spark, name, QUERIES[name], ORACLE_SQL[name], sf_small) is None
