import pytest

from docloom.plans import ORACLE_SQL, QUERIES

from .oracle import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_small, name):
    if name in ORACLE_SQL:
        assert compare(spark, name, QUERIES[name], ORACLE_SQL[name], sf_small) is None
    else:
        assert QUERIES[name](spark, sf_small).count() > 0
