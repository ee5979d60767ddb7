import pytest

from compare import check
from gleanery.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_as_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert check(QUERIES[name](spark, sf), ORACLE_SQL[name], sf) > 0


def test_oracles_are_sql():
    assert all(isinstance(sql, str) for sql in ORACLE_SQL.values())
