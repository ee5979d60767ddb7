import pytest

from compare import check
from gleanery.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_as_its_sql(spark, name):
    assert check(QUERIES[name](spark, SF), ORACLE_SQL[name], SF) > 0


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_is_text():
    assert all(isinstance(v, str) and k in QUERIES for k, v in ORACLE_SQL.items())
