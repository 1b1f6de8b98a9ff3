import pytest
from oracle_check import compare, connect

from seqloom.llm.queries import oracle, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(oracle()))
def test_query_equals_sql(spark, con, name):
    assert compare(queries()[name](spark, SMALL), con, oracle()[name]) == ""
