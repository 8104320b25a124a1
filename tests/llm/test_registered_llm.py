import pytest

from ampertide.llm.queries import CHECKS, QUERIES
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    res = compare(spark, con, SF, name, QUERIES[name], CHECKS.get(name))
    assert not res.startswith("BAD"), res
