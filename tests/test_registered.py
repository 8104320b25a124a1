"""Every registered query beside its check SQL, on whole tables at the smallest scale."""

import os

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("AMPERTIDE_SF", "/root/testdata/sf0.001")
CHECKS = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, con, name):
    res = oracle.compare(spark, con, SF, name, queries()[name], CHECKS[name])
    assert res.startswith("ok"), res


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(queries())
