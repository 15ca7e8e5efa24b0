"""Every registered query agrees with its SQL oracle on the driver's sf0.01 tables."""

import pytest

import __spark_entry__ as entry_mod
from conftest import SF01
from parity import compare, duck
from scoreline.plans import ORACLE_SQL

KEYS = sorted(ORACLE_SQL)  # the text queries have tests of their own


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    res = compare(spark, con, key, entry_mod.queries()[key], entry_mod.oracle_sql()[key], SF01)
    assert res.get("match"), res
