"""Every check query with SQL must give the same rows in Spark and DuckDB; the others must give rows."""

import pytest

from tests.compare import compare, connect
from treespark.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, con, name):
    assert compare(spark, con, QUERIES[name], None, SF) == ""
