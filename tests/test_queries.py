"""Registered queries against their SQL. ORACLE_TESTS=all checks every one of them."""

import os

import pytest

import __spark_entry__ as entry
import bench
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES, QUERIES = entry.oracle_sql(), entry.queries()
NAMES = [n for n in QUERIES if n in ORACLES] if os.environ.get("ORACLE_TESTS") == "all" else [n for n in bench.HEADLINE if n in ORACLES]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "quality_score" in out.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], ORACLES[name]) is None
