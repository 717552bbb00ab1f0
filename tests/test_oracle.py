"""Every registered query runs; those with SQL return the same rows as DuckDB."""

import os

import pytest
from oracle import compare, duck

from plumeflux.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SLOW = {"k02_cross_sectional_flux", "k08_flux_pipeline"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, SF, name, con)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_returns_rows(spark, name):
    ok, note = compare(spark, SF, name)
    assert ok, note


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "k05_match_emissions" in entry.queries()
