"""Every named query against its DuckDB twin on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
import compare
from conftest import SF

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    assert compare.differences(QUERIES[name](spark, SF), con, ORACLES[name]) == []


# Model fits have too little data at this scale to be meaningful; these still have to run.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "diff_win_rate_last_3" in df.columns
