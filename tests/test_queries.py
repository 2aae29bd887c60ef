"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from changelens.plans import catalogue
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLES:
        assert compare(df, con, catalogue.ORACLES[name]) is None
    else:
        assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(catalogue.CASES))
def test_case(spark, con, name):
    assert compare(catalogue.CASES[name](spark, SF), con, catalogue.CASE_ORACLES[name]) is None


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "final_score" in df.columns


def test_entry_names():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
