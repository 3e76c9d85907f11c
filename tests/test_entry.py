"""The driver contract, and every query against its SQL."""

import os

import pytest

import __spark_entry__ as entry_point
from compare import difference, duck
from rolefeed.plans.oracle import ORACLE
from rolefeed.plans.registry import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_sql_has_a_query():
    assert set(ORACLE) == set(QUERIES)
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_flagship(spark):
    rows = entry_point.entry(spark).collect()
    assert len(rows) == 407 and sum(r.posting_ord for r in rows) == 308096


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    assert difference(df, con, ORACLE[name]) is None


def test_new_per_run_totals(spark):
    rows = entry_point.queries()["new_per_run"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 1418 and sum(r.posting_ord for r in rows) == 1059197
