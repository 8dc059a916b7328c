"""Every registered query against its SQL on the test tables."""

import pytest

import __spark_entry__ as entry_points
from tests.compare import connect, differences
from tests.conftest import SF_DIR

QUERIES, SQL = entry_points.QUERIES, entry_points.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql_without_pairing_all_rows(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    assert differences(df, duck, SQL[name]) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0
