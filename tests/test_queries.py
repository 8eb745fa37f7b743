import os

import pytest
from oracle import compare, duck

import __spark_entry__ as entry
from tabsift.catalog import QUERIES, SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_its_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())


# Operators no plan may hold: they pair every row with every row, or call Python row by row.
REFUSED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    problem = compare(df, con, SQL[name])
    assert problem is None, problem
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [op for op in REFUSED if op in plan]
