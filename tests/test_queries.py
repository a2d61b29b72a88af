"""Every core query on the smallest tables: equal to its SQL where it has one."""

import importlib
import os

import pytest
from compare import SMALL, connect, same

import __spark_entry__

MODULES = [importlib.import_module(m) for m in __spark_entry__._CORE]
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        same(df, con, SQL[name])
    else:
        assert df.count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name,pushed", [("S4_key_lookup", "In(o_orderkey"), ("F1_greater", "GreaterThan(hat_id"), ("G20_get_direct", "EqualTo(")])
def test_filters_reach_the_scan(spark, name, pushed):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan


def test_scans_read_few_columns(spark):
    plan = QUERIES["A1_count"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<story_id:bigint>" in plan
