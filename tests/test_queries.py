"""Every named query against its SQL, and the driver contract."""

import oracle
import pytest

from __spark_entry__ import entry
from __spark_entry__ import oracle_sql as all_sql
from __spark_entry__ import queries as all_queries
from eventmetrics.plans.registry import oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
# At this scale these inputs hold no row that qualifies.
MAY_BE_EMPTY = {"partition_gate"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_contract(spark):
    assert set(oracle_sql()) == set(queries())
    assert queries().keys() <= all_queries().keys()
    assert oracle_sql().keys() <= all_sql().keys() <= all_queries().keys()
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    found = oracle.compare(spark, con, queries()[name], oracle_sql()[name], SF_DIR)
    assert found == "" or (name in MAY_BE_EMPTY and found == "both sides are empty")


@pytest.mark.parametrize(
    "name",
    [
        "overview_delta",
        "ts_bounce_rate_hour",
        "breakdown",
        "alert_values",
        "alert_replay_muted",
        "widget_results",
        "report_sections",
        "key_attribution",
        "admission",
        "source_gate_batch",
        "statement_screen",
    ],
)
def test_plan_has_no_cross_join_and_no_python(spark, name):
    plan = queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert operator not in plan


def test_plans_reach_the_scan(spark):
    plan = queries()["overview_delta"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan
    assert "props" not in plan.split("ReadSchema")[1]
    top = queries()["breakdown"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert top.count("FileScan") == 1 and "WindowGroupLimit" in top
