"""Plan-shape guards for every registered query (the scale properties).

No cartesian or nested-loop joins, only pruned columns in scans, no Python
UDF evaluation in the plans, one partial+final aggregate pair per grouped
operator, and joins that never fan out.
"""

import re

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as E
from conftest import SF_SMALL

QUERIES = sorted(E.queries())
MODEL_QUERIES = {"train_churn", "importances"}


def plan_text(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def all_plans(spark, name, monkeypatch):
    """The plan of every table a query writes or collects on its way, and its last one."""
    plans = []

    def told(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    write, collect = DataFrameWriter.parquet, DataFrame.collect
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: told(self._df) or write(self, *a, **k))
    monkeypatch.setattr(DataFrame, "collect", lambda self: told(self) or collect(self))
    told(E.queries()[name](spark, SF_SMALL))
    return plans


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in MODEL_QUERIES])
def test_no_cross_joins_or_python_udfs(spark, name, monkeypatch):
    bad = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]
    # All but the free-style operators run no Python on the executors at all.
    if re.match("op(1|2|9|13)_", name) or not re.match("op[0-9]|pipeline|proximity", name):
        bad += ["MapInArrow", "MapInPandas", "FlatMapGroups"]
    for plan in all_plans(spark, name, monkeypatch):
        assert not [word for word in bad if word in plan], name


@pytest.mark.parametrize("name", ["kpis", "cohort_matrix", "support_churn", "plan_distribution",
                                  "signup_trend", "risk_ledger"])
def test_scans_are_pruned(spark, name):
    plan = plan_text(spark, name)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    for s in schemas:
        assert "o_custkey" not in s and "l_partkey" not in s and "l_shipdate" not in s, (name, s)


@pytest.mark.parametrize("name", ["kpis", "cohort_matrix", "signup_trend"])
def test_lineitem_join_removed_when_unused(spark, name):
    plan = plan_text(spark, name)
    assert "lineitem" not in plan, name


def test_grouped_operators_aggregate_map_side(spark):
    for name in ("cohort_matrix", "support_churn", "plan_distribution", "signup_trend"):
        plan = plan_text(spark, name)
        assert "partial_count" in plan, name


def test_ledger_orders_with_tiebreak(spark):
    plan = plan_text(spark, "risk_ledger")
    assert re.search(r"rangepartitioning\(ChurnRiskProbability#\d+ DESC NULLS LAST, CustomerID", plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
