"""Physical plans: what is shuffled, what is read, and what never appears."""

import re

import pytest

from panelwright.catalog import REGISTRY

FOLDER = "/root/testdata/sf0.001"
LAZY = ("attribution", "cleaning", "evaluation", "panels", "profiles", "statistics")
NAMES = sorted(n for n, q in REGISTRY.items() if q.run.__module__.rsplit(".", 1)[1] in LAZY)
VECTORISED = {"lag_significance"}
#: Partial moments, one line per task and column, merge in Python.
MERGED = {"pearson_matrix", "step_correlation"}


def plan_of(spark, name):
    return REGISTRY[name].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_pairwise_joins_and_no_row_functions(spark, name):
    plan = plan_of(spark, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroups"):
        assert operator not in plan or (operator == "FlatMapGroups" and name in MERGED)
    assert name in VECTORISED or "ArrowEvalPython" not in plan


def exchanges(plan):
    return len(re.findall(r"\bExchange hashpartitioning", plan))


@pytest.mark.parametrize("name", ["prefix_features", "step_features", "forward_fill", "running_dose", "running_max_repair"])
def test_windows_share_the_panel_partitioning(spark, name):
    assert exchanges(plan_of(spark, name)) == 2


@pytest.mark.parametrize("name", ["latest_trend", "last_three_events", "truth_rows", "top_attribution_groups", "checkin_verdicts"])
def test_latest_rows_are_limited_before_the_shuffle(spark, name):
    plan = plan_of(spark, name)
    assert re.search(r"WindowGroupLimit .*Partial", plan)


@pytest.mark.parametrize("name, columns", [
    ("quartiles", {"l_quantity", "l_extendedprice", "l_tax"}),
    ("auc_rank", {"l_quantity", "l_discount", "l_tax", "l_returnflag"}),
    ("crosstab_pct", {"o_orderdate", "o_orderpriority"}),
    ("retention_cascade", {"user_id", "ts", "event_type", "value"}),
])
def test_scans_read_only_what_is_used(spark, name, columns):
    read = set()
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(spark, name)):
        read |= {field.split(":")[0] for field in schema.split(",")}
    assert {c for c in read if c and "..." not in c} <= columns


def test_filters_reach_the_scan(spark):
    plan = plan_of(spark, "label_and_range_filters")
    assert "GreaterThanOrEqual(c_nationkey,2)" in plan and "LessThanOrEqual(c_nationkey,22)" in plan


@pytest.mark.parametrize("name", ["quartiles", "auc_rank", "spearman"])
def test_bounds_reuse_the_exchange_of_the_rows(spark, name):
    frame = REGISTRY[name].run(spark, FOLDER)
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final
