import pytest

from driver import base, catalog, check  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", sorted(base.ORACLES))
def test_matches_sql(spark, con, name):
    status, count, _, detail = check.compare(spark, con, SF, name)
    assert status == "ok", detail


NATIVE = ["rule_findings", "fiscal_signals", "section_split", "agenda_items", "tiered_correlation", "section_changes", "weekly_bills", "receipts"]


@pytest.mark.parametrize("name", NATIVE)
def test_plans_stay_in_the_jvm_without_cross_joins(spark, name):
    plan = base.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroups"):
        assert word not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = base.QUERIES["record_lookup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,77)" in plan and "o_totalprice" not in plan
