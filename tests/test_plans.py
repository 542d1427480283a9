"""Plan shapes of the registered queries: what a 100x larger input would still run on.

No query may build a cartesian product or a nested-loop join; the small sides are broadcast
after their size check, so on these inputs no sort-merge join appears either; plans that do
not aggregate shuffle nothing; the budget total crosses one exchange, carrying partial sums.
"""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

from plan_report import plan_text, summary  # noqa: E402

from spendguard.registry import QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="generated tables not present")

NO_SHUFFLE = {
    "mtd_usage", "price_as_of_usage", "jobs_not_exempt", "jobs_targeted", "job_kind", "job_stop_plan",
    "job_stop_plan_targeted", "run_cancel_plan", "run_cancel_plan_targeted", "cluster_stop_plan",
    "cluster_stop_plan_targeted", "warehouse_stop_plan", "warehouse_stop_plan_targeted", "app_stop_plan",
    "app_stop_plan_targeted", "stop_plan_union", "stop_plan_targeted", "audit_rows", "audit_rows_succeeded",
    "audit_previous_month", "resume_plan", "resume_plan_unpause_placeholder", "resume_previous_month",
    "job_paused_settings", "resume_job_settings", "resume_unknown", "app_stop_plan_all_listed", "app_stop_plan_missing",
    "targets_number_grammar", "app_stop_plan_listing_fails", "audit_rows_today", "audit_previous_month_today",
    "resume_spelled_ids",
}
ONE_EXCHANGE = {"current_spend", "budget_status", "budget_status_empty_month", "budget_report_line"}


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for name, fn in QUERIES.items():
        df = fn(spark, SF_DIR)
        df.collect()
        out[name] = plan_text(df)
    return out


SHUFFLED = {"price_as_of_usage_shuffled", "job_stop_plan_targeted_shuffled", "resume_plan_shuffled",
            "run_cancel_plan_targeted_shuffled", "jobs_not_exempt_shuffled"}
# Joined by a shuffle, with a broadcast of the levels of the index.
INDEXED = {"price_as_of_usage_versioned_shuffled"}
# These return rows that were written: their plans are a scan of the checkpoint.
WRITTEN = {"budget_status_incremental_fractional", "audit_record_once", "resume_clears_planned", "budget_status_incremental", "audit_roundtrip", "audit_append_empty", "enforcement_cycle", "resume_cycle"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_quadratic_join(plans, name):
    joins = summary(plans[name])["joins"]
    assert not {"CartesianProduct", "BroadcastNestedLoopJoin"} & set(joins), joins


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SHUFFLED - INDEXED))
def test_small_sides_are_broadcast(plans, name):
    assert "SortMergeJoin" not in summary(plans[name])["joins"]


@pytest.mark.parametrize("name", sorted(SHUFFLED))
def test_large_side_strategy_is_sort_merge(plans, name):
    joins = summary(plans[name])["joins"]
    assert joins.get("SortMergeJoin") == 1 and "BroadcastHashJoin" not in joins, joins


@pytest.mark.parametrize("name", sorted(NO_SHUFFLE))
def test_row_level_plans_do_not_shuffle(plans, name):
    assert summary(plans[name])["shuffles"] == 0, plans[name]


@pytest.mark.parametrize("name", sorted(ONE_EXCHANGE))
def test_budget_total_crosses_one_exchange(plans, name):
    s = summary(plans[name])
    assert s["shuffles"] == 1 and s["joins"] == {"BroadcastHashJoin": 1}, s
    assert "partial_sum" in plans[name]


def test_each_list_table_is_scanned_once(plans):
    # the four inventories alone; the lists were read when they were written to the checkpoint
    assert plans["stop_plan_targeted"].count("Scan parquet") == 4 and plans["stop_plan_targeted"].count("Scan ExistingRDD") >= 4


def test_month_filter_reaches_the_scan(plans):
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate,1998-06-01" in plans["budget_status"]


def _jobs(spark, name):
    sc = spark.sparkContext
    group = f"plan-{name}"
    sc.setJobGroup(group, group)
    try:
        QUERIES[name](spark, SF_DIR).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_audit_is_read_once_and_settings_are_pruned(spark, plans):
    # audit and job inventory both come from orders: one scan each when the inventory is broadcast
    assert plans["resume_plan"].count("Scan parquet") == 2


def test_an_extra_settings_field_is_not_read(spark, tmp_path):
    from spendguard.plans import resume_plan
    from spendguard.sources import fixtures as fx

    jobs = fx.jobs(spark, SF_DIR).selectExpr("job_id", "named_struct('name', settings.name, 'tasks', repeat('x', 50), 'schedule', settings.schedule, "
                                             "'continuous', settings.continuous, 'trigger', settings.trigger) AS settings")
    jobs.write.parquet(str(tmp_path / "jobs"))
    stored = spark.read.parquet(str(tmp_path / "jobs"))
    for options in ({}, {"max_broadcast_rows": 0}):
        df = resume_plan(fx.audit(spark, SF_DIR), stored, **options)
        df.collect()
        text = plan_text(df)
        assert "quartz_cron_expression" in text and "tasks" not in text


def test_gate_subquery_runs_once(spark, plans):
    # The gate's scalar subquery is pushed into every union branch but computed once: the gated
    # plan runs exactly the jobs of the budget check plus those of the ungated plan.
    assert _jobs(spark, "stop_plan_gated") == _jobs(spark, "budget_status") + _jobs(spark, "stop_plan_union")
