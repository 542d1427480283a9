"""The three workflow steps with scheduler-style text parameters."""

from __future__ import annotations

import datetime as dt
import os
import uuid

import pytest

from conftest import ids, job
from spendguard import schemas as S
from spendguard.plans import audit
from spendguard.sources import fixtures as fx
from spendguard.tasks import audit_table_name, check_budget, resume_activity, stop_activity

SF_DIR = "/root/testdata/sf0.001"
NOW = dt.datetime(2026, 4, 20, 8, 0)


def _inv(spark, jobs_df, clusters_df):
    return dict(
        jobs=jobs_df([job(i) for i in (100, 200, 300, 400, 500)]),
        clusters=clusters_df([("c1", "C1", "RUNNING"), ("c2", "C2", "RUNNING"), ("own", "Own", "RUNNING")]),
        warehouses=spark.createDataFrame([("w1", "W1", "RUNNING"), ("w2", "W2", "STOPPED")], S.WAREHOUSES),
        apps=spark.createDataFrame([("my-app",), ("other",)], S.APPS),
        runs=spark.createDataFrame([(1, 100, True), (2, 200, True), (3, None, True)], S.RUNS),
    )


def test_table_name():
    assert audit_table_name("cat", "budget_control") == "cat.budget_control.paused_jobs"
    assert audit_table_name("", "sch", "t") == "sch.t"


def test_stop_activity_with_text_parameters(spark, jobs_df, clusters_df):
    schema = f"sg_task_{uuid.uuid4().hex[:8]}"
    res = stop_activity(spark, catalog="", schema=schema, current_job_id="100", resumer_job_id="300",
                        current_cluster_id="own", target_jobs=" 200 , 4e2 ,", target_clusters="ALL",
                        target_warehouses="", target_apps="my-app", now=NOW, **_inv(spark, jobs_df, clusters_df))
    assert res.recorded and res.table == f"{schema}.paused_jobs"
    got = sorted((r.resource_type, r.resource_id) for r in audit.read_audit(spark, res.table).collect())
    assert got == [("APP", "my-app"), ("CLUSTER", "c1"), ("CLUSTER", "c2"), ("JOB", "200"), ("JOB", "400"),
                   ("WAREHOUSE", "w1")]
    assert ids(res.plan.runs, "run_id") == [2]


def test_unknown_current_job_exempts_runs_without_job(spark, jobs_df, clusters_df):
    schema = f"sg_task_{uuid.uuid4().hex[:8]}"
    res = stop_activity(spark, catalog="", schema=schema, current_job_id="", resumer_job_id="300",
                        now=NOW, **_inv(spark, jobs_df, clusters_df))
    assert ids(res.plan.runs, "run_id") == [1, 2]


def test_stop_activity_gated_within_budget(spark, jobs_df, clusters_df):
    schema = f"sg_task_{uuid.uuid4().hex[:8]}"
    status = spark.createDataFrame([("WITHIN_BUDGET", None)], "budget_status string, current_spend decimal(38,12)")
    res = stop_activity(spark, catalog="", schema=schema, status=status, now=NOW, **_inv(spark, jobs_df, clusters_df))
    assert not res.recorded and res.plan.runs.count() == 0


def test_resume_activity(spark, jobs_df, clusters_df):
    schema = f"sg_task_{uuid.uuid4().hex[:8]}"
    inv = _inv(spark, jobs_df, clusters_df)
    stop_activity(spark, catalog="", schema=schema, current_job_id="100", resumer_job_id="300", now=NOW, **inv)
    plan = resume_activity(spark, catalog="", schema=schema, jobs=inv["jobs"])
    assert sorted((r.resource_id, r.resume_action) for r in plan.filter("resource_type = 'JOB'").collect()) == [
        ("200", "UNPAUSE"), ("400", "UNPAUSE"), ("500", "UNPAUSE")]
    assert resume_activity(spark, catalog="", schema=schema, jobs=inv["jobs"]) is None


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="generated tables not present")
def test_check_budget_values(spark):
    got = check_budget(fx.usage(spark, SF_DIR), fx.list_prices(spark, SF_DIR), "50000", fx.AS_OF)
    assert got["budget_status"] == "OVER_BUDGET" and isinstance(got["current_spend"], float)
    empty = check_budget(fx.usage(spark, SF_DIR), fx.list_prices(spark, SF_DIR), "50000", dt.date(2030, 1, 1))
    assert empty == {"budget_status": "WITHIN_BUDGET", "current_spend": None}
