"""The shuffle strategies taken beyond the broadcast bound give exactly the broadcast results,
on the whole fixture tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from spendguard.functions import explode_target_lists
from spendguard.plans import budget_check, job_stop_plan, price_usage, resume_plan
from spendguard.plans import audit as audit_plan
from spendguard.sources import fixtures as fx

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="generated tables not present")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def joins_by_sort_merge(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_range_join_salted_shuffle_equals_broadcast(spark):
    u, p = fx.usage(spark, SF_DIR), fx.list_prices(spark, SF_DIR)
    small = price_usage(u, p)
    salted = price_usage(u, p, max_broadcast_rows=0, salt_buckets=7)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert rows(salted) == rows(small)
    assert joins_by_sort_merge(salted)
    assert rows(budget_check(u, p, as_of=fx.AS_OF, max_broadcast_rows=0)) == rows(budget_check(u, p, as_of=fx.AS_OF))


def test_semi_join_shuffle_equals_broadcast(spark):
    jobs = fx.jobs(spark, SF_DIR)
    targets = explode_target_lists(fx.target_lists(spark, SF_DIR, "JOB"))
    a = job_stop_plan(jobs, targets=targets, exempt=fx.EXEMPT_JOBS)
    b = job_stop_plan(jobs, targets=targets, exempt=fx.EXEMPT_JOBS, max_broadcast_rows=0)
    assert len(rows(a)) > 0 and rows(a) == rows(b)
    assert joins_by_sort_merge(b)


def test_resume_shuffle_equals_broadcast(spark):
    audit, jobs = fx.audit(spark, SF_DIR), fx.jobs(spark, SF_DIR)
    shuffled = resume_plan(audit, jobs, max_broadcast_rows=0)
    assert rows(resume_plan(audit, jobs)) == rows(shuffled)
    assert joins_by_sort_merge(shuffled)


def test_outcome_semi_join_shuffle_equals_broadcast(spark):
    from spendguard.registry import _plan
    plan, outcomes = _plan(spark, SF_DIR), fx.outcomes(spark, SF_DIR)
    a = audit_plan.succeeded(plan, outcomes)
    b = audit_plan.succeeded(plan, outcomes, max_broadcast_rows=0)
    assert len(rows(a)) > 0 and rows(a) == rows(b)
    assert joins_by_sort_merge(b)


def test_hot_sku_is_split_across_tasks(spark):
    """One SKU holds a third of all usage: beyond the broadcast bound its rows are spread over
    several join tasks by the time-hash salt instead of landing in one."""
    import datetime as dt
    from decimal import Decimal

    from spendguard import schemas as S

    start = dt.datetime(2026, 4, 1)
    usage_rows = []
    for i in range(3000):
        sku = "HOT" if i % 3 == 0 else f"S{i % 97}"
        t = start + dt.timedelta(minutes=7 * i)
        usage_rows.append((sku, Decimal(1), t, t.date()))
    usage = spark.createDataFrame(usage_rows, S.USAGE)
    skus = ["HOT"] + [f"S{k}" for k in range(97)]
    prices = spark.createDataFrame([(s, dt.datetime(2026, 1, 1), None, ((Decimal(2),),)) for s in skus], S.LIST_PRICES)
    # Keep AQE from merging the small test partitions back into one.
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        priced = price_usage(usage, prices, max_broadcast_rows=0, salt_buckets=16)
        hot = priced.filter(F.col("sku_name") == "HOT").select(F.spark_partition_id().alias("p"))
        tasks = hot.distinct().count()
        assert "BroadcastHashJoin" not in priced._jdf.queryExecution().executedPlan().toString()
        assert priced.count() == 3000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert tasks >= 4, tasks


def test_hot_job_id_in_audit_is_split_by_aqe(spark):
    """A job id holding a third of the audit rows: on the shuffle path AQE splits its partition
    (the thresholds are lowered to this data size here; the defaults suit large data)."""
    import datetime as dt

    from spendguard import schemas as S

    now = dt.datetime(2026, 4, 20)
    rows = [("JOB", "STOPPED", "7" if i % 3 == 0 else str(1000 + i), None, now, "budget_enforcer", "2026-04")
            for i in range(6000)]
    audit = spark.createDataFrame(rows, S.AUDIT)
    jobs = spark.createDataFrame([(7, ("hot", ("0 0 8 * * ?", "UTC", "PAUSED"), None, None))] +
                                 [(1000 + i, None) for i in range(6000)], S.JOBS)
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        plan = resume_plan(audit, jobs, max_broadcast_rows=0)
        counts = {r.resume_action: r.n for r in plan.groupBy("resume_action").agg(F.count(F.lit(1)).alias("n")).collect()}
        final = resume_plan(audit, jobs, max_broadcast_rows=0)
        final.collect()
        text = final._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert counts == {"UNPAUSE": 2000, "FAILED": 4000}
    assert "SortMergeJoin(skew=true)" in text
