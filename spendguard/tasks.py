"""The three scheduled steps of a spend-control workflow, with their parameters as a scheduler
passes them (text): check the budget, stop activity, resume activity.

They only compose :mod:`spendguard.plans`; control-plane calls are not made. The stop step
returns the plans and records in the audit table the actions the caller reports as done
(``outcomes``), or every planned action when no outcomes are given.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from spendguard.functions.ids import parse_targets
from spendguard.operators.job_settings import PLACEHOLDER_REMOVE
from spendguard.plans import audit
from spendguard.plans.budget import budget_check, status_values
from spendguard.plans.resume import CLEAR_ALL, run_resume
from spendguard.plans.stop import EnforcementPlan, take_snapshot
from spendguard.schemas import ALL_TARGETS, AUDIT_TABLE, DEFAULT_THRESHOLD


def audit_table_name(catalog: str, schema: str, table: str = AUDIT_TABLE) -> str:
    return ".".join(p for p in (catalog, schema, table) if p)


def check_budget(usage: DataFrame, prices: DataFrame, budget_threshold: object = DEFAULT_THRESHOLD,
                 as_of: _dt.date | str | Column | None = None) -> dict:
    """``{"budget_status": ..., "current_spend": float | None}``: the values handed to the next
    step. A month without priced usage gives ``WITHIN_BUDGET`` and ``None``."""
    status, spend = status_values(budget_check(usage, prices, budget_threshold, as_of))
    return {"budget_status": status, "current_spend": None if spend is None else float(spend)}


@dataclass(frozen=True)
class StopResult:
    plan: EnforcementPlan  # fixed rows: what was recorded is what the caller reads here
    table: str
    recorded: int  # audit rows written


def stop_activity(spark: SparkSession, *, catalog: str, schema: str, table: str = AUDIT_TABLE,
                  jobs: DataFrame, clusters: DataFrame, warehouses: DataFrame, apps: DataFrame | str | None = None,
                  runs: DataFrame | None = None, current_job_id: object = "", resumer_job_id: object = "",
                  current_cluster_id: str | None = None, target_clusters: object = ALL_TARGETS,
                  target_jobs: object = ALL_TARGETS, target_warehouses: object = ALL_TARGETS,
                  target_apps: object = ALL_TARGETS, status: DataFrame | None = None,
                  outcomes: DataFrame | None = None, stops_table: str | None = None, runs_table: str | None = None,
                  now: _dt.datetime | str | Column | None = None, run_id: str | None = None) -> StopResult:
    """Plan the stops and record them, both from one snapshot.

    ``current_job_id`` / ``resumer_job_id`` are exempt (an empty current id means "not known":
    then runs without a job id are exempt too, as in a text comparison of the two). ``status``
    gates everything (omit it to stop unconditionally, as when the step runs only after the
    check said over budget); it is computed once. ``stops_table`` and ``runs_table`` keep the plans
    as named tables (see :func:`spendguard.plans.take_snapshot`). ``run_id`` names the run, so that a
    step that is tried again records each action once. ``apps`` may be the name or path of a listing
    that is not there.
    """
    name = audit_table_name(catalog, schema, table)
    audit.ensure_table(spark, name)  # a table that cannot be created fails the step before any plan exists
    exempt = [current_job_id if current_job_id not in ("", None) else None, resumer_job_id]
    args = dict(jobs=jobs, clusters=clusters, warehouses=warehouses, apps=apps,
                job_targets=parse_targets(spark, target_jobs), cluster_targets=parse_targets(spark, target_clusters),
                warehouse_targets=parse_targets(spark, target_warehouses), app_targets=parse_targets(spark, target_apps),
                exempt_jobs=exempt, own_cluster_id=current_cluster_id)
    if status is None:
        status = spark.createDataFrame([("OVER_BUDGET", None)], "budget_status string, current_spend decimal(38,12)")
    plan = take_snapshot(status, runs=runs, stops_table=stops_table, runs_table=runs_table, **args)
    recorded = audit.record_actions(plan.stops, name, outcomes=outcomes, now=now, run_id=run_id)
    return StopResult(plan=plan, table=name, recorded=recorded)


def resume_activity(spark: SparkSession, *, catalog: str, schema: str, table: str = AUDIT_TABLE, jobs: DataFrame,
                    placeholder: str = PLACEHOLDER_REMOVE, month_filter: str | None = None,
                    as_of: _dt.date | str | Column | None = None, plan_table: str | None = None,
                    clear: str = CLEAR_ALL) -> DataFrame | None:
    """Plan the resume of everything in the audit table, then clear it (``None``: nothing to do).
    ``plan_table`` keeps the plan as a named table, and ``clear="planned"`` keeps rows that the plan
    has not read (see :func:`spendguard.plans.run_resume`)."""
    return run_resume(spark, audit_table_name(catalog, schema, table), jobs, placeholder=placeholder,
                      month_filter=month_filter, as_of=as_of, plan_table=plan_table, clear=clear)


__all__ = ["StopResult", "audit_table_name", "check_budget", "resume_activity", "stop_activity"]
