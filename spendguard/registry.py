"""The registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame`` over the
whole fixture tables derived from ``sf_dir``. Decimal outputs are cast to double and nested
settings are flattened, so that the DuckDB oracle in :mod:`spendguard.oracle` can be compared
column for column.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendguard.functions.ids import explode_target_lists, normalize_id
from spendguard.functions.money import with_double
from spendguard.operators.job_settings import PLACEHOLDER_UNPAUSE, current_pause_status, job_kind
from spendguard.operators.selection import drop_exempt, only_targets
from spendguard.plans import audit as audit_plan
from spendguard.plans.budget import (
    budget_check,
    budget_status_of,
    current_spend,
    month_to_date,
    price_usage,
    price_usage_in_doubles,
    report_line,
    task_values,
)
from spendguard.plans.resume import resume_plan, run_resume
from spendguard.plans.stop import (
    action_counts,
    app_stop_plan,
    enforcement_plan,
    cluster_stop_plan,
    gated_stop_plan,
    job_stop_plan,
    run_cancel_plan,
    stop_plan,
    take_snapshot,
    warehouse_stop_plan,
)
from spendguard.schemas import APP, AUDIT, AUDIT_COLUMNS, CLUSTER, JOB, WAREHOUSE
from spendguard.session import checkpoint_dir
from spendguard.streaming.incremental import read_usage_totals, start_usage_totals
from spendguard.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

EMPTY_MONTH_AS_OF = _dt.date(2030, 1, 15)
UNREACHABLE_THRESHOLD = 10 ** 15


def flat_settings(settings: Column, prefix: str = "new_") -> list[Column]:
    return [
        settings.schedule.quartz_cron_expression.alias(f"{prefix}schedule_cron"),
        settings.schedule.timezone_id.alias(f"{prefix}schedule_timezone"),
        settings.schedule.pause_status.alias(f"{prefix}schedule_pause_status"),
        settings.continuous.pause_status.alias(f"{prefix}continuous_pause_status"),
        settings.trigger.file_arrival.alias(f"{prefix}trigger_file_arrival"),
        settings.trigger.table_update.alias(f"{prefix}trigger_table_update"),
        settings.trigger.pause_status.alias(f"{prefix}trigger_pause_status"),
    ]


def _targets(spark: SparkSession, d: str, resource_type: str) -> DataFrame:
    return explode_target_lists(fx.target_lists(spark, d, resource_type)).select("target_id", "all_targets")


def _scratch_name(kind: str) -> str:
    """A table name of this call alone, so that concurrent runs do not meet."""
    return f"spendguard_{kind}_{uuid.uuid4().hex}"


def _kept(rows: DataFrame, *tables: str) -> DataFrame:
    """The rows in the checkpoint folder, and the tables they were read from dropped."""
    spark = rows.sparkSession
    checkpoint_dir(spark)
    rows = rows.checkpoint(eager=True)
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {audit_plan.quote_name(table)}")
    return rows


def _wall_clock(audit: DataFrame) -> DataFrame:
    """The audit table's instants as the session's wall clock shows them."""
    return audit.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def _status(spark: SparkSession, d: str, threshold: object = fx.THRESHOLD, as_of=fx.AS_OF) -> DataFrame:
    return budget_check(fx.usage(spark, d), fx.list_prices(spark, d), threshold, as_of)


def _money(df: DataFrame) -> DataFrame:
    return df.withColumn("current_spend", F.col("current_spend").cast("double"))


def _plan(spark: SparkSession, d: str, targeted: bool = False) -> DataFrame:
    t = (lambda rt: _targets(spark, d, rt)) if targeted else (lambda rt: None)
    return stop_plan(
        jobs=fx.jobs(spark, d), clusters=fx.clusters(spark, d), warehouses=fx.warehouses(spark, d),
        apps=fx.apps(spark, d), job_targets=t(JOB), cluster_targets=t(CLUSTER), warehouse_targets=t(WAREHOUSE),
        app_targets=t(APP), exempt_jobs=fx.EXEMPT_JOBS, own_cluster_id=fx.OWN_CLUSTER)


def _flat_job_plan(df: DataFrame) -> DataFrame:
    return df.select("job_id", "job_name", "job_kind", "previous_pause_status", *flat_settings(F.col("new_settings")))


def _flat_resume(df: DataFrame) -> DataFrame:
    return df.select(*AUDIT_COLUMNS, "resume_action", "job_id", *flat_settings(F.col("new_settings")))


# --- budget --------------------------------------------------------------------------------------

def q_mtd_usage(spark, d):
    u = month_to_date(fx.usage(spark, d), fx.AS_OF)
    return u.withColumn("usage_quantity", F.col("usage_quantity").cast("double"))


PRICED_COLUMNS = ("sku_name", "usage_end_time", "usage_date", "usage_quantity", "unit_price", "line_cost", "price_start_time", "price_end_time")


def _flat_priced(priced: DataFrame) -> DataFrame:
    return with_double(priced, "line_cost").select(
        *[F.col(c).cast("double").alias(c) if c in ("usage_quantity", "unit_price") else c for c in PRICED_COLUMNS])


def q_price_as_of_usage(spark, d):
    return _flat_priced(price_usage(fx.usage(spark, d), fx.list_prices(spark, d)))


def q_price_as_of_usage_shuffled(spark, d):
    """The same join by its strategy beyond the broadcast bound (salted sort-merge join)."""
    return _flat_priced(price_usage(fx.usage(spark, d), fx.list_prices(spark, d), max_broadcast_rows=0))


def q_current_spend(spark, d):
    priced = price_usage(month_to_date(fx.usage(spark, d), fx.AS_OF), fx.list_prices(spark, d))
    return _money(current_spend(priced))


def q_budget_status(spark, d):
    return task_values(_status(spark, d))


def q_budget_status_incremental(spark, d):
    """The budget check over totals that a file stream summed as the usage arrived."""
    table = _scratch_name("usage_totals")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{table}"
    start_usage_totals(fx.usage_stream(spark, d), table=table, checkpoint=folder).awaitTermination()
    status = budget_check(read_usage_totals(spark, table), fx.list_prices(spark, d), fx.THRESHOLD, fx.AS_OF)
    return _kept(task_values(status), table)


def _to_the_last_place(spend: DataFrame, batch: DataFrame) -> DataFrame:
    """The total with all its decimal places, its status, and whether it passes the batch total."""
    at_batch = budget_status_of(spend, batch.select("current_spend").scalar()).select("budget_status").scalar()
    return budget_status_of(spend, fx.THRESHOLD).select(
        "budget_status", F.col("current_spend").cast("string").alias("current_spend"), at_batch.alias("status_at_spend"))


def _fractional_spend(spark, d, usage):
    return current_spend(price_usage(month_to_date(usage, fx.AS_OF), fx.fractional_prices(spark, d)))


def q_budget_status_fractional(spark, d):
    """Quantities and prices with six decimal places: the total has twelve."""
    spend = _fractional_spend(spark, d, fx.fractional_usage(spark, d))
    return _to_the_last_place(spend, spend)


def q_budget_status_incremental_fractional(spark, d):
    """The same total from usage that was summed before it was priced."""
    table = _scratch_name("usage_totals")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{table}"
    start_usage_totals(fx.fractional_usage(spark, d, stream=True), table=table, checkpoint=folder).awaitTermination()
    spend = _fractional_spend(spark, d, read_usage_totals(spark, table))
    return _kept(_to_the_last_place(spend, _fractional_spend(spark, d, fx.fractional_usage(spark, d))), table)


def q_budget_status_today(spark, d):
    """The check by the session's own date (no ``as_of``)."""
    return task_values(budget_check(fx.usage_today(spark, d), fx.prices_today(spark, d), fx.THRESHOLD))


def q_price_as_of_usage_versioned(spark, d):
    """A SKU with a price version for every part: found through the index over time."""
    return price_usage_in_doubles(fx.hot_usage(spark, d), fx.hot_prices(spark, d)).select(*PRICED_COLUMNS)


def q_price_as_of_usage_versioned_shuffled(spark, d):
    return price_usage_in_doubles(fx.hot_usage(spark, d), fx.hot_prices(spark, d), max_broadcast_rows=0).select(*PRICED_COLUMNS)


def q_budget_status_at_spend(spark, d):
    """Threshold equal to the exact month-to-date spend: strictly above it is over budget, so
    this is within budget."""
    spend = current_spend(price_usage(month_to_date(fx.usage(spark, d), fx.AS_OF), fx.list_prices(spark, d)))
    return task_values(budget_status_of(spend, spend.select("current_spend").scalar()))


def q_budget_status_empty_month(spark, d):
    return task_values(_status(spark, d, as_of=EMPTY_MONTH_AS_OF))


def q_budget_report_line(spark, d):
    return report_line(_status(spark, d), fx.THRESHOLD)


# --- targets, exemptions -------------------------------------------------------------------------

def q_targets_parsed(spark, d):
    return explode_target_lists(fx.target_lists(spark, d)).distinct()


def q_targets_number_grammar(spark, d):
    """Items in many spellings of a number, digits of several scripts and numbers of any size."""
    return fx.number_items(spark, d).select("item", normalize_id("item").alias("target_id"))


def q_jobs_not_exempt(spark, d):
    return drop_exempt(fx.jobs(spark, d), "job_id", fx.EXEMPT_JOBS).select("job_id")


def q_jobs_not_exempt_shuffled(spark, d):
    """A table of exempt ids, by the strategy beyond the broadcast bound."""
    return drop_exempt(fx.jobs(spark, d), "job_id", _targets(spark, d, JOB), max_broadcast_rows=0).select("job_id")


def q_jobs_targeted(spark, d):
    return only_targets(fx.jobs(spark, d), "job_id", _targets(spark, d, JOB)).select("job_id")


def q_job_kind(spark, d):
    s = F.col("settings")
    jobs = fx.jobs(spark, d).filter(s.isNotNull())
    return jobs.select("job_id", job_kind(s).alias("job_kind"), current_pause_status(s).alias("previous_pause_status"))


# --- stop plans ----------------------------------------------------------------------------------

def q_job_stop_plan(spark, d):
    return _flat_job_plan(job_stop_plan(fx.jobs(spark, d), exempt=fx.EXEMPT_JOBS))


def q_job_stop_plan_targeted(spark, d):
    return _flat_job_plan(job_stop_plan(fx.jobs(spark, d), targets=_targets(spark, d, JOB), exempt=fx.EXEMPT_JOBS))


def q_job_stop_plan_targeted_shuffled(spark, d):
    return _flat_job_plan(job_stop_plan(fx.jobs(spark, d), targets=_targets(spark, d, JOB), exempt=fx.EXEMPT_JOBS,
                                        max_broadcast_rows=0))


def q_job_paused_settings(spark, d):
    """Only the settings that pause each job (the update a caller would send)."""
    plan = job_stop_plan(fx.jobs(spark, d), exempt=fx.EXEMPT_JOBS)
    return plan.select("job_id", *flat_settings(F.col("new_settings")))


def q_run_cancel_plan(spark, d):
    return run_cancel_plan(fx.runs(spark, d), exempt=fx.EXEMPT_JOBS)


def q_run_cancel_plan_targeted(spark, d):
    return run_cancel_plan(fx.runs(spark, d), targets=_targets(spark, d, JOB), exempt=fx.EXEMPT_JOBS)


def q_run_cancel_plan_targeted_shuffled(spark, d):
    return run_cancel_plan(fx.runs(spark, d), targets=_targets(spark, d, JOB), exempt=fx.EXEMPT_JOBS, max_broadcast_rows=0)


def q_cluster_stop_plan(spark, d):
    return cluster_stop_plan(fx.clusters(spark, d), own_cluster_id=fx.OWN_CLUSTER)


def q_cluster_stop_plan_targeted(spark, d):
    return cluster_stop_plan(fx.clusters(spark, d), targets=_targets(spark, d, CLUSTER), own_cluster_id=fx.OWN_CLUSTER)


def q_warehouse_stop_plan(spark, d):
    return warehouse_stop_plan(fx.warehouses(spark, d))


def q_warehouse_stop_plan_targeted(spark, d):
    return warehouse_stop_plan(fx.warehouses(spark, d), targets=_targets(spark, d, WAREHOUSE))


def q_app_stop_plan(spark, d):
    return app_stop_plan(fx.apps(spark, d))


def q_app_stop_plan_targeted(spark, d):
    return app_stop_plan(fx.apps(spark, d), targets=_targets(spark, d, APP))


def q_app_stop_plan_all_listed(spark, d):
    """A table of lists of which some say ALL: every app."""
    return app_stop_plan(fx.apps(spark, d), targets=_targets(spark, d, fx.EDGE))


def q_app_stop_plan_missing(spark, d):
    """The whole stop plan when the app listing is not available."""
    return stop_plan(**{**_plan_args(spark, d), "apps": None})


def q_app_stop_plan_listing_fails(spark, d):
    """The whole stop plan when the app listing is named but is not there."""
    return stop_plan(**{**_plan_args(spark, d), "apps": f"{d.rstrip('/')}/app_listing.parquet"})


def q_stop_plan_union(spark, d):
    return _plan(spark, d)


def q_stop_plan_targeted(spark, d):
    return _plan(spark, d, targeted=True)


def q_stop_plan_gated(spark, d):
    return gated_stop_plan(_status(spark, d), **_plan_args(spark, d))


def q_stop_plan_gated_within(spark, d):
    return gated_stop_plan(_status(spark, d, threshold=UNREACHABLE_THRESHOLD), **_plan_args(spark, d))


def _plan_args(spark, d):
    return dict(jobs=fx.jobs(spark, d), clusters=fx.clusters(spark, d), warehouses=fx.warehouses(spark, d),
                apps=fx.apps(spark, d), exempt_jobs=fx.EXEMPT_JOBS, own_cluster_id=fx.OWN_CLUSTER)


def q_run_cancel_plan_gated(spark, d):
    return enforcement_plan(_status(spark, d), runs=fx.runs(spark, d), **_plan_args(spark, d)).runs


def q_action_counts(spark, d):
    return action_counts(_plan(spark, d))


# --- audit ---------------------------------------------------------------------------------------

def q_audit_rows(spark, d):
    return audit_plan.audit_rows(_plan(spark, d), fx.NOW)


def q_audit_rows_succeeded(spark, d):
    return audit_plan.audit_rows(audit_plan.succeeded(_plan(spark, d), fx.outcomes(spark, d)), fx.NOW)


def q_audit_previous_month(spark, d):
    return audit_plan.filter_month(fx.audit(spark, d), month_filter=audit_plan.MONTH_PREVIOUS, as_of=fx.AS_OF)


def q_audit_roundtrip(spark, d):
    """Append the gated plan's audit rows twice (the second append must add, not replace) to a table
    that exists with its columns in another order and one more, and read it back."""
    table = _scratch_name("audit_roundtrip")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reversed(AUDIT.fields))
    spark.sql(f"CREATE TABLE {audit_plan.quote_name(table)} (note STRING, {columns}) USING parquet")
    rows = audit_plan.audit_rows(gated_stop_plan(_status(spark, d), **_plan_args(spark, d)), fx.NOW)
    audit_plan.append(rows, table)
    audit_plan.append(rows.select(*reversed(rows.columns)), table)
    return _kept(_wall_clock(audit_plan.read_audit(spark, table)), table)


def q_audit_append_empty(spark, d):
    """In a schema of its own: the plan is recorded, and a later run within the budget adds nothing."""
    schema = _scratch_name("schema")
    table = f"{schema}.paused_jobs"
    over = audit_plan.audit_rows(gated_stop_plan(_status(spark, d), **_plan_args(spark, d)), fx.NOW)
    within = audit_plan.audit_rows(gated_stop_plan(_status(spark, d, UNREACHABLE_THRESHOLD), **_plan_args(spark, d)), fx.NOW)
    audit_plan.append(over, table)
    added = audit_plan.append(within, table)
    out = _kept(_wall_clock(audit_plan.read_audit(spark, table)).withColumn("added_within", F.lit(added).cast("long")), table)
    spark.sql(f"DROP SCHEMA {schema}")
    return out


def q_enforcement_cycle(spark, d):
    """One control run: the plan is fixed once, the calls report their outcomes, and what they did is
    recorded from the same plan."""
    table = _scratch_name("audit")
    plan = take_snapshot(_status(spark, d), runs=fx.runs(spark, d), **_plan_args(spark, d))
    audit_plan.record_actions(plan.stops, table, outcomes=fx.outcomes(spark, d), now=fx.NOW)
    return _kept(_wall_clock(audit_plan.read_audit(spark, table)), table)


def q_audit_rows_today(spark, d):
    """Rows stamped by the session's own clock: their day and their month."""
    return audit_plan.audit_rows(_plan(spark, d)).withColumn("day", F.to_date("timestamp")).drop("timestamp")


def q_audit_previous_month_today(spark, d):
    return audit_plan.filter_month(fx.audit_today(spark, d), month_filter=audit_plan.MONTH_PREVIOUS)


def q_audit_record_once(spark, d):
    """A control run whose recording step is tried again after more calls succeeded, and the next run:
    each action stands once a run."""
    table = _scratch_name("audit")
    plan = _plan(spark, d).checkpoint(eager=True) if checkpoint_dir(spark) else None
    outcomes = fx.outcomes(spark, d)
    first = audit_plan.record_actions(plan, table, outcomes=outcomes, now=fx.NOW, run_id="run-1")
    again = audit_plan.record_actions(plan, table, outcomes=outcomes, now=fx.NOW, run_id="run-1")
    rest = audit_plan.record_actions(plan, table, outcomes=outcomes.withColumn("ok", F.lit(True)), now=fx.NOW, run_id="run-1")
    audit_plan.record_actions(plan.where("resource_type = 'APP'"), table, now=fx.NOW, run_id="run-2")
    found = _wall_clock(spark.table(audit_plan.quote_name(table)))
    counts = {"recorded_first": first, "recorded_again": again, "recorded_rest": rest}
    return _kept(found.withColumns({k: F.lit(v).cast("long") for k, v in counts.items()}), table)


# --- resume --------------------------------------------------------------------------------------

def q_resume_plan(spark, d):
    return _flat_resume(resume_plan(fx.audit(spark, d), fx.jobs(spark, d)))


def q_resume_plan_unpause_placeholder(spark, d):
    return _flat_resume(resume_plan(fx.audit(spark, d), fx.jobs(spark, d), placeholder=PLACEHOLDER_UNPAUSE))


def q_resume_plan_shuffled(spark, d):
    return _flat_resume(resume_plan(fx.audit(spark, d), fx.jobs(spark, d), max_broadcast_rows=0))


def q_resume_job_settings(spark, d):
    """The settings that unpause each job found in the audit table."""
    plan = resume_plan(fx.audit(spark, d), fx.jobs(spark, d))
    return plan.filter(F.col("resume_action") == "UNPAUSE").select("job_id", *flat_settings(F.col("new_settings")))


def q_resume_unknown(spark, d):
    """Audit rows of a type no resume exists for."""
    plan = resume_plan(fx.audit(spark, d), fx.jobs(spark, d))
    return plan.filter(F.col("resume_action") == "UNKNOWN").select(*AUDIT_COLUMNS)


def q_resume_previous_month(spark, d):
    audit = audit_plan.filter_month(fx.audit(spark, d), month_filter=audit_plan.MONTH_PREVIOUS, as_of=fx.AS_OF)
    return _flat_resume(resume_plan(audit, fx.jobs(spark, d)))


def q_resume_cycle(spark, d):
    """The monthly run: plan the resume from the audit table, then clear it (``rows_left`` is 0)."""
    table = _scratch_name("audit")
    audit_plan.append(fx.audit(spark, d), table)
    plan = run_resume(spark, table, fx.jobs(spark, d))
    left = audit_plan.read_audit(spark, table).count()
    return _kept(_flat_resume(_wall_clock(plan)).withColumn("rows_left", F.lit(left).cast("long")), table)


def q_resume_spelled_ids(spark, d):
    """Job ids in many spellings of an integer."""
    plan = resume_plan(fx.spelled_audit(spark, d), fx.jobs(spark, d))
    return plan.select("resource_id", "resource_name", "resume_action", "job_id")


def q_resume_clears_planned(spark, d):
    """A monthly run that clears what it has planned, with rows appended while it plans: the month's
    plan, and beside it what is left in the table."""
    table = _scratch_name("audit")
    audit_plan.append(fx.audit(spark, d), table)
    snapshot = audit_plan.read_snapshot(spark, table)
    audit_plan.append(fx.spelled_audit(spark, d), table)
    checkpoint_dir(spark)
    plan = _flat_resume(_wall_clock(resume_plan(snapshot.rows, fx.jobs(spark, d)))).checkpoint(eager=True)
    audit_plan.clear(spark, table, only=snapshot)
    left = _wall_clock(audit_plan.read_audit(spark, table))
    blank = [F.lit(None).cast(plan.schema[c].dataType).alias(c) for c in plan.columns if c not in AUDIT_COLUMNS]
    both = plan.withColumn("place", F.lit("plan")).unionByName(left.select("*", *blank).withColumn("place", F.lit("table")))
    return _kept(both, table)


QUERIES: dict[str, Query] = {
    "mtd_usage": q_mtd_usage,
    "price_as_of_usage": q_price_as_of_usage,
    "price_as_of_usage_shuffled": q_price_as_of_usage_shuffled,
    "current_spend": q_current_spend,
    "budget_status": q_budget_status,
    "budget_status_incremental": q_budget_status_incremental,
    "budget_status_at_spend": q_budget_status_at_spend,
    "budget_status_empty_month": q_budget_status_empty_month,
    "budget_report_line": q_budget_report_line,
    "targets_parsed": q_targets_parsed,
    "jobs_not_exempt": q_jobs_not_exempt,
    "jobs_not_exempt_shuffled": q_jobs_not_exempt_shuffled,
    "jobs_targeted": q_jobs_targeted,
    "job_kind": q_job_kind,
    "job_stop_plan": q_job_stop_plan,
    "job_stop_plan_targeted": q_job_stop_plan_targeted,
    "job_stop_plan_targeted_shuffled": q_job_stop_plan_targeted_shuffled,
    "job_paused_settings": q_job_paused_settings,
    "run_cancel_plan": q_run_cancel_plan,
    "run_cancel_plan_targeted": q_run_cancel_plan_targeted,
    "run_cancel_plan_targeted_shuffled": q_run_cancel_plan_targeted_shuffled,
    "cluster_stop_plan": q_cluster_stop_plan,
    "cluster_stop_plan_targeted": q_cluster_stop_plan_targeted,
    "warehouse_stop_plan": q_warehouse_stop_plan,
    "warehouse_stop_plan_targeted": q_warehouse_stop_plan_targeted,
    "app_stop_plan": q_app_stop_plan,
    "app_stop_plan_targeted": q_app_stop_plan_targeted,
    "app_stop_plan_all_listed": q_app_stop_plan_all_listed,
    "app_stop_plan_missing": q_app_stop_plan_missing,
    "stop_plan_union": q_stop_plan_union,
    "stop_plan_targeted": q_stop_plan_targeted,
    "stop_plan_gated": q_stop_plan_gated,
    "stop_plan_gated_within": q_stop_plan_gated_within,
    "run_cancel_plan_gated": q_run_cancel_plan_gated,
    "action_counts": q_action_counts,
    "audit_rows": q_audit_rows,
    "audit_rows_succeeded": q_audit_rows_succeeded,
    "audit_previous_month": q_audit_previous_month,
    "audit_roundtrip": q_audit_roundtrip,
    "audit_append_empty": q_audit_append_empty,
    "enforcement_cycle": q_enforcement_cycle,
    "resume_plan": q_resume_plan,
    "resume_plan_unpause_placeholder": q_resume_plan_unpause_placeholder,
    "resume_plan_shuffled": q_resume_plan_shuffled,
    "resume_job_settings": q_resume_job_settings,
    "resume_unknown": q_resume_unknown,
    "resume_previous_month": q_resume_previous_month,
    "resume_cycle": q_resume_cycle,
    "budget_status_fractional": q_budget_status_fractional,
    "budget_status_incremental_fractional": q_budget_status_incremental_fractional,
    "budget_status_today": q_budget_status_today,
    "price_as_of_usage_versioned": q_price_as_of_usage_versioned,
    "price_as_of_usage_versioned_shuffled": q_price_as_of_usage_versioned_shuffled,
    "targets_number_grammar": q_targets_number_grammar,
    "app_stop_plan_listing_fails": q_app_stop_plan_listing_fails,
    "audit_rows_today": q_audit_rows_today,
    "audit_previous_month_today": q_audit_previous_month_today,
    "audit_record_once": q_audit_record_once,
    "resume_spelled_ids": q_resume_spelled_ids,
    "resume_clears_planned": q_resume_clears_planned,
}
