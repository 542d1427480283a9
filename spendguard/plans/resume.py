"""Resume plan: for every audit row, what restores the resource.

JOB rows look up the job's current settings by id (a left join to the job inventory) and
unpause whatever kind wins, or drop the schedule of an on-demand job. A job id that is not an
integer, a job that no longer exists or has no settings gives ``FAILED``. Clusters, warehouses
and apps are started, without a state check. Other types give ``UNKNOWN``.

Plan at scale: of the job settings only the scheduling fields are read. The job inventory is broadcast
behind a check of its rows and bytes, and the audit table is read once; else both sides are shuffled
on ``job_id`` (AQE splits a hot id), and only JOB rows with a usable id enter the join: every other
row would carry a NULL key, and NULL keys all hash to one shuffle partition.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendguard.functions.dates import previous_month_label
from spendguard.functions.ids import parse_integer
from spendguard.operators.job_settings import PLACEHOLDER_REMOVE, resume_decision, scheduling_settings
from spendguard.operators.sizing import DEFAULT_MAX_BROADCAST_ROWS, broadcast_if_bounded
from spendguard.plans import audit as audit_table
from spendguard.schemas import (
    APP,
    AUDIT_COLUMNS,
    CLUSTER,
    JOB,
    NEW_JOB_SETTINGS,
    RESUME_FAILED,
    RESUME_START,
    RESUME_UNKNOWN,
    WAREHOUSE,
)
from spendguard.session import checkpoint_dir

CLEAR_ALL = "all"
CLEAR_PLANNED = "planned"


def parse_job_id(resource_id: Column) -> Column:
    """Job id text -> BIGINT; NULL for anything that is not an integer or does not fit."""
    return parse_integer(resource_id)


def resume_plan(audit: DataFrame, jobs: DataFrame, *, placeholder: str = PLACEHOLDER_REMOVE,
                max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Audit rows + ``resume_action`` + ``job_id`` + ``new_settings`` (NULL unless a job is
    unpaused). Duplicate audit rows stay duplicates."""
    keep = [F.col(c) for c in AUDIT_COLUMNS]
    rtype = F.col("resource_type")
    job_id = F.when(rtype == F.lit(JOB), parse_job_id(F.col("resource_id")))
    rows = audit.select(*keep, job_id.alias("job_id"))

    inventory, small = broadcast_if_bounded(
        jobs.select(F.col("job_id").alias("_inv_job_id"), scheduling_settings(F.col("settings")).alias("_inv_settings")),
        max_broadcast_rows)
    found = F.col("_inv_job_id").isNotNull() & F.col("_inv_settings").isNotNull()
    action, new_settings = resume_decision(F.col("_inv_settings"), placeholder)
    other_action = (F.when(rtype == F.lit(JOB), F.lit(RESUME_FAILED))
                    .when(rtype.isin(CLUSTER, WAREHOUSE, APP), F.lit(RESUME_START))
                    .otherwise(F.lit(RESUME_UNKNOWN)))

    def looked_up(some: DataFrame) -> DataFrame:
        return some.join(inventory, F.col("job_id") == F.col("_inv_job_id"), "left").select(
            *keep,
            F.when(F.col("job_id").isNull(), other_action).when(found, action).otherwise(F.lit(RESUME_FAILED)).alias("resume_action"),
            F.col("job_id"),
            F.when(found, new_settings).alias("new_settings"),
        )

    if small:  # a NULL id probes the broadcast table and finds nothing: one pass over the audit rows
        return looked_up(rows)
    others = rows.filter(F.col("job_id").isNull()).select(
        *keep, other_action.alias("resume_action"), F.col("job_id"), F.lit(None).cast(NEW_JOB_SETTINGS).alias("new_settings"))
    return looked_up(rows.filter(F.col("job_id").isNotNull())).unionByName(others)


def run_resume(spark: SparkSession, table: str, jobs: DataFrame, *, placeholder: str = PLACEHOLDER_REMOVE,
               month_filter: str | None = audit_table.MONTH_ALL,
               as_of: _dt.date | str | Column | None = None, plan_table: str | None = None,
               clear: str = CLEAR_ALL) -> DataFrame | None:
    """Plan the resume from the audit table, then clear the table.

    Returns ``None`` (and leaves the table alone) when the table does not exist or holds
    nothing to resume. Otherwise the plan is materialised *before* the truncate (a lazy plan
    read after it would see an empty table): into ``plan_table`` when given (overwritten; it
    outlives a driver failure and can be read again by name), else checkpointed into the
    cluster's checkpoint folder.

    The whole table is cleared, also under a month filter and with what was appended meanwhile, as a
    truncate does. With ``clear="planned"`` only the planned rows go: the table is read as it
    stands at the start, rows appended while the plan is made stay for the next resume, and so do
    the rows of other months (written anew before the files that held them are removed; if the run
    breaks off in between they stand twice, and none is lost).
    """
    if clear not in (CLEAR_ALL, CLEAR_PLANNED):
        raise ValueError(f"clear must be {CLEAR_ALL!r} or {CLEAR_PLANNED!r}")
    if not spark.catalog.tableExists(audit_table.quote_name(table)):
        return None
    snapshot = audit_table.read_snapshot(spark, table) if clear == CLEAR_PLANNED else None
    if snapshot is None:
        audit = audit_table.read_audit(spark, table, month_filter=month_filter, as_of=as_of)
    else:
        audit = audit_table.filter_month(snapshot.rows, month_filter=month_filter, as_of=as_of)
    if audit.isEmpty():
        return None
    plan = resume_plan(audit, jobs, placeholder=placeholder)
    if plan_table is not None:
        name = audit_table.quote_name(plan_table)
        plan.write.mode("overwrite").saveAsTable(name)
        plan = spark.table(name)
    else:
        checkpoint_dir(spark)
        plan = plan.checkpoint(eager=True)
    if snapshot is not None and month_filter is not audit_table.MONTH_ALL:
        checkpoint_dir(spark)
        planned = F.coalesce(F.col("month") == previous_month_label(as_of), F.lit(False))
        others = snapshot.rows.where(~planned).checkpoint(eager=True)
        if not others.isEmpty():
            audit_table.insert_by_name(others, table, others.schema)
    audit_table.clear(spark, table, only=snapshot)
    return plan
