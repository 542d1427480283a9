"""Stop plans: which jobs to pause, runs to cancel, clusters to terminate, warehouses and apps to
stop, read from inventory snapshots. Each is one lazy filter/join plan over its inventory.

Id sets: ``targets=None`` means every resource, a list or DataFrame means only those ids (an
empty one means none); ``exempt`` ids are never touched, even when targeted.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendguard.operators.job_settings import current_pause_status, is_paused, job_kind, paused_settings
from spendguard.operators.selection import IdSet, check_id_sets, drop_exempt, drop_self, gate, job_properties, only_targets
from spendguard.operators.sizing import DEFAULT_MAX_BROADCAST_ROWS
from spendguard.plans.audit import quote_name
from spendguard.schemas import (
    ACTIVE_CLUSTER_STATES,
    ACTIVE_WAREHOUSE_STATES,
    APP,
    APPS,
    CLUSTER,
    JOB,
    RUNS,
    STEP,
    WAREHOUSE,
)
from spendguard.session import checkpoint_dir
from spendguard.sources.tables import read_listing


def job_stop_plan(jobs: DataFrame, *, targets: IdSet = None, exempt: IdSet = None,
                  max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Jobs to pause, with the settings that pause them.

    Exempt jobs go first (they win over targeting), then jobs without settings; jobs whose
    winning kind is already paused are left alone, so a resume will not unpause them.
    """
    opts = {"max_broadcast_rows": max_broadcast_rows}
    j = drop_exempt(jobs, "job_id", exempt, **opts).filter(F.col("settings").isNotNull())
    j = only_targets(j, "job_id", targets, **opts).filter(~is_paused("settings"))
    s = F.col("settings")
    return j.select(
        F.col("job_id"),
        s.getField("name").alias("job_name"),
        job_kind(s).alias("job_kind"),
        current_pause_status(s).alias("previous_pause_status"),
        paused_settings(s).alias("new_settings"),
    )


def run_cancel_plan(runs: DataFrame, *, targets: IdSet = None, exempt: IdSet = None,
                    active_col: str | None = "active",
                    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Active runs to cancel; the same job exemptions and job targets as :func:`job_stop_plan`.
    Cancelled runs are not audited and not resumed."""
    opts = {"max_broadcast_rows": max_broadcast_rows}
    r = runs.filter(F.col(active_col)) if active_col else runs
    r = only_targets(drop_exempt(r, "job_id", exempt, **opts), "job_id", targets, **opts)
    return r.select("run_id", "job_id")


def cluster_stop_plan(clusters: DataFrame, *, targets: IdSet = None, own_cluster_id: str | None = None,
                      max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Running, resizing or pending clusters to terminate, never the one the controlling job runs on."""
    c = drop_self(clusters, "cluster_id", own_cluster_id)
    c = only_targets(c, "cluster_id", targets, max_broadcast_rows=max_broadcast_rows)
    return c.filter(F.col("state").isin(*ACTIVE_CLUSTER_STATES)).select("cluster_id", "cluster_name", "state")


def warehouse_stop_plan(warehouses: DataFrame, *, targets: IdSet = None,
                        max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Running or starting SQL warehouses to stop."""
    w = only_targets(warehouses, "id", targets, max_broadcast_rows=max_broadcast_rows)
    return w.filter(F.col("state").isin(*ACTIVE_WAREHOUSE_STATES)).select("id", "name", "state")


def app_stop_plan(apps: DataFrame | str | None, *, targets: IdSet = None,
                  max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Every targeted app, whatever its state. A missing app listing (``None``) is empty, and so is
    one given by the name of its table or its path that is not there."""
    if apps is None:
        apps = SparkSession.active().createDataFrame([], APPS)
    elif isinstance(apps, str):
        apps = read_listing(SparkSession.active(), apps, APPS)
    return only_targets(apps, "name", targets, max_broadcast_rows=max_broadcast_rows).select("name")


def _rows(df: DataFrame, resource_type: str, rid, name) -> DataFrame:
    return df.select(
        F.lit(STEP[resource_type]).alias("step"),
        F.lit(resource_type).alias("resource_type"),
        rid.cast("string").alias("resource_id"),
        name.cast("string").alias("resource_name"),
    )


def stop_plan(*, jobs: DataFrame, clusters: DataFrame, warehouses: DataFrame, apps: DataFrame | str | None,
              job_targets: IdSet = None, cluster_targets: IdSet = None, warehouse_targets: IdSet = None,
              app_targets: IdSet = None, exempt_jobs: IdSet = None, own_cluster_id: str | None = None,
              max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """All auditable stop actions as ``(step, resource_type, resource_id, resource_name)``:
    UNION ALL of jobs, clusters, warehouses and apps; ``step`` gives the phase order."""
    opts = {"max_broadcast_rows": max_broadcast_rows}
    job_targets, cluster_targets, warehouse_targets, app_targets, exempt_jobs = check_id_sets(
        [job_targets, cluster_targets, warehouse_targets, app_targets, exempt_jobs], max_broadcast_rows)
    j = job_stop_plan(jobs, targets=job_targets, exempt=exempt_jobs, **opts)
    c = cluster_stop_plan(clusters, targets=cluster_targets, own_cluster_id=own_cluster_id, **opts)
    w = warehouse_stop_plan(warehouses, targets=warehouse_targets, **opts)
    a = app_stop_plan(apps, targets=app_targets, **opts)
    return (_rows(j, JOB, F.col("job_id"), F.col("job_name"))
            .unionByName(_rows(c, CLUSTER, F.col("cluster_id"), F.col("cluster_name")))
            .unionByName(_rows(w, WAREHOUSE, F.col("id"), F.col("name")))
            .unionByName(_rows(a, APP, F.col("name"), F.col("name"))))


def gated_stop_plan(status: DataFrame, **plan_args) -> DataFrame:
    """:func:`stop_plan`, empty unless the one-row budget status is over budget."""
    return gate(stop_plan(**plan_args), status)


def action_counts(plan: DataFrame) -> DataFrame:
    """Number of planned actions per resource type."""
    return plan.groupBy("step", "resource_type").agg(F.count(F.lit(1)).alias("actions"))


@dataclass(frozen=True)
class EnforcementPlan:
    """What one control run would do, all gated on one budget status: lazy as
    :func:`enforcement_plan` returns it, fixed as :func:`take_snapshot` does."""

    status: DataFrame   # one row: budget_status, current_spend
    stops: DataFrame    # auditable stop actions (jobs, clusters, warehouses, apps), see stop_plan
    runs: DataFrame     # active runs to cancel (never audited)


def enforcement_plan(status: DataFrame, *, runs: DataFrame | None = None, **plan_args) -> EnforcementPlan:
    """The whole stop phase in one call: :func:`stop_plan` and :func:`run_cancel_plan` (same job
    targets and exemptions), both empty unless ``status`` is over budget."""
    if runs is None:
        runs = SparkSession.active().createDataFrame([], RUNS)
    limit = plan_args.get("max_broadcast_rows", DEFAULT_MAX_BROADCAST_ROWS)
    keys = ("job_targets", "cluster_targets", "warehouse_targets", "app_targets", "exempt_jobs")
    # One check per id set, shared by the stop plan and the run plan.
    checked = check_id_sets([plan_args.get(k) for k in keys], limit)
    plan_args = {**plan_args, **dict(zip(keys, checked))}
    cancel = run_cancel_plan(runs, targets=plan_args["job_targets"], exempt=plan_args["exempt_jobs"],
                             max_broadcast_rows=limit)
    return EnforcementPlan(status=status, stops=gated_stop_plan(status, **plan_args), runs=gate(cancel, status))


def take_snapshot(status: DataFrame, *, runs: DataFrame | None = None, stops_table: str | None = None,
                  runs_table: str | None = None, **plan_args) -> EnforcementPlan:
    """:func:`enforcement_plan` evaluated once: one decision, one list of actions.

    The budget status is computed a single time and handed on as a value, and both plans are written
    once, into the named tables (overwritten) or else into the checkpoint folder. What is acted on,
    audited and resumed from is then the same rows, whatever the inventories, the usage or the
    date do meanwhile.
    """
    spark = status.sparkSession
    decided = spark.createDataFrame([status.first()], status.schema)
    plan = enforcement_plan(decided, runs=runs, **plan_args)

    def fixed(rows: DataFrame, table: str | None) -> DataFrame:
        if table is None:
            checkpoint_dir(spark)
            return rows.checkpoint(eager=True)
        rows.write.mode("overwrite").saveAsTable(quote_name(table))
        return spark.table(quote_name(table))

    inherit = job_properties(status)

    def in_thread(rows: DataFrame, table: str | None) -> DataFrame:
        inherit()
        return fixed(rows, table)

    with ThreadPoolExecutor(max_workers=2) as pool:  # neither needs the other
        stops, cancels = pool.map(in_thread, (plan.stops, plan.runs), (stops_table, runs_table))
    return EnforcementPlan(status=decided, stops=stops, runs=cancels)
