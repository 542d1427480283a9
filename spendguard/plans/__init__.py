"""End-to-end plans: budget check, stop plans, audit table, resume plan."""

from spendguard.plans import audit
from spendguard.plans.budget import (
    budget_check,
    budget_status_of,
    current_spend,
    month_to_date,
    price_usage,
    price_usage_in_doubles,
    report_line,
    status_values,
    task_values,
)
from spendguard.plans.resume import parse_job_id, resume_plan, run_resume
from spendguard.plans.stop import (
    EnforcementPlan,
    action_counts,
    app_stop_plan,
    cluster_stop_plan,
    enforcement_plan,
    gated_stop_plan,
    job_stop_plan,
    run_cancel_plan,
    stop_plan,
    take_snapshot,
    warehouse_stop_plan,
)

__all__ = [
    "EnforcementPlan",
    "action_counts",
    "app_stop_plan",
    "audit",
    "budget_check",
    "budget_status_of",
    "cluster_stop_plan",
    "current_spend",
    "enforcement_plan",
    "gated_stop_plan",
    "job_stop_plan",
    "month_to_date",
    "parse_job_id",
    "price_usage",
    "price_usage_in_doubles",
    "report_line",
    "resume_plan",
    "run_cancel_plan",
    "run_resume",
    "status_values",
    "stop_plan",
    "take_snapshot",
    "task_values",
    "warehouse_stop_plan",
]
