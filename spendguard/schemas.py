"""Table schemas and the fixed values every plan shares.

The input tables (usage, price list, inventories) come from outside; the types below are the
ones our operators expect. Operators only touch the named columns, so wider tables work too.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# Fixed values. These must equal the values the original budget job uses, or stop/resume plans
# and audit rows would not line up with what it writes and reads.
# ---------------------------------------------------------------------------------------------
OVER_BUDGET = "OVER_BUDGET"
WITHIN_BUDGET = "WITHIN_BUDGET"
DEFAULT_THRESHOLD = 50000
PAUSED = "PAUSED"
UNPAUSED = "UNPAUSED"
PLACEHOLDER_CRON = "0 0 0 1 1 ? 2099"
PLACEHOLDER_TIMEZONE = "UTC"
ACTIVE_CLUSTER_STATES = ("RUNNING", "RESIZING", "PENDING")
ACTIVE_WAREHOUSE_STATES = ("RUNNING", "STARTING")
JOB = "JOB"
CLUSTER = "CLUSTER"
WAREHOUSE = "WAREHOUSE"
APP = "APP"
ACTION_STOPPED = "STOPPED"
ACTED_BY = "budget_enforcer"
MONTH_FORMAT = "yyyy-MM"
AUDIT_TABLE = "paused_jobs"
ALL_TARGETS = "ALL"
# ---------------------------------------------------------------------------------------------

# Our own labels (not in the original job): what a resume plan decides per audit row, the job
# kind found by first match, and the phase order of the stop plan.
RESUME_UNPAUSE = "UNPAUSE"
RESUME_REMOVE_SCHEDULE = "REMOVE_SCHEDULE"
RESUME_START = "START"
RESUME_FAILED = "FAILED"
RESUME_UNKNOWN = "UNKNOWN"

KIND_SCHEDULE = "SCHEDULE"
KIND_CONTINUOUS = "CONTINUOUS"
KIND_TRIGGER = "TRIGGER"
KIND_ON_DEMAND = "ON_DEMAND"

STEP = {JOB: 1, "RUN": 2, CLUSTER: 3, WAREHOUSE: 4, APP: 5}

QUANTITY = T.DecimalType(18, 6)
PRICE = T.DecimalType(18, 6)


def _f(name: str, dtype: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, dtype, nullable)


USAGE = T.StructType([
    _f("sku_name", T.StringType()),
    _f("usage_quantity", QUANTITY),
    _f("usage_end_time", T.TimestampType()),
    _f("usage_date", T.DateType()),
])

# Usage summed per SKU and end time, by micro-batch (spendguard.streaming).
USAGE_TOTALS = T.StructType([
    _f("sku_name", T.StringType()),
    _f("usage_quantity", T.DecimalType(28, 6)),
    _f("usage_end_time", T.TimestampType()),
    _f("usage_date", T.DateType()),
    _f("batch_id", T.LongType()),
])

PRICING = T.StructType([_f("effective_list", T.StructType([_f("default", PRICE)]))])

LIST_PRICES = T.StructType([
    _f("sku_name", T.StringType()),
    _f("price_start_time", T.TimestampType(), False),
    _f("price_end_time", T.TimestampType()),
    _f("pricing", PRICING),
])

SCHEDULE = T.StructType([
    _f("quartz_cron_expression", T.StringType()),
    _f("timezone_id", T.StringType()),
    _f("pause_status", T.StringType()),
])
CONTINUOUS = T.StructType([_f("pause_status", T.StringType())])
# file_arrival / table_update are carried as opaque JSON text: copied, never inspected.
TRIGGER = T.StructType([
    _f("file_arrival", T.StringType()),
    _f("table_update", T.StringType()),
    _f("pause_status", T.StringType()),
])

JOB_SETTINGS = T.StructType([
    _f("name", T.StringType()),
    _f("schedule", SCHEDULE),
    _f("continuous", CONTINUOUS),
    _f("trigger", TRIGGER),
])

# The settings a plan would send: only the scheduling part, each child NULL unless changed.
NEW_JOB_SETTINGS = T.StructType([
    _f("schedule", SCHEDULE),
    _f("continuous", CONTINUOUS),
    _f("trigger", TRIGGER),
])

JOBS = T.StructType([_f("job_id", T.LongType()), _f("settings", JOB_SETTINGS)])
RUNS = T.StructType([_f("run_id", T.LongType()), _f("job_id", T.LongType()), _f("active", T.BooleanType())])
CLUSTERS = T.StructType([
    _f("cluster_id", T.StringType()),
    _f("cluster_name", T.StringType()),
    _f("state", T.StringType()),
])
WAREHOUSES = T.StructType([_f("id", T.StringType()), _f("name", T.StringType()), _f("state", T.StringType())])
APPS = T.StructType([_f("name", T.StringType())])

AUDIT = T.StructType([
    _f("resource_type", T.StringType()),
    _f("action", T.StringType()),
    _f("resource_id", T.StringType()),
    _f("resource_name", T.StringType()),
    _f("timestamp", T.TimestampType()),
    _f("acted_by", T.StringType()),
    _f("month", T.StringType()),
])
AUDIT_COLUMNS = tuple(f.name for f in AUDIT.fields)

# The resource rows every stop plan emits before they become audit rows.
