"""Independent DuckDB SQL for every registered query, over the raw generated tables.

The fixtures are derived again here in flat form (no structs), and each operator is written
as plain SQL from its specification, not from the Spark code. Decimal results are summed in
decimal and cast to DOUBLE, as on the Spark side.
"""

from __future__ import annotations

import sys
import unicodedata

from spendguard.registry import EMPTY_MONTH_AS_OF, UNREACHABLE_THRESHOLD
from spendguard.sources import fixtures as fx

AS_OF = f"DATE '{fx.AS_OF.isoformat()}'"
NOW = f"TIMESTAMP '{fx.NOW.isoformat(sep=' ')}'"
EXEMPT = ", ".join(f"'{j}'" for j in fx.EXEMPT_JOBS)
OWN_CLUSTER = f"'{fx.OWN_CLUSTER}'"
# White space of every kind, and the decimal digits of every script, as a text's own strip and int() see them.
SPACE = "'" + "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()) + "'"
NUMBER_SPACE = "'" + "".join(c for c in SPACE[1:-1] if c not in "\x1c\x1d\x1e\x1f") + "'"
DIGITS = "".join(chr(c) for c in range(128, sys.maxunicode + 1) if chr(c).isdecimal())
ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in DIGITS)
# Plain decimal or scientific notation, written here on its own.
NUMBER = r"[+-]?(\d+|\d+\.\d*|\.\d+)([eE][+-]?\d+)?"
STRAY = r"(^|\D)_|_(\D|$)"


def _digits(item: str) -> str:
    return f"translate(trim({item}, {NUMBER_SPACE}), '{DIGITS}', '{ASCII_DIGITS}')"


def _normalized(item: str) -> str:
    """The integer of the double that a text denotes, in all its digits, else the text."""
    digits = _digits(item)
    plain = f"replace({digits}, '_', '')"
    value = f"TRY_CAST({plain} AS DOUBLE)"
    return f"""CASE WHEN regexp_full_match({plain}, '{NUMBER}') AND NOT regexp_matches({digits}, '{STRAY}') AND isfinite({value})
              THEN CAST(CAST(trunc({value}) AS BIGNUM) AS VARCHAR) ELSE {item} END"""


FIXTURES = rf"""
usage AS (
  SELECT 'SKU-' || CAST(l_partkey // 4 AS VARCHAR) AS sku_name,
         CAST(l_quantity AS DECIMAL(18,6)) AS usage_quantity,
         l_shipdate + to_hours(CAST(l_orderkey % 24 AS BIGINT)) AS usage_end_time,
         CAST(l_shipdate AS DATE) AS usage_date
  FROM lineitem
),
list_prices AS (
  SELECT 'SKU-' || CAST(p_partkey // 4 AS VARCHAR) AS sku_name,
         TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST((p_partkey % 4) * 600 AS INTEGER)) AS price_start_time,
         CASE WHEN p_partkey % 7 = 0
              THEN TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST((p_partkey % 4) * 600 AS INTEGER))
              WHEN p_partkey % 4 <> 3
              THEN TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST((p_partkey % 4 + 1) * 600 AS INTEGER)) END
           AS price_end_time,
         CAST(p_retailprice AS DECIMAL(18,6)) AS unit_price
  FROM part
),
job_src AS (
  SELECT o_orderkey AS job_id,
         o_orderkey % 97 <> 0 AS has_settings,
         'job-' || CAST(o_orderkey AS VARCHAR) AS name,
         substr(o_orderpriority, 1, 1) AS prio,
         CASE o_orderstatus WHEN 'F' THEN 'PAUSED' WHEN 'O' THEN 'UNPAUSED' END AS status,
         CASE WHEN o_orderkey % 10 = 3 THEN '0 0 0 1 1 ? 2099'
              ELSE '0 0 ' || CAST(o_orderkey % 24 AS VARCHAR) || ' * * ?' END AS cron,
         CASE WHEN o_orderkey % 10 = 3 THEN 'UTC' WHEN o_custkey % 3 = 0 THEN 'UTC'
              WHEN o_custkey % 3 = 1 THEN 'America/New_York' ELSE 'Asia/Tokyo' END AS tz,
         CASE WHEN o_custkey % 2 = 0 THEN '{{"url": "/landing/c' || CAST(o_custkey AS VARCHAR) || '/"}}' END
           AS file_arrival,
         CASE WHEN o_custkey % 2 <> 0 THEN '{{"table_names": ["sales.t' || CAST(o_custkey AS VARCHAR) || '"]}}' END
           AS table_update
  FROM orders
),
jobs AS (
  SELECT job_id, has_settings,
         CASE WHEN has_settings THEN name END AS name,
         has_settings AND prio IN ('2', '5') AS has_schedule,
         has_settings AND prio = '1' AS has_continuous,
         has_settings AND prio IN ('3', '5') AS has_trigger,
         cron AS schedule_cron, tz AS schedule_tz,
         status AS schedule_pause, status AS continuous_pause, status AS trigger_pause,
         file_arrival AS trigger_file_arrival, table_update AS trigger_table_update
  FROM job_src
),
job_kinds AS (
  SELECT *,
         CASE WHEN has_schedule THEN 'SCHEDULE' WHEN has_continuous THEN 'CONTINUOUS'
              WHEN has_trigger THEN 'TRIGGER' ELSE 'ON_DEMAND' END AS job_kind,
         CASE WHEN has_schedule THEN schedule_pause WHEN has_continuous THEN continuous_pause
              WHEN has_trigger THEN trigger_pause END AS previous_pause_status
  FROM jobs
),
runs AS (
  SELECT event_id AS run_id, user_id AS job_id, event_type IN ('view', 'click') AS active FROM events
),
clusters AS (
  SELECT '0410-' || printf('%06d', c_custkey) || '-abc' AS cluster_id, c_name AS cluster_name,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'RUNNING' WHEN 'AUTOMOBILE' THEN 'RESIZING'
              WHEN 'MACHINERY' THEN 'PENDING' WHEN 'HOUSEHOLD' THEN 'TERMINATED'
              WHEN 'FURNITURE' THEN 'TERMINATING' END AS state
  FROM customer
),
warehouses AS (
  SELECT 'wh' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS name,
         CASE s_nationkey % 4 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'STARTING' WHEN 2 THEN 'STOPPED'
              ELSE 'STOPPING' END AS state
  FROM supplier
),
apps AS (
  SELECT replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR) AS name, p_size FROM part
),
audit AS (
  SELECT CASE o_orderkey % 5 WHEN 0 THEN 'JOB' WHEN 1 THEN 'CLUSTER' WHEN 2 THEN 'WAREHOUSE'
              WHEN 3 THEN 'APP' ELSE 'OTHER' END AS resource_type,
         'STOPPED' AS action,
         CASE WHEN o_orderkey % 35 = 0 THEN 'bad-' || CAST(o_orderkey AS VARCHAR)
              WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey * 11 AS VARCHAR)
              ELSE 'r' || CAST(o_custkey AS VARCHAR) END AS resource_id,
         'n' || CAST(o_custkey AS VARCHAR) AS resource_name,
         o_orderdate AS "timestamp",
         'budget_enforcer' AS acted_by,
         strftime(o_orderdate, '%Y-%m') AS "month"
  FROM orders
),
target_lists AS (
  SELECT 'JOB' AS resource_type,
         CASE WHEN o_orderdate < TIMESTAMP '1996-01-01 00:00:00' THEN
           CASE o_orderkey % 4
             WHEN 0 THEN CAST(o_orderkey AS VARCHAR) || ', ' || CAST(o_orderkey + 1 AS VARCHAR)
             WHEN 1 THEN ' ' || CAST(o_orderkey AS VARCHAR) || '.0 ,'
             WHEN 2 THEN (CASE WHEN length(CAST(o_orderkey AS VARCHAR)) > 1
                               THEN substr(CAST(o_orderkey AS VARCHAR), 1, 1) || '.' || substr(CAST(o_orderkey AS VARCHAR), 2)
                                    || 'e+' || CAST(length(CAST(o_orderkey AS VARCHAR)) - 1 AS VARCHAR)
                               ELSE CAST(o_orderkey AS VARCHAR) || 'e+0' END) || ',job-' || CAST(o_orderkey AS VARCHAR)
             ELSE '0' || CAST(o_orderkey AS VARCHAR) || ',,' END
         ELSE
           CASE o_orderkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ' , ,' ELSE 'none-' || CAST(o_orderkey AS VARCHAR) END
         END AS raw
  FROM orders
  UNION ALL
  SELECT 'CLUSTER', CASE WHEN c_nationkey < 5 THEN ' 0410-' || printf('%06d', c_custkey) || '-abc ,' ELSE ',,' END FROM customer
  UNION ALL
  SELECT 'WAREHOUSE', CASE WHEN s_nationkey < 12 THEN '' ELSE 'gone-' END || 'wh' || CAST(s_suppkey AS VARCHAR) FROM supplier
  UNION ALL
  SELECT 'APP', replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_size <= 10 THEN '' ELSE '-old' END FROM part
  UNION ALL
  SELECT '{fx.EDGE}', [{", ".join("'" + x + "'" for x in fx.EDGE_LISTS)}][CAST(s_suppkey % {len(fx.EDGE_LISTS)} + 1 AS INTEGER)] FROM supplier
),
list_kinds AS (
  SELECT *, (upper(trim(raw, {SPACE})) = 'ALL' OR trim(raw, {SPACE}) = '') AS all_targets
  FROM target_lists
),
target_items AS (
  SELECT resource_type, trim(item, {SPACE}) AS item
  FROM (SELECT resource_type, unnest(string_split(raw, ',')) AS item FROM list_kinds WHERE NOT all_targets)
),
targets AS (
  SELECT DISTINCT resource_type,
         {_normalized('item')} AS target_id
  FROM target_items
  WHERE item <> ''
),
outcomes AS (
  SELECT 'JOB' AS resource_type, CAST(o_orderkey AS VARCHAR) AS resource_id, o_totalprice >= 20000 AS ok FROM orders
  UNION ALL
  SELECT 'CLUSTER', '0410-' || printf('%06d', c_custkey) || '-abc', c_acctbal >= 0 FROM customer
  UNION ALL
  SELECT 'WAREHOUSE', 'wh' || CAST(s_suppkey AS VARCHAR), s_acctbal >= 0 FROM supplier
  UNION ALL
  SELECT 'APP', replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR), p_size <= 45 FROM part
)"""


def _priced(usage_filter: str = "TRUE", name: str = "priced") -> str:
    """Usage rows with the price version valid at their end time (inner: unpriced rows drop)."""
    return f"""
{name} AS (
  SELECT u.sku_name, u.usage_end_time, u.usage_date, u.usage_quantity,
         p.price_start_time, p.price_end_time, p.unit_price, u.usage_quantity * p.unit_price AS line_cost
  FROM usage u
  JOIN list_prices p
    ON p.sku_name = u.sku_name
   AND u.usage_end_time >= p.price_start_time
   AND (p.price_end_time IS NULL OR u.usage_end_time < p.price_end_time)
  WHERE {usage_filter}
)"""


MTD = f"u.usage_date >= date_trunc('month', {AS_OF})"


def _status(threshold: object = fx.THRESHOLD, as_of: str = AS_OF) -> str:
    """One row: the month-to-date total and its verdict (a NULL total is within budget)."""
    month = _priced(f"u.usage_date >= date_trunc('month', {as_of})", name="month_priced")
    return month + f""",
month_total AS (SELECT SUM(line_cost) AS total FROM month_priced),
status AS (
  SELECT CASE WHEN total > {threshold} THEN 'OVER_BUDGET' ELSE 'WITHIN_BUDGET' END AS budget_status,
         total AS current_spend
  FROM month_total
)"""


JOB_PLAN_COLUMNS = """
  job_id, name AS job_name, job_kind, previous_pause_status,
  CASE job_kind WHEN 'SCHEDULE' THEN schedule_cron WHEN 'ON_DEMAND' THEN '0 0 0 1 1 ? 2099' END AS new_schedule_cron,
  CASE job_kind WHEN 'SCHEDULE' THEN schedule_tz WHEN 'ON_DEMAND' THEN 'UTC' END AS new_schedule_timezone,
  CASE WHEN job_kind IN ('SCHEDULE', 'ON_DEMAND') THEN 'PAUSED' END AS new_schedule_pause_status,
  CASE WHEN job_kind = 'CONTINUOUS' THEN 'PAUSED' END AS new_continuous_pause_status,
  CASE WHEN job_kind = 'TRIGGER' THEN trigger_file_arrival END AS new_trigger_file_arrival,
  CASE WHEN job_kind = 'TRIGGER' THEN trigger_table_update END AS new_trigger_table_update,
  CASE WHEN job_kind = 'TRIGGER' THEN 'PAUSED' END AS new_trigger_pause_status"""

NOT_EXEMPT = f"(job_id IS NULL OR CAST(job_id AS VARCHAR) NOT IN ({EXEMPT}))"


def _targeted(resource_type: str, id_expr: str) -> str:
    return f"{id_expr} IN (SELECT target_id FROM targets WHERE resource_type = '{resource_type}')"


def _job_plan(targeted: bool = False) -> str:
    target = f" AND {_targeted('JOB', 'CAST(job_id AS VARCHAR)')}" if targeted else ""
    return f"""
job_plan AS (
  SELECT {JOB_PLAN_COLUMNS}
  FROM job_kinds
  WHERE has_settings AND {NOT_EXEMPT}{target}
    AND previous_pause_status IS DISTINCT FROM 'PAUSED'
)"""


def _cluster_plan(targeted: bool = False) -> str:
    target = f" AND {_targeted('CLUSTER', 'cluster_id')}" if targeted else ""
    return f"""
cluster_plan AS (
  SELECT cluster_id, cluster_name, state FROM clusters
  WHERE cluster_id IS DISTINCT FROM {OWN_CLUSTER}{target}
    AND state IN ('RUNNING', 'RESIZING', 'PENDING')
)"""


def _warehouse_plan(targeted: bool = False) -> str:
    target = f" AND {_targeted('WAREHOUSE', 'id')}" if targeted else ""
    return f"""
warehouse_plan AS (
  SELECT id, name, state FROM warehouses WHERE state IN ('RUNNING', 'STARTING'){target}
)"""


def _app_plan(targeted: bool = False) -> str:
    target = f" WHERE {_targeted('APP', 'name')}" if targeted else ""
    return f"""
app_plan AS (SELECT name FROM apps{target})"""


def _stop_plan(targeted: bool = False) -> str:
    parts = [_job_plan(targeted), _cluster_plan(targeted), _warehouse_plan(targeted), _app_plan(targeted)]
    return ",".join(parts) + """,
stop_plan AS (
  SELECT 1 AS step, 'JOB' AS resource_type, CAST(job_id AS VARCHAR) AS resource_id, job_name AS resource_name
  FROM job_plan
  UNION ALL SELECT 3, 'CLUSTER', cluster_id, cluster_name FROM cluster_plan
  UNION ALL SELECT 4, 'WAREHOUSE', id, name FROM warehouse_plan
  UNION ALL SELECT 5, 'APP', name, name FROM app_plan
)"""


AUDIT_ROW_COLUMNS = f"""
  resource_type, 'STOPPED' AS action, resource_id, resource_name, {NOW} AS "timestamp",
  'budget_enforcer' AS acted_by, strftime({NOW}, '%Y-%m') AS "month" """

PREVIOUS_MONTH = f"\"month\" = strftime({AS_OF} - INTERVAL 1 MONTH, '%Y-%m')"


def _resume(audit_where: str = "TRUE", remove_placeholder: bool = True) -> str:
    """CTEs ending in ``resume_out``: every audit row with its resume action and settings."""
    placeholder = "OR (j.job_kind = 'SCHEDULE' AND j.schedule_cron = '0 0 0 1 1 ? 2099')" if remove_placeholder else ""
    return f"""
audit_ids AS (
  SELECT *,
         CASE WHEN resource_type = 'JOB'
              THEN TRY_CAST(NULLIF(regexp_extract(resource_id, '^\\s*([+-]?[0-9]+)\\s*$', 1), '') AS BIGINT) END AS job_id
  FROM audit WHERE {audit_where}
),
resume_base AS (
  SELECT a.resource_type, a.action, a.resource_id, a.resource_name, a."timestamp", a.acted_by, a."month", a.job_id,
         j.job_kind, j.schedule_cron, j.schedule_tz, j.trigger_file_arrival, j.trigger_table_update,
         CASE
           WHEN a.resource_type = 'JOB' AND (a.job_id IS NULL OR j.job_id IS NULL OR NOT j.has_settings) THEN 'FAILED'
           WHEN a.resource_type = 'JOB' AND (j.job_kind = 'ON_DEMAND' {placeholder}) THEN 'REMOVE_SCHEDULE'
           WHEN a.resource_type = 'JOB' THEN 'UNPAUSE'
           WHEN a.resource_type IN ('CLUSTER', 'WAREHOUSE', 'APP') THEN 'START'
           ELSE 'UNKNOWN'
         END AS resume_action
  FROM audit_ids a LEFT JOIN job_kinds j ON a.job_id = j.job_id
),
resume_out AS (
SELECT resource_type, action, resource_id, resource_name, "timestamp", acted_by, "month", resume_action, job_id,
       CASE WHEN resume_action = 'UNPAUSE' AND job_kind = 'SCHEDULE' THEN schedule_cron END AS new_schedule_cron,
       CASE WHEN resume_action = 'UNPAUSE' AND job_kind = 'SCHEDULE' THEN schedule_tz END AS new_schedule_timezone,
       CASE WHEN resume_action = 'UNPAUSE' AND job_kind = 'SCHEDULE' THEN 'UNPAUSED' END AS new_schedule_pause_status,
       CASE WHEN resume_action = 'UNPAUSE' AND job_kind = 'CONTINUOUS' THEN 'UNPAUSED' END
         AS new_continuous_pause_status,
       CASE WHEN resume_action = 'UNPAUSE' AND job_kind = 'TRIGGER' THEN trigger_file_arrival END
         AS new_trigger_file_arrival,
       CASE WHEN resume_action = 'UNPAUSE' AND job_kind = 'TRIGGER' THEN trigger_table_update END
         AS new_trigger_table_update,
       CASE WHEN resume_action = 'UNPAUSE' AND job_kind = 'TRIGGER' THEN 'UNPAUSED' END AS new_trigger_pause_status
FROM resume_base
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join((FIXTURES,) + ctes) + "\n"


def _millionths(n: str) -> str:
    return f"CAST(CAST(({n}) % 1000000 AS DECIMAL(18,6)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(18,6))"


def _replaced(name: str, columns: str, source: str, where: str = "TRUE") -> str:
    return f"""
{name} AS (SELECT * REPLACE ({columns}) FROM {source} WHERE {where})"""


# The fixtures' usage and prices come from lineitem and part: the variants replace those columns first.
FRACTIONAL = FIXTURES.replace("FROM lineitem", "FROM (SELECT * REPLACE (CAST(CAST(l_quantity AS DECIMAL(18,6)) + "
                              + _millionths("l_orderkey * 7919 + l_partkey * 104729") + " AS DECIMAL(18,6)) AS l_quantity) FROM lineitem)", 1).replace(
    "unit_price\n  FROM part", "unit_price\n  FROM (SELECT * REPLACE (CAST(CAST(p_retailprice AS DECIMAL(18,6)) + "
    + _millionths("p_partkey * 15485863") + " AS DECIMAL(18,6)) AS p_retailprice) FROM part)", 1)
FRACTIONAL_STATUS = "WITH " + FRACTIONAL + "," + _status() + """
SELECT budget_status, CAST(current_spend AS VARCHAR) AS current_spend, 'WITHIN_BUDGET' AS status_at_spend FROM status"""

_PART_KEY = "CAST(p_partkey AS BIGINT)"
HOT = f"""
hot_prices AS (
  SELECT sku_name, price_start_time, price_end_time, unit_price FROM list_prices
  UNION ALL
  SELECT '{fx.HOT_SKU}', start_time, CASE WHEN kind <> 0 THEN start_time + to_days(CAST(CASE kind WHEN 1 THEN {fx.HOT_LONG_DAYS} ELSE 1 END AS INTEGER)) END, price
  FROM (SELECT TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST({_PART_KEY} * 37 % {fx.HOT_DAYS} AS INTEGER)) + to_hours({_PART_KEY} % 24) AS start_time,
               {_PART_KEY} % {fx.HOT_KINDS} AS kind, CAST(p_retailprice AS DECIMAL(18,6)) AS price FROM part)
),
skus AS (
  SELECT sku_name, xor(4294967295, list_reduce(list_transform(string_split(sku_name, ''), lambda x: CAST(ascii(x) AS BIGINT)),
         lambda c, x: list_reduce(range(8), lambda b, i: xor(b >> 1, 3988292384 * (b & 1)), xor(c, x)), CAST(4294967295 AS BIGINT))) AS crc
  FROM (SELECT DISTINCT sku_name FROM usage)
),
hot_usage AS (
  SELECT CASE WHEN crc % 3 = 0 THEN '{fx.HOT_SKU}' ELSE sku_name END AS sku_name, usage_quantity, usage_end_time, usage_date FROM usage JOIN skus USING (sku_name)
)"""
HOT_PRICED = _with(HOT, _priced().replace("FROM usage u", "FROM hot_usage u").replace("JOIN list_prices p", "JOIN hot_prices p")) + """
SELECT sku_name, usage_end_time, usage_date, CAST(usage_quantity AS DOUBLE) AS usage_quantity,
       CAST(unit_price AS DOUBLE) AS unit_price, CAST(line_cost AS DOUBLE) AS line_cost,
       price_start_time, price_end_time
FROM priced"""

SINCE = f"CAST(date_diff('day', {AS_OF}, current_date) AS INTEGER)"
TODAY_STATUS = _with(f"""
usage_today AS (SELECT * REPLACE (usage_end_time + to_days({SINCE}) AS usage_end_time, usage_date + {SINCE} AS usage_date) FROM usage),
prices_today AS (SELECT * REPLACE (price_start_time + to_days({SINCE}) AS price_start_time, price_end_time + to_days({SINCE}) AS price_end_time) FROM list_prices)""",
                     _status(as_of="current_date").replace("FROM usage u", "FROM usage_today u").replace("JOIN list_prices p", "JOIN prices_today p")) + """
SELECT budget_status, CAST(current_spend AS DOUBLE) AS current_spend FROM status"""

_FORMS = "[" + ", ".join(f"'{x}'" for x in fx.NUMBER_FORMS) + "]"
NUMBER_ITEMS = f"""
SELECT item, {_normalized('item')} AS target_id FROM (
  SELECT replace({_FORMS}[CAST(p_partkey % {len(fx.NUMBER_FORMS)} + 1 AS INTEGER)], '#', CASE p_partkey % 4
           WHEN 1 THEN translate(CAST(p_partkey AS VARCHAR), '0123456789', '{fx.ARABIC}')
           WHEN 2 THEN translate(CAST(p_partkey AS VARCHAR), '0123456789', '{fx.DEVANAGARI}')
           WHEN 3 THEN translate(CAST(p_partkey AS VARCHAR), '0123456789', '{fx.WIDE}') ELSE CAST(p_partkey AS VARCHAR) END) AS item
  FROM part)"""

_ID_FORMS = "[" + ", ".join(f"'{x}'" for x in fx.JOB_ID_FORMS) + "]"
SPELLED = f"""
spelled AS (
  SELECT 'JOB' AS resource_type, 'STOPPED' AS action,
         CASE form WHEN 'wide' THEN translate(key, '0123456789', '{fx.WIDE}') WHEN 'arabic' THEN translate(key, '0123456789', '{fx.ARABIC}')
              ELSE replace(form, '#', key) END AS resource_id,
         'n' || key AS resource_name, o_orderdate AS "timestamp", 'budget_enforcer' AS acted_by, strftime(o_orderdate, '%Y-%m') AS "month"
  FROM (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderdate, {_ID_FORMS}[CAST(o_custkey % {len(fx.JOB_ID_FORMS)} + 1 AS INTEGER)] AS form FROM orders)
)"""
_JOB_ID = f"""CASE WHEN regexp_full_match(replace({_digits('resource_id')}, '_', ''), '[+-]?[0-9]+') AND NOT regexp_matches({_digits('resource_id')}, '{STRAY}')
                   THEN TRY_CAST(replace({_digits('resource_id')}, '_', '') AS BIGINT) END"""
RESUME_SPELLED = _with(SPELLED) + f"""
SELECT resource_id, resource_name, s.job_id,
       CASE WHEN s.job_id IS NULL OR j.job_id IS NULL OR NOT j.has_settings THEN 'FAILED'
            WHEN j.job_kind = 'ON_DEMAND' OR (j.job_kind = 'SCHEDULE' AND j.schedule_cron = '0 0 0 1 1 ? 2099') THEN 'REMOVE_SCHEDULE'
            ELSE 'UNPAUSE' END AS resume_action
FROM (SELECT *, {_JOB_ID} AS job_id FROM spelled) s LEFT JOIN job_kinds j ON s.job_id = j.job_id"""
_DONE = "EXISTS (SELECT 1 FROM outcomes o WHERE o.ok AND o.resource_type = p.resource_type AND o.resource_id = p.resource_id)"
RECORD_ONCE = _with(_stop_plan()) + f"""
SELECT {AUDIT_ROW_COLUMNS}, run_id, (SELECT count(*) FROM stop_plan p WHERE {_DONE}) AS recorded_first, CAST(0 AS BIGINT) AS recorded_again,
       (SELECT count(*) FROM stop_plan p WHERE NOT {_DONE}) AS recorded_rest
FROM (SELECT *, 'run-1' AS run_id FROM stop_plan UNION ALL SELECT *, 'run-2' FROM stop_plan WHERE resource_type = 'APP')"""

_EMPTY_AS_OF = f"DATE '{EMPTY_MONTH_AS_OF.isoformat()}'"

SQL: dict[str, str] = {
    "mtd_usage": _with() + f"""
SELECT sku_name, CAST(usage_quantity AS DOUBLE) AS usage_quantity, usage_end_time, usage_date
FROM usage u WHERE {MTD}""",
    "price_as_of_usage": _with(_priced()) + """
SELECT sku_name, usage_end_time, usage_date, CAST(usage_quantity AS DOUBLE) AS usage_quantity,
       CAST(unit_price AS DOUBLE) AS unit_price, CAST(line_cost AS DOUBLE) AS line_cost,
       price_start_time, price_end_time
FROM priced""",
    "price_as_of_usage_shuffled": _with(_priced()) + """
SELECT sku_name, usage_end_time, usage_date, CAST(usage_quantity AS DOUBLE) AS usage_quantity,
       CAST(unit_price AS DOUBLE) AS unit_price, CAST(line_cost AS DOUBLE) AS line_cost,
       price_start_time, price_end_time
FROM priced""",
    "current_spend": _with(_priced(MTD)) + """
SELECT CAST(SUM(line_cost) AS DOUBLE) AS current_spend FROM priced""",
    "budget_status": _with(_status()) + """
SELECT budget_status, CAST(current_spend AS DOUBLE) AS current_spend FROM status""",
    "budget_status_incremental": _with(_status()) + """
SELECT budget_status, CAST(current_spend AS DOUBLE) AS current_spend FROM status""",
    "budget_status_at_spend": _with(_status(threshold="(SELECT total FROM month_total)")) + """
SELECT budget_status, CAST(current_spend AS DOUBLE) AS current_spend FROM status""",
    "budget_status_empty_month": _with(_status(as_of=_EMPTY_AS_OF)) + """
SELECT budget_status, CAST(current_spend AS DOUBLE) AS current_spend FROM status""",
    "budget_report_line": _with(_status()) + f"""
SELECT '$' || format('{{:,.2f}}', round_even(current_spend, 2)) AS current_spend_text,
       '$' || format('{{:,.2f}}', CAST({fx.THRESHOLD} AS DOUBLE)) AS threshold_text,
       budget_status
FROM status""",
    "targets_parsed": _with() + """
SELECT resource_type, target_id, FALSE AS all_targets FROM targets
UNION ALL
SELECT DISTINCT resource_type, CAST(NULL AS VARCHAR), TRUE FROM list_kinds WHERE all_targets""",
    "jobs_not_exempt_shuffled": _with() + f"SELECT job_id FROM jobs WHERE NOT ({_targeted('JOB', 'CAST(job_id AS VARCHAR)')})",
    "run_cancel_plan_targeted_shuffled": _with() + f"""
SELECT run_id, job_id FROM runs
WHERE active AND {NOT_EXEMPT} AND {_targeted('JOB', 'CAST(job_id AS VARCHAR)')}""",
    "app_stop_plan_all_listed": _with() + f"""
SELECT name FROM apps
WHERE EXISTS (SELECT 1 FROM list_kinds WHERE resource_type = '{fx.EDGE}' AND all_targets) OR {_targeted(fx.EDGE, 'name')}""",
    "app_stop_plan_missing": _with(_stop_plan()) + "SELECT * FROM stop_plan WHERE resource_type <> 'APP'",
    "audit_append_empty": _with(_stop_plan(), _status()) + f"""
SELECT {AUDIT_ROW_COLUMNS}, CAST(0 AS BIGINT) AS added_within FROM stop_plan WHERE (SELECT budget_status FROM status) = 'OVER_BUDGET'""",
    "enforcement_cycle": _with(_stop_plan(), _status()) + f"""
SELECT {AUDIT_ROW_COLUMNS} FROM stop_plan p
WHERE (SELECT budget_status FROM status) = 'OVER_BUDGET'
  AND EXISTS (SELECT 1 FROM outcomes o WHERE o.ok AND o.resource_type = p.resource_type AND o.resource_id = p.resource_id)""",
    "resume_cycle": _with(_resume()) + "SELECT *, CAST(0 AS BIGINT) AS rows_left FROM resume_out",
    "jobs_not_exempt": _with() + f"SELECT job_id FROM jobs WHERE {NOT_EXEMPT}",
    "jobs_targeted": _with() + f"SELECT job_id FROM jobs WHERE {_targeted('JOB', 'CAST(job_id AS VARCHAR)')}",
    "job_kind": _with() + "SELECT job_id, job_kind, previous_pause_status FROM job_kinds WHERE has_settings",
    "job_stop_plan": _with(_job_plan()) + "SELECT * FROM job_plan",
    "job_stop_plan_targeted": _with(_job_plan(True)) + "SELECT * FROM job_plan",
    "job_stop_plan_targeted_shuffled": _with(_job_plan(True)) + "SELECT * FROM job_plan",
    "job_paused_settings": _with(_job_plan()) + """
SELECT job_id, new_schedule_cron, new_schedule_timezone, new_schedule_pause_status, new_continuous_pause_status,
       new_trigger_file_arrival, new_trigger_table_update, new_trigger_pause_status
FROM job_plan""",
    "run_cancel_plan": _with() + f"SELECT run_id, job_id FROM runs WHERE active AND {NOT_EXEMPT}",
    "run_cancel_plan_targeted": _with() + f"""
SELECT run_id, job_id FROM runs
WHERE active AND {NOT_EXEMPT} AND {_targeted('JOB', 'CAST(job_id AS VARCHAR)')}""",
    "cluster_stop_plan": _with(_cluster_plan()) + "SELECT * FROM cluster_plan",
    "cluster_stop_plan_targeted": _with(_cluster_plan(True)) + "SELECT * FROM cluster_plan",
    "warehouse_stop_plan": _with(_warehouse_plan()) + "SELECT * FROM warehouse_plan",
    "warehouse_stop_plan_targeted": _with(_warehouse_plan(True)) + "SELECT * FROM warehouse_plan",
    "app_stop_plan": _with(_app_plan()) + "SELECT * FROM app_plan",
    "app_stop_plan_targeted": _with(_app_plan(True)) + "SELECT * FROM app_plan",
    "stop_plan_union": _with(_stop_plan()) + "SELECT * FROM stop_plan",
    "stop_plan_targeted": _with(_stop_plan(True)) + "SELECT * FROM stop_plan",
    "stop_plan_gated": _with(_stop_plan(), _status()) + """
SELECT p.* FROM stop_plan p WHERE (SELECT budget_status FROM status) = 'OVER_BUDGET'""",
    "stop_plan_gated_within": _with(_stop_plan(), _status(UNREACHABLE_THRESHOLD)) + """
SELECT p.* FROM stop_plan p WHERE (SELECT budget_status FROM status) = 'OVER_BUDGET'""",
    "run_cancel_plan_gated": _with(_status()) + f"""
SELECT run_id, job_id FROM runs
WHERE active AND {NOT_EXEMPT} AND (SELECT budget_status FROM status) = 'OVER_BUDGET'""",
    "action_counts": _with(_stop_plan()) + """
SELECT step, resource_type, COUNT(*) AS actions FROM stop_plan GROUP BY step, resource_type""",
    "audit_rows": _with(_stop_plan()) + f"SELECT {AUDIT_ROW_COLUMNS} FROM stop_plan",
    "audit_rows_succeeded": _with(_stop_plan()) + f"""
SELECT {AUDIT_ROW_COLUMNS} FROM stop_plan p
WHERE EXISTS (SELECT 1 FROM outcomes o
              WHERE o.ok AND o.resource_type = p.resource_type AND o.resource_id = p.resource_id)""",
    "audit_previous_month": _with() + f"SELECT * FROM audit WHERE {PREVIOUS_MONTH}",
    "audit_roundtrip": _with(_stop_plan(), _status()) + f"""
SELECT {AUDIT_ROW_COLUMNS} FROM stop_plan WHERE (SELECT budget_status FROM status) = 'OVER_BUDGET'
UNION ALL
SELECT {AUDIT_ROW_COLUMNS} FROM stop_plan WHERE (SELECT budget_status FROM status) = 'OVER_BUDGET'""",
    "resume_plan": _with(_resume()) + "SELECT * FROM resume_out",
    "resume_plan_unpause_placeholder": _with(_resume(remove_placeholder=False)) + "SELECT * FROM resume_out",
    "resume_plan_shuffled": _with(_resume()) + "SELECT * FROM resume_out",
    "resume_previous_month": _with(_resume(PREVIOUS_MONTH)) + "SELECT * FROM resume_out",
    "resume_job_settings": _with(_resume()) + """
SELECT job_id, new_schedule_cron, new_schedule_timezone, new_schedule_pause_status, new_continuous_pause_status,
       new_trigger_file_arrival, new_trigger_table_update, new_trigger_pause_status
FROM resume_out WHERE resume_action = 'UNPAUSE'""",
    "resume_unknown": _with(_resume()) + """
SELECT resource_type, action, resource_id, resource_name, "timestamp", acted_by, "month"
FROM resume_out WHERE resume_action = 'UNKNOWN'""",
    "budget_status_fractional": FRACTIONAL_STATUS,
    "budget_status_incremental_fractional": FRACTIONAL_STATUS,
    "budget_status_today": TODAY_STATUS,
    "price_as_of_usage_versioned": HOT_PRICED,
    "price_as_of_usage_versioned_shuffled": HOT_PRICED,
    "targets_number_grammar": NUMBER_ITEMS,
    "app_stop_plan_listing_fails": _with(_stop_plan()) + "SELECT * FROM stop_plan WHERE resource_type <> 'APP'",
    "audit_rows_today": _with(_stop_plan()) + """
SELECT resource_type, 'STOPPED' AS action, resource_id, resource_name, 'budget_enforcer' AS acted_by,
       strftime(current_date, '%Y-%m') AS "month", current_date AS day
FROM stop_plan""",
    "audit_previous_month_today": _with() + f"""
SELECT * FROM (SELECT * REPLACE ("timestamp" + to_days({SINCE}) AS "timestamp", strftime("timestamp" + to_days({SINCE}), '%Y-%m') AS "month") FROM audit)
WHERE "month" = strftime(current_date - INTERVAL 1 MONTH, '%Y-%m')""",
    "audit_record_once": RECORD_ONCE,
    "resume_spelled_ids": RESUME_SPELLED,
    "resume_clears_planned": _with(_resume(), SPELLED) + """
SELECT *, 'plan' AS place FROM resume_out
UNION ALL BY NAME
SELECT *, 'table' AS place FROM spelled""",
}
