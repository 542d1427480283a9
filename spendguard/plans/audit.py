"""The audit table: one row per resource a stop plan stopped, read later to resume them.

Writes go through the catalog (``CREATE TABLE IF NOT EXISTS`` + an append by column name), so
a failed task is retried by Spark and the job commit keeps the table whole.
"""

from __future__ import annotations

import datetime as _dt
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendguard.functions.dates import month_label, now_timestamp, previous_month_label
from spendguard.operators.sizing import DEFAULT_MAX_BROADCAST_ROWS, broadcast_if_bounded, shuffle_side
from spendguard.schemas import ACTED_BY, ACTION_STOPPED, AUDIT, AUDIT_COLUMNS

MONTH_ALL = None
MONTH_PREVIOUS = "previous"
# Names the control run that recorded a row, in tables that tell runs apart.
RUN_ID = "run_id"


def audit_rows(plan: DataFrame, now: _dt.datetime | str | Column | None = None, *,
               action: str = ACTION_STOPPED, acted_by: str = ACTED_BY) -> DataFrame:
    """Stamp stop-plan rows: ids as text, one ``now`` for the whole batch, ``month`` from it."""
    ts = now_timestamp(now)
    return plan.select(
        F.col("resource_type").cast("string").alias("resource_type"),
        F.lit(action).alias("action"),
        F.col("resource_id").cast("string").alias("resource_id"),
        F.col("resource_name").cast("string").alias("resource_name"),
        ts.alias("timestamp"),
        F.lit(acted_by).alias("acted_by"),
        month_label(ts).alias("month"),
    )


def succeeded(plan: DataFrame, outcomes: DataFrame, *,
              max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Plan rows whose action succeeded, from ``outcomes(resource_type, resource_id, ok)``.

    A semi-join: each plan row appears at most as often as in the plan, whatever duplicates
    the outcome log holds. Failed or unreported actions are not audited.
    """
    ok = outcomes.filter(F.col("ok")).select(
        F.col("resource_type").alias("_ok_type"), F.col("resource_id").cast("string").alias("_ok_id"))
    side, small = broadcast_if_bounded(ok, max_broadcast_rows)
    ok = side if small else shuffle_side(ok)  # an aggregate here would keep AQE from splitting a hot id
    cond = (F.col("resource_type") == F.col("_ok_type")) & (F.col("resource_id").cast("string") == F.col("_ok_id"))
    return plan.join(ok, cond, "left_semi")


def _parts(table: str) -> list[str]:
    """The parts of a dotted name; a dot within backticks belongs to its part."""
    return [(quoted.replace("``", "`") if quoted else plain)
            for quoted, plain in re.findall(r"`((?:[^`]|``)+)`|([^.`]+)", table)]


def _join(parts: list[str]) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def quote_name(table: str) -> str:
    """The name with every part in backticks, so that hyphens and other characters are allowed."""
    return _join(_parts(table))


def ensure_table(spark: SparkSession, table: str, fmt: str = "parquet", location: str | None = None) -> None:
    """Create the schema (when the name has one) and the audit table if they are missing.

    ``location`` makes it an external table at that (shared) path instead of a managed one.
    """
    parts = _parts(table)
    if len(parts) > 1:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {_join(parts[:-1])}")
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}" for f in AUDIT.fields)
    where = "" if location is None else " LOCATION '" + location.replace("'", "\\'") + "'"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quote_name(table)} ({cols}) USING {fmt}{where}")


def ensure_run_ids(spark: SparkSession, table: str) -> None:
    """Give the audit table a ``run_id`` column if it has none; rows so far belong to no run."""
    ensure_table(spark, table)
    if RUN_ID not in [c.lower() for c in spark.table(quote_name(table)).columns]:
        spark.sql(f"ALTER TABLE {quote_name(table)} ADD COLUMNS ({RUN_ID} STRING)")


def append(rows: DataFrame, table: str, *, skip_empty: bool = True, schema: T.StructType = AUDIT) -> int:
    """Append audit rows, matched to the table by column name, and return how many were written.

    An empty ``rows`` writes nothing (checked with a one-row probe, not a count). The number is
    observed while the write runs, so it costs no second pass over the rows.
    """
    spark = rows.sparkSession
    ensure_table(spark, table)
    if skip_empty and rows.isEmpty():
        return 0
    written = Observation(f"spendguard_audit_append_{uuid.uuid4().hex}")
    insert_by_name(rows.observe(written, F.count(F.lit(1)).alias("rows")), table, schema)
    return int(written.get["rows"])


def insert_by_name(rows: DataFrame, table: str, schema: T.StructType, *, overwrite: bool = False) -> None:
    """Write the columns of ``schema`` into an existing table, each into the column of its name
    whatever the table's order; further columns of the table get NULL. A table that lacks one of
    them is an error."""
    name = quote_name(table)
    given = {f.name.lower(): f for f in schema.fields}
    there = rows.sparkSession.table(name).schema.fields
    missing = set(given) - {f.name.lower() for f in there}
    if missing:
        raise ValueError(f"{table} has no column {', '.join(sorted(missing))}")
    columns = [F.col(given[f.name.lower()].name).cast(f.dataType).alias(f.name) if f.name.lower() in given
               else F.lit(None).cast(f.dataType).alias(f.name) for f in there]
    rows.select(*columns).write.insertInto(name, overwrite=overwrite)


def record_actions(plan: DataFrame, table: str, *, outcomes: DataFrame | None = None,
                   now: _dt.datetime | str | Column | None = None, run_id: str | None = None,
                   max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> int:
    """Stop plan -> (successful rows only, when outcomes are given) -> audit rows -> append.
    Returns the number of actions recorded.

    With ``run_id`` an action is recorded once per run: what the run has recorded before (an earlier
    attempt of the same step, or the calls that succeeded then) is left out, and what has succeeded
    since is added. The rows carry the run, so other runs' rows of the same resource stand beside
    them. One attempt of a run writes at a time; two at once could both add a row.
    """
    done = succeeded(plan, outcomes, max_broadcast_rows=max_broadcast_rows) if outcomes is not None else plan
    rows = audit_rows(done, now)
    if run_id is None:
        return append(rows, table)
    spark = plan.sparkSession
    ensure_run_ids(spark, table)
    spark.catalog.refreshTable(quote_name(table))
    before = spark.table(quote_name(table)).where(F.col(RUN_ID) == F.lit(run_id)).select(
        F.col("resource_type").alias("_done_type"), F.col("resource_id").alias("_done_id"))
    before, _ = broadcast_if_bounded(before, max_broadcast_rows)
    same = F.col("resource_type").eqNullSafe(F.col("_done_type")) & F.col("resource_id").eqNullSafe(F.col("_done_id"))
    schema = T.StructType([*AUDIT.fields, T.StructField(RUN_ID, T.StringType())])
    return append(rows.join(before, same, "left_anti").withColumn(RUN_ID, F.lit(run_id)), table, schema=schema)


def read_audit(spark: SparkSession, table: str, *, month_filter: str | None = MONTH_ALL,
               as_of: _dt.date | str | Column | None = None) -> DataFrame:
    """All audit rows, or with ``month_filter="previous"`` only those of the month before
    ``as_of``."""
    return filter_month(spark.table(quote_name(table)).select(*AUDIT_COLUMNS), month_filter=month_filter, as_of=as_of)


def filter_month(audit: DataFrame, *, month_filter: str | None = MONTH_ALL,
                 as_of: _dt.date | str | Column | None = None) -> DataFrame:
    if month_filter is MONTH_ALL:
        return audit
    if month_filter != MONTH_PREVIOUS:
        raise ValueError(f"month_filter must be None or {MONTH_PREVIOUS!r}")
    return audit.filter(F.col("month") == previous_month_label(as_of))


@dataclass(frozen=True)
class AuditSnapshot:
    """The audit rows as they stood at one moment: what is appended later is neither read through
    ``rows`` nor removed by ``clear(..., only=snapshot)``."""

    rows: DataFrame
    files: tuple[str, ...]  # of the table at that moment; data files never change


def read_snapshot(spark: SparkSession, table: str) -> AuditSnapshot:
    """All audit rows of this moment: the table's files are listed once, and those files are read. For
    tables of plain files without partitions, which is what ``ensure_table`` makes."""
    name = quote_name(table)
    spark.catalog.refreshTable(name)
    whole = spark.table(name)
    described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    if "# Partition Information" in described:
        raise ValueError(f"{table} is partitioned: its rows of one moment cannot be told by files alone")
    files = tuple(whole.inputFiles())
    rows = spark.read.format(described["Provider"]).schema(whole.schema).load(list(files)) if files else whole.limit(0)
    return AuditSnapshot(rows, files)


def clear(spark: SparkSession, table: str, *, only: AuditSnapshot | None = None) -> None:
    """Remove every audit row (all months). An external table, which cannot be truncated, is
    overwritten with no rows.

    With ``only`` the rows of that snapshot go and no others: its files are removed, and rows
    appended since stand in files of their own. A file that is gone already is no error, so a clear
    that was broken off can be repeated.
    """
    name = quote_name(table)
    if only is not None:
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        for file in only.files:  # names alone: as many as the table has files
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
            path.getFileSystem(conf).delete(path, False)
        spark.catalog.refreshTable(name)
    elif spark.catalog.getTable(name).tableType == "EXTERNAL":
        spark.createDataFrame([], spark.table(name).schema).write.insertInto(name, overwrite=True)
        spark.catalog.refreshTable(name)
    else:
        spark.sql(f"TRUNCATE TABLE {name}")
