"""Row selection against id sets: targets (semi-join), exemptions (anti-join), the resource the
job runs on (null-safe), and the budget gate.

Id sets come either as literal lists from configuration (bounded by the config text, compiled
into an ``IN`` list) or as DataFrames (a target table may be large): those are joined, broadcast
only behind a size check and shuffled otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendguard.functions.ids import id_list
from spendguard.operators.sizing import DEFAULT_MAX_BROADCAST_BYTES, DEFAULT_MAX_BROADCAST_ROWS, shuffle_side
from spendguard.schemas import OVER_BUDGET
from spendguard.session import checkpoint_dir


@dataclass(frozen=True)
class CheckedIds:
    """A table-valued id set whose size was already checked: ``ids`` has one text column
    ``_id``, hinted for a broadcast when small and for a shuffle join otherwise. ``everything``: one
    of its lists was ALL or blank, so the set names every id."""

    ids: DataFrame
    broadcast: bool
    everything: bool = False


IdSet = DataFrame | CheckedIds | Iterable[object] | None


def _key(key: Column | str) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("string")


def check_ids(ids: DataFrame, max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> CheckedIds:
    """Read an id set once and decide its join strategy.

    The ids are written to the checkpoint folder; their number, their bytes and whether a list names
    every id are taken from what was written, and so are the ids that are joined. The lists behind
    them are scanned, split and normalised a single time, whichever strategy it becomes.

    Duplicates stay in either strategy: they cost nothing in a hash semi/anti join, and an
    aggregation between the exchange and the sort of a large set would keep AQE from splitting a
    hot id of the other side. A set with an ``all_targets`` column (see
    ``explode_target_lists``) names every id where that is true.
    """
    col = "target_id" if "target_id" in ids.columns else ids.columns[0]
    everything = F.coalesce(F.col("all_targets"), F.lit(False)) if "all_targets" in ids.columns else F.lit(False)
    checkpoint_dir(ids.sparkSession)
    kept = ids.select(F.col(col).cast("string").alias("_id"), everything.alias("_all")).where(F.col("_id").isNotNull() | F.col("_all")).checkpoint(eager=True)
    found = kept.agg(F.count("_id").alias("n"), F.coalesce(F.sum(F.octet_length("_id")), F.lit(0)).alias("bytes"),
                     F.coalesce(F.bool_or("_all"), F.lit(False)).alias("everything")).first()
    small = max_broadcast_rows > 0 and found["n"] <= max_broadcast_rows and found["bytes"] <= DEFAULT_MAX_BROADCAST_BYTES
    frame = kept.where(F.col("_id").isNotNull()).select("_id")
    return CheckedIds(F.broadcast(frame) if small else shuffle_side(frame), small, found["everything"])


def check_id_sets(sets: Sequence[IdSet], max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> list[IdSet]:
    """Check every table-valued set of ``sets`` at once: the passes run as concurrent Spark jobs
    (submitted from driver threads) instead of one after another. Other values pass through; the
    same DataFrame given twice is checked once."""
    todo = {id(s): s for s in sets if isinstance(s, DataFrame)}
    if not todo:
        return list(sets)
    inherit = job_properties(next(iter(todo.values())))

    def check(df: DataFrame) -> CheckedIds:
        inherit()
        return check_ids(df, max_broadcast_rows)

    with ThreadPoolExecutor(max_workers=min(8, len(todo))) as pool:
        done = dict(zip(todo, pool.map(check, todo.values())))
    return [done.get(id(s), s) if isinstance(s, DataFrame) else s for s in sets]


_INHERITED = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel", "spark.scheduler.pool")


def job_properties(df: DataFrame):
    """A function that copies the calling thread's job group, description and pool into the
    thread that runs it (they are thread-local), so concurrent checks are attributed to, and
    cancelled with, the caller's job group."""
    try:
        sc = df.sparkSession.sparkContext
    except Exception:  # a remote (Connect) session: nothing to copy
        return lambda: None
    values = {k: sc.getLocalProperty(k) for k in _INHERITED}

    def apply() -> None:
        for key, value in values.items():
            sc.setLocalProperty(key, value)

    return apply


def _checked(ids: DataFrame | CheckedIds, max_broadcast_rows: int) -> CheckedIds:
    return ids if isinstance(ids, CheckedIds) else check_ids(ids, max_broadcast_rows)


def only_targets(df: DataFrame, key: Column | str, targets: IdSet, *,
                 max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Keep rows whose id (as text) is in ``targets``; ``None`` keeps every row.

    An empty list or empty DataFrame keeps nothing: "no ids" is not "all ids". A table of lists of
    which one is ALL keeps every row.
    """
    if targets is None:
        return df
    k = _key(key)
    if isinstance(targets, (DataFrame, CheckedIds)):
        checked = _checked(targets, max_broadcast_rows)
        if checked.everything:
            return df
        return df.join(checked.ids.withColumnRenamed("_id", "_target_id"), k == F.col("_target_id"), "left_semi")
    values = id_list(targets)
    return df.filter(k.isin(values)) if values else df.filter(F.lit(False))


def drop_exempt(df: DataFrame, key: Column | str, exempt: IdSet, *,
                max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Drop rows whose id (as text) is exempt. Blank exempt ids exempt nothing.

    A ``None`` in a literal list stands for an own job id that is not known (not running as a
    job); it compares equal to a row whose id is NULL, so such rows are exempt, exactly as when
    both sides are compared as text (``'None' == 'None'``). A table-valued exempt set lists
    known ids only: NULL entries in it are ignored.

    Written as an anti-join (or a NULL-safe negated ``IN``), never ``NOT IN`` over a set that
    may hold NULL, which would drop every row.
    """
    if exempt is None:
        return df
    k = _key(key)
    if isinstance(exempt, (DataFrame, CheckedIds)):
        checked = _checked(exempt, max_broadcast_rows)
        if checked.everything:
            return df.filter(F.lit(False))
        return df.join(checked.ids.withColumnRenamed("_id", "_exempt_id"), k == F.col("_exempt_id"), "left_anti")
    if isinstance(exempt, (str, int)):
        exempt = [exempt]
    exempt = list(exempt)
    values = id_list(exempt)
    hit = F.coalesce(k.isin(values), F.lit(False)) if values else F.lit(False)
    if any(v is None for v in exempt):
        hit = hit | k.isNull()
    return df.filter(~hit)


def drop_self(df: DataFrame, key: Column | str, own_id: object | None) -> DataFrame:
    """Drop the resource the controlling job itself runs on; NULL equals NULL here, as in Python."""
    k = F.col(key) if isinstance(key, str) else key
    return df.filter(~k.eqNullSafe(F.lit(own_id)))


def gate(plan: DataFrame, status: DataFrame, *, status_col: str = "budget_status",
         open_value: str = OVER_BUDGET) -> DataFrame:
    """Keep ``plan`` only when the one-row ``status`` says ``open_value``.

    The status is a global aggregate, so exactly one row: it runs once as a scalar subquery and
    the plan is filtered by its value, with no join (a second row would fail the query).
    """
    verdict = status.select(F.col(status_col)).scalar()
    return plan.filter(F.coalesce(verdict == F.lit(open_value), F.lit(False)))
