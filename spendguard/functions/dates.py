"""Date helpers. Every time-dependent plan takes an ``as_of`` date / ``now`` timestamp so that
results are reproducible; ``None`` means the query's own ``current_date()``/``current_timestamp()``
(one value per query, so retried tasks agree)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendguard.schemas import MONTH_FORMAT


def as_of_date(as_of: _dt.date | str | Column | None) -> Column:
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of.cast("date")
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.date()
    return F.lit(as_of).cast("date") if isinstance(as_of, _dt.date) else F.to_date(F.lit(str(as_of)))


def now_timestamp(now: _dt.datetime | str | Column | None) -> Column:
    if now is None:
        return F.current_timestamp()
    if isinstance(now, Column):
        return now.cast("timestamp")
    if isinstance(now, str):
        return F.to_timestamp(F.lit(now))
    return F.lit(now).cast("timestamp")


def month_start(as_of: _dt.date | str | Column | None = None) -> Column:
    """First day of the month of ``as_of`` (a DATE, so a DATE partition column prunes on it)."""
    return F.trunc(as_of_date(as_of), "month")


def month_label(ts: Column) -> Column:
    """``yyyy-MM`` label of a date/timestamp, in the session time zone."""
    return F.date_format(ts, MONTH_FORMAT)


def previous_month_label(as_of: _dt.date | str | Column | None = None) -> Column:
    return month_label(F.add_months(as_of_date(as_of), -1))
