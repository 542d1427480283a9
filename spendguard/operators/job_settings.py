"""Job scheduling rewrites as Column expressions over the nested ``settings`` struct.

A job's kind is found by first match: schedule, then continuous, then trigger, else on-demand.
A struct that is present counts even when its fields are NULL. Rewritten settings carry only
the scheduling part, as one struct whose three children are NULL unless that kind changes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendguard.schemas import (
    KIND_CONTINUOUS,
    KIND_ON_DEMAND,
    KIND_SCHEDULE,
    KIND_TRIGGER,
    PAUSED,
    PLACEHOLDER_CRON,
    PLACEHOLDER_TIMEZONE,
    RESUME_REMOVE_SCHEDULE,
    RESUME_UNPAUSE,
    UNPAUSED,
)

PLACEHOLDER_REMOVE = "remove"
PLACEHOLDER_UNPAUSE = "unpause"


def _s(settings: Column | str) -> Column:
    return F.col(settings) if isinstance(settings, str) else settings


def scheduling_settings(settings: Column | str = "settings") -> Column:
    """Only the fields that the rewrites read, with absent structs absent: whatever else a job's
    settings hold is not scanned, shuffled or broadcast."""
    s = _s(settings)
    return F.when(s.isNotNull(), F.struct(
        F.when(s.schedule.isNotNull(), F.struct(s.schedule.quartz_cron_expression.alias("quartz_cron_expression"),
                                                s.schedule.timezone_id.alias("timezone_id"),
                                                s.schedule.pause_status.alias("pause_status"))).alias("schedule"),
        F.when(s.continuous.isNotNull(), F.struct(s.continuous.pause_status.alias("pause_status"))).alias("continuous"),
        F.when(s.trigger.isNotNull(), F.struct(s.trigger.file_arrival.alias("file_arrival"),
                                               s.trigger.table_update.alias("table_update"),
                                               s.trigger.pause_status.alias("pause_status"))).alias("trigger")))


def job_kind(settings: Column | str = "settings") -> Column:
    s = _s(settings)
    return (F.when(s.schedule.isNotNull(), F.lit(KIND_SCHEDULE))
            .when(s.continuous.isNotNull(), F.lit(KIND_CONTINUOUS))
            .when(s.trigger.isNotNull(), F.lit(KIND_TRIGGER))
            .otherwise(F.lit(KIND_ON_DEMAND)))


def current_pause_status(settings: Column | str = "settings") -> Column:
    """Pause status of the kind that wins; NULL for on-demand jobs."""
    s = _s(settings)
    return (F.when(s.schedule.isNotNull(), s.schedule.pause_status)
            .when(s.continuous.isNotNull(), s.continuous.pause_status)
            .when(s.trigger.isNotNull(), s.trigger.pause_status))


def is_paused(settings: Column | str = "settings") -> Column:
    """Already paused: NULL status counts as not paused; on-demand jobs never are."""
    return current_pause_status(settings).eqNullSafe(F.lit(PAUSED))


def _schedule(cron: Column, tz: Column, status: str) -> Column:
    return F.struct(cron.alias("quartz_cron_expression"), tz.alias("timezone_id"), F.lit(status).alias("pause_status"))


def _continuous(status: str) -> Column:
    return F.struct(F.lit(status).alias("pause_status"))


def _trigger(s: Column, status: str) -> Column:
    # Only these two trigger fields carry over; anything else on the trigger is dropped.
    return F.struct(s.trigger.file_arrival.alias("file_arrival"), s.trigger.table_update.alias("table_update"),
                    F.lit(status).alias("pause_status"))


def _settings(schedule: Column, continuous: Column, trigger: Column) -> Column:
    return F.struct(schedule.alias("schedule"), continuous.alias("continuous"), trigger.alias("trigger"))


def paused_settings(settings: Column | str = "settings") -> Column:
    """Settings that pause the job; an on-demand job gets a far-future placeholder schedule."""
    s = _s(settings)
    kind = job_kind(s)
    schedule = (F.when(kind == KIND_SCHEDULE, _schedule(s.schedule.quartz_cron_expression, s.schedule.timezone_id, PAUSED))
                .when(kind == KIND_ON_DEMAND, _schedule(F.lit(PLACEHOLDER_CRON), F.lit(PLACEHOLDER_TIMEZONE), PAUSED)))
    continuous = F.when(kind == KIND_CONTINUOUS, _continuous(PAUSED))
    trigger = F.when(kind == KIND_TRIGGER, _trigger(s, PAUSED))
    return _settings(schedule, continuous, trigger)


def resume_decision(settings: Column | str = "settings", placeholder: str = PLACEHOLDER_REMOVE) -> tuple[Column, Column]:
    """``(action, new_settings)`` that restore a paused job, read from its current settings.

    Nothing checks whether the job is paused now. On-demand jobs get ``REMOVE_SCHEDULE``. A
    schedule equal to the placeholder is removed too under ``placeholder="remove"`` (the
    documented intent); under ``"unpause"`` it is unpaused like any schedule.
    """
    if placeholder not in (PLACEHOLDER_REMOVE, PLACEHOLDER_UNPAUSE):
        raise ValueError(f"placeholder must be {PLACEHOLDER_REMOVE!r} or {PLACEHOLDER_UNPAUSE!r}")
    s = _s(settings)
    kind = job_kind(s)
    remove = kind == KIND_ON_DEMAND
    if placeholder == PLACEHOLDER_REMOVE:
        remove = remove | ((kind == KIND_SCHEDULE)
                           & F.coalesce(s.schedule.quartz_cron_expression == F.lit(PLACEHOLDER_CRON), F.lit(False)))
    action = F.when(remove, F.lit(RESUME_REMOVE_SCHEDULE)).otherwise(F.lit(RESUME_UNPAUSE))
    schedule = F.when(~remove & (kind == KIND_SCHEDULE),
                      _schedule(s.schedule.quartz_cron_expression, s.schedule.timezone_id, UNPAUSED))
    continuous = F.when(kind == KIND_CONTINUOUS, _continuous(UNPAUSED))
    trigger = F.when(kind == KIND_TRIGGER, _trigger(s, UNPAUSED))
    return action, _settings(schedule, continuous, trigger)
