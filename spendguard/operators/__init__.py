"""Relational building blocks: checked broadcasts, id-set selection, the budget gate, the
effective-dated range join and job-settings rewrites."""

from spendguard.operators.job_settings import (
    current_pause_status,
    is_paused,
    job_kind,
    paused_settings,
    resume_decision,
    scheduling_settings,
)
from spendguard.operators.range_join import effective_dated_join
from spendguard.operators.selection import (
    CheckedIds,
    check_id_sets,
    check_ids,
    drop_exempt,
    drop_self,
    gate,
    only_targets,
)
from spendguard.operators.sizing import broadcast_if_bounded, has_at_most, shuffle_side

__all__ = [
    "CheckedIds",
    "broadcast_if_bounded",
    "check_id_sets",
    "check_ids",
    "current_pause_status",
    "drop_exempt",
    "drop_self",
    "effective_dated_join",
    "gate",
    "has_at_most",
    "is_paused",
    "job_kind",
    "only_targets",
    "paused_settings",
    "resume_decision",
    "scheduling_settings",
    "shuffle_side",
]
