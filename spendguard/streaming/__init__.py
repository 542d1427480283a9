"""Incremental execution of the budget check.

The original job is batch only (a daily check, a monthly resume) and nothing in it reads or
writes a stream. The one place where streaming pays at scale is the daily total: instead of
re-reading the month's usage every day, :mod:`spendguard.streaming.incremental` sums each usage
file once as it arrives, and the budget check runs over the sums. Every other plan stays batch.
"""

from spendguard.streaming.incremental import read_usage_totals, start_usage_totals, usage_totals

__all__ = ["read_usage_totals", "start_usage_totals", "usage_totals"]
