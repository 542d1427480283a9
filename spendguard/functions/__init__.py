"""Column-level helpers: id normalisation and target lists, dates, money text."""

from spendguard.functions.dates import as_of_date, month_label, month_start, now_timestamp, previous_month_label
from spendguard.functions.ids import (
    explode_target_lists,
    id_list,
    is_all_targets,
    normalize_id,
    parse_integer,
    parse_targets,
    strip_text,
)
from spendguard.functions.money import exact_product, money_text, product_as_double, whole_parts, with_double

__all__ = [
    "as_of_date",
    "exact_product",
    "explode_target_lists",
    "id_list",
    "is_all_targets",
    "month_label",
    "month_start",
    "money_text",
    "normalize_id",
    "now_timestamp",
    "parse_integer",
    "parse_targets",
    "previous_month_label",
    "product_as_double",
    "strip_text",
    "whole_parts",
    "with_double",
]
