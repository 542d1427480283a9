"""Budget check: price month-to-date usage against the effective-dated price list, total it and
compare the total with a threshold.

Plan at scale: the month filter prunes DATE partitions of ``usage``; only the four used usage
columns and the one nested price field are read; the price list is broadcast behind a size
check, so usage is never shuffled; each scan task adds a partial sum and one row per task
reaches the final sum.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendguard.functions.dates import month_start
from spendguard.functions.money import exact_product, money_text, product_as_double, whole_parts, with_double
from spendguard.operators.range_join import DEFAULT_SALT_BUCKETS, effective_dated_join
from spendguard.operators.sizing import DEFAULT_MAX_BROADCAST_ROWS
from spendguard.schemas import DEFAULT_THRESHOLD, OVER_BUDGET, WITHIN_BUDGET

PRICE_FIELD = "pricing.effective_list.default"

AsOf = _dt.date | str | Column | None


def threshold_value(threshold: object) -> Column:
    """The threshold as an exact decimal literal (never spliced into SQL text). Text such as
    ``"5e4"`` is read as the number it denotes; a Column is used as it is."""
    if isinstance(threshold, Column):
        return threshold
    value = Decimal(str(threshold).strip())
    if not value.is_finite():
        raise ValueError(f"threshold must be a finite number, got {threshold!r}")
    if value.as_tuple().exponent > 0:  # 5E+4: Spark has no negative-scale decimals
        value = value.quantize(Decimal(1))
    return F.lit(value)


def month_to_date(usage: DataFrame, as_of: AsOf = None, date_col: str = "usage_date") -> DataFrame:
    """Usage from the first day of ``as_of``'s month on. There is no upper bound: rows dated
    after ``as_of`` count as well."""
    return usage.filter(F.col(date_col) >= month_start(as_of))


def price_usage(usage: DataFrame, prices: DataFrame, *, price_field: str = PRICE_FIELD,
                max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                salt_buckets: int = DEFAULT_SALT_BUCKETS) -> DataFrame:
    """Each usage row with the price version in force at its ``usage_end_time``, plus
    ``unit_price`` and ``line_cost = usage_quantity * unit_price``.

    Unpriced usage drops out; usage under two overlapping versions is priced twice. The cost keeps
    every decimal place, also for quantities that were summed before (see ``exact_product``).
    """
    priced = _in_force(usage, _price_versions(prices, price_field), max_broadcast_rows=max_broadcast_rows, salt_buckets=salt_buckets)
    return priced.withColumn("line_cost", _cost(priced))


def price_usage_in_doubles(usage: DataFrame, prices: DataFrame, *, price_field: str = PRICE_FIELD, **join_options) -> DataFrame:
    """``price_usage`` with quantity, price and cost as doubles, each the one nearest to the exact amount.

    Where usage meets many versions the rows made outnumber those read by far, so what belongs to
    one side is converted before the join; left after it are a product and a quotient of doubles.
    """
    versions = _price_versions(prices, price_field)
    kinds = [usage.schema["usage_quantity"].dataType, versions.schema["unit_price"].dataType]
    if not all(isinstance(kind, T.DecimalType) for kind in kinds):
        priced = with_double(price_usage(usage, prices, price_field=price_field, **join_options), "line_cost")
        return priced.withColumns({c: F.col(c).cast("double") for c in ("usage_quantity", "unit_price")})
    sides = []
    for side, name, kind in zip((usage, versions), ("usage_quantity", "unit_price"), kinds):
        digits, unit = whole_parts(F.col(name), kind)
        sides.append(side.withColumns({f"_{name}": F.col(name).cast("double"), f"_{name}_digits": digits, f"_{name}_unit": unit}))
    priced = _in_force(*sides, **join_options)
    parts = [(F.col(f"_{name}_digits"), F.col(f"_{name}_unit")) for name in ("usage_quantity", "unit_price")]
    cost = product_as_double(*parts, _cost(priced))
    amounts = {"usage_quantity": F.col("_usage_quantity"), "unit_price": F.col("_unit_price"), "line_cost": cost}
    return priced.withColumns(amounts).drop(*[f"_{name}{part}" for name in ("usage_quantity", "unit_price") for part in ("", "_digits", "_unit")])


def _price_versions(prices: DataFrame, price_field: str) -> DataFrame:
    return prices.select("sku_name", "price_start_time", "price_end_time", F.col(price_field).alias("unit_price"))


def _in_force(usage: DataFrame, versions: DataFrame, **join_options) -> DataFrame:
    return effective_dated_join(usage, versions, key="sku_name", at="usage_end_time", start="price_start_time",
                                end="price_end_time", **join_options)


def _cost(priced: DataFrame) -> Column:
    kinds = {f.name: f.dataType for f in priced.schema.fields}
    return exact_product(F.col("usage_quantity"), kinds["usage_quantity"], F.col("unit_price"), kinds["unit_price"])


def current_spend(priced: DataFrame) -> DataFrame:
    """One row, ``current_spend``; NULL when nothing was priced."""
    return priced.agg(F.sum("line_cost").alias("current_spend"))


def budget_status_of(spend: DataFrame, threshold: object = DEFAULT_THRESHOLD) -> DataFrame:
    """Strictly above the threshold is over budget; a NULL total is within budget."""
    over = F.col("current_spend") > threshold_value(threshold)
    status = F.when(over, F.lit(OVER_BUDGET)).otherwise(F.lit(WITHIN_BUDGET))
    return spend.select(status.alias("budget_status"), F.col("current_spend"))


def budget_check(usage: DataFrame, prices: DataFrame, threshold: object = DEFAULT_THRESHOLD,
                 as_of: AsOf = None, **join_options) -> DataFrame:
    """``(budget_status, current_spend)``, always exactly one row."""
    priced = price_usage(month_to_date(usage, as_of), prices, **join_options)
    return budget_status_of(current_spend(priced), threshold)


def status_values(status: DataFrame) -> tuple[str, Decimal | None]:
    """Fetch the one status row to the driver: ``(budget_status, current_spend)``."""
    row = status.first()
    return row["budget_status"], row["current_spend"]


def task_values(status: DataFrame) -> DataFrame:
    """The status as handed to the next step: spend as a double."""
    return status.select("budget_status", F.col("current_spend").cast("double").alias("current_spend"))


def report_line(status: DataFrame, threshold: object = DEFAULT_THRESHOLD) -> DataFrame:
    """Spend and threshold as money text, next to the status."""
    return status.select(
        money_text(F.col("current_spend")).alias("current_spend_text"),
        money_text(threshold_value(threshold)).alias("threshold_text"),
        F.col("budget_status"),
    )
