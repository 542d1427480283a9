"""Money: exact products of wide decimals, and money text: ``$1,234,567.89``, rounding half to even at
the cent like Python's Decimal formatting of the spend. NULL spend gives NULL text (the original job
fails there instead)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DIGITS = 38
#: Decimal places of most amounts: cents, and prices of parts of them.
USUAL_PLACES = 6
#: Whole numbers below this are doubles without loss.
WHOLE_DOUBLES = float(1 << 53)


def money_text(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.bround(amount, 2), 2))


def exact_product(quantity: Column, quantity_type: T.DataType, price: Column, price_type: T.DataType) -> Column:
    """``quantity * price`` with every decimal place.

    Where the product's digits may pass 38, Spark cuts its scale; the quantity is then multiplied in
    two limbs, multiples of a power of ten and the rest. Each partial product fits as it is, and
    their sum is a decimal(38) with all places; a product that does not fit into it is an error, as an
    overflow is anywhere. Types other than decimals are multiplied as they are.
    """
    if not (isinstance(quantity_type, T.DecimalType) and isinstance(price_type, T.DecimalType)):
        return quantity * price
    scale = quantity_type.scale + price_type.scale
    if quantity_type.precision + price_type.precision + 1 <= MAX_DIGITS:
        return quantity * price
    whole = quantity_type.precision - quantity_type.scale
    places = max(1, whole + price_type.precision + 1 - MAX_DIGITS)  # of the lower limb, before the point
    if places + quantity_type.scale + price_type.precision + 1 > MAX_DIGITS or scale + 2 > MAX_DIGITS or places >= whole:
        return quantity * price  # too wide for two limbs
    unit = F.lit(10 ** places).cast(T.DecimalType(places + 1, 0))
    high = F.floor(quantity / unit).cast(T.DecimalType(whole - places + 1, 0))
    low = (quantity - (high * unit).cast(quantity_type)).cast(T.DecimalType(places + quantity_type.scale, quantity_type.scale))
    high_cost = (high.cast(T.DecimalType(whole - places, 0)) * price).cast(T.DecimalType(MAX_DIGITS - places - 2, price_type.scale)) * unit
    part = T.DecimalType(MAX_DIGITS - 1, scale)
    return high_cost.cast(part) + (low * price).cast(part)


def with_double(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the decimal column ``name`` cast to double.

    Java makes a double of a decimal of more than 15 digits by way of its text, and trailing zeros
    count. An amount that is the same with fewer places is therefore cast from those: the double
    nearest to it is the same one. Any other amount is cast as it is.
    """
    kind = rows.schema[name].dataType
    amount, short = F.col(name), F.col("_short")
    if not isinstance(kind, T.DecimalType) or kind.scale <= USUAL_PLACES or kind.precision >= MAX_DIGITS:
        return rows.withColumn(name, amount.cast("double"))
    # one digit more, as rounding may carry
    fewer = T.DecimalType(kind.precision - kind.scale + USUAL_PLACES + 1, USUAL_PLACES)
    rows = rows.withColumn("_short", amount.cast(fewer))
    return rows.withColumn(name, F.when(short == amount, short.cast("double")).otherwise(amount.cast("double"))).drop("_short")


def whole_parts(amount: Column, kind: T.DecimalType) -> tuple[Column, Column]:
    """``(digits, unit)``, two doubles: the amount is exactly ``digits / unit``, whole digits over a power of
    ten, with as few places as hold it. Digits are NULL where the usual places do not hold it, and for
    amounts too large to be scaled as doubles."""
    unit = F.lit(None).cast("double")
    for places in sorted({0, min(2, kind.scale), min(USUAL_PLACES, kind.scale)}, reverse=True):
        # one digit more, as rounding may carry
        fewer = amount.cast(T.DecimalType(min(MAX_DIGITS, kind.precision - kind.scale + places + 1), places))
        unit = F.when(fewer == amount, F.lit(float(10 ** places))).otherwise(unit)
    # two roundings of less than 1/8 digit each below this bound: the nearest whole number has the digits
    digits = F.rint(amount.cast("double") * unit)
    return F.when(F.abs(digits) < WHOLE_DOUBLES / 8, digits), unit


def product_as_double(quantity: tuple[Column, Column], price: tuple[Column, Column], exact: Column) -> Column:
    """The double nearest to a product: of two amounts by their ``whole_parts``, where the product of the
    digits is without loss (a quotient of such doubles is rounded once), else ``exact``, their decimal product."""
    digits = quantity[0] * price[0]
    # no negative zero, as decimals have none
    return F.when(F.abs(digits) < WHOLE_DOUBLES, digits / (quantity[1] * price[1]) + F.lit(0.0)).otherwise(exact.cast("double"))
