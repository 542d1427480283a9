"""Target lists and id normalisation as Column expressions (no UDFs).

A target list is configured as text: ``ALL`` (or blank) means every resource, otherwise a
comma-separated list. Numeric items may arrive mangled by a YAML loader (``7.114e+14``,
``711404742026056.0``), so each item is normalised to the integer text it denotes.
Resource ids themselves are never normalised; only the list items are.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendguard.schemas import ALL_TARGETS

# What an item may look like to be read as a number, once its digits are ASCII and its underscores
# are gone: plain decimal or scientific notation. Spark's string->double cast alone would also accept
# '12345d', '8f' or '0x1p3' and mangle hex-like warehouse ids, which must stay unchanged.
NUMERIC_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
INTEGER_TEXT = r"^[+-]?[0-9]+\z"
# Underscores stand between two digits or nowhere.
_STRAY_UNDERSCORE = r"(^|[^0-9])_|_([^0-9]|\z)"
_BEYOND_ASCII = r"[^\x00-\x7F]"
# Every character that is white space to a text's own strip: all of them lie below U+3001.
_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# A number may have all of it around but the four ASCII separators.
_NUMBER_SPACE = "".join(c for c in _WHITESPACE if not "\x1c" <= c <= "\x1f")

# Whole numbers beyond a long are a long times a power of 2^10, multiplied in limbs of nine digits.
_LIMB, _LIMB_DIGITS, _STEP = 10 ** 9, 9, 10
_LONG = 63
# What a double's size is divided by leaves 2^52.5 to 2^62.5: a whole number, and one that fits a long.
_WHOLE_BITS = 52.5


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it (a lambda's variable)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@lru_cache(maxsize=1)
def _decimal_digits() -> str:
    """The decimal digits of all scripts beyond ASCII, ten of a script in a row."""
    zeros = [c for c in range(0x80, sys.maxunicode + 1) if unicodedata.decimal(chr(c), None) == 0]
    return "".join(chr(zero + k) for zero in zeros for k in range(10))


def ascii_digits(c: Column | str) -> Column:
    """The text with the decimal digits of every script as ASCII digits."""
    digits = _decimal_digits()
    plain = F.translate(_c(c), digits, "0123456789" * (len(digits) // 10))
    return F.when(_c(c).rlike(_BEYOND_ASCII), plain).otherwise(_c(c))


def strip_text(c: Column | str) -> Column:
    """Remove leading/trailing white space of every kind (tabs, newlines, no-break and wide spaces)."""
    return F.trim(_c(c), F.lit(_WHITESPACE))


def number_text(c: Column | str, pattern: str) -> Column:
    """The text as plain ASCII if it is a number of that pattern, else NULL: white space around it,
    digits of any script and single underscores between digits are allowed."""
    def checked(text: Column) -> Column:
        plain = F.replace(text, F.lit("_"), F.lit(""))
        return F.when(plain.rlike(pattern) & ~text.rlike(_STRAY_UNDERSCORE), plain)

    return _let(_let(F.trim(_c(c), F.lit(_NUMBER_SPACE)), ascii_digits), checked)


def _quotient(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


@lru_cache(maxsize=1)
def _powers() -> str:
    """The powers of 2^10 that a double may hold, their limbs lowest first and three empty ones to carry into."""
    def limbs(n: int) -> list[int]:
        return [n % _LIMB, *limbs(n // _LIMB)] if n else [0, 0, 0]

    return ";".join(",".join(map(str, limbs(1 << _STEP * k))) for k in range((1024 - int(_WHOLE_BITS)) // _STEP + 1))


def _digits_of(size: Column) -> Column:
    """All digits of a finite double of 2^63 or more, which is a long times a power of 2^10."""
    def expanded(tens: Column) -> Column:
        power = F.split(F.get(F.split(F.lit(_powers()), ";"), tens), ",").cast("array<bigint>")
        whole = (size / F.pow(F.lit(2.0), tens * _STEP)).cast("long")
        return _let(whole, lambda n: _let(F.array(n % _LIMB, _quotient(n, _LIMB) % _LIMB, _quotient(n, _LIMB * _LIMB)), lambda limbs: _product(power, limbs)))

    return _let(F.floor((F.log2(size) - F.lit(_WHOLE_BITS)) / _STEP).cast("int"), expanded)


def _product(power: Column, limbs: Column) -> Column:
    """A power times three limbs, in one pass: each step meets the last three limbs of the power, and
    their products, two of at most 10^18 and one of 10^10, fit a long with what is carried."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("sum"), F.lit("").alias("text"), zero.alias("last"), zero.alias("before"))

    def text(seen: Column) -> Column:
        return F.concat(F.lpad((seen["sum"] % _LIMB).cast("string"), _LIMB_DIGITS, "0"), seen["text"])

    def step(seen: Column, limb: Column) -> Column:
        found = limb * F.get(limbs, F.lit(0)) + seen["last"] * F.get(limbs, F.lit(1)) + seen["before"] * F.get(limbs, F.lit(2))
        return F.struct((found + _quotient(seen["sum"], _LIMB)).alias("sum"), text(seen).alias("text"), limb.alias("last"), seen["last"].alias("before"))

    # the first step's text is of no limb: nine zeros behind the number
    return F.aggregate(power, start, step, lambda seen: F.ltrim(F.regexp_replace(text(seen), r"0{9}\z", ""), F.lit("0")))


def integer_text(number: Column) -> Column:
    """A double cut towards zero, with all its digits; NULL if it is not finite."""
    def written(value: Column) -> Column:
        size = F.abs(value)
        sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
        return (F.when(size < F.lit(float(2 ** _LONG)), value.cast("long").cast("string"))
                .when(size < F.lit(float("inf")), F.concat(sign, _digits_of(size))))

    return _let(number, written)


def normalize_id(c: Column | str) -> Column:
    """``'7.11404742026056e+14'`` -> ``'711404742026056'``; ``'-5.7'`` -> ``'-5'``;
    ``'0410'`` -> ``'410'``; ``'1_000'`` -> ``'1000'``; ``'1e23'`` -> ``'99999999999999991611392'``: the exact
    integer of the double that the text denotes, cut towards zero.

    Items that are no number are returned unchanged, and so are those without an end (``1e400``).
    """
    return _let(_c(c), lambda text: F.coalesce(integer_text(number_text(text, NUMERIC_TEXT).try_cast(T.DoubleType())), text))


def parse_integer(c: Column | str) -> Column:
    """Integer text -> BIGINT, NULL for anything else (``'12.7'``, ``'bad-1'``) and what does not fit."""
    return number_text(c, INTEGER_TEXT).try_cast("bigint")


def is_all_targets(raw: Column | str) -> Column:
    """True when a raw list means "every resource": ``ALL`` in any case, or blank."""
    text = strip_text(raw)
    return (F.upper(text) == F.lit(ALL_TARGETS)) | (text == F.lit(""))


def explode_target_lists(lists: DataFrame, raw_col: str = "raw", out_col: str = "target_id") -> DataFrame:
    """One row per normalised item of each raw list, and one row without an id and with
    ``all_targets`` true for each ``ALL``/blank list (a NULL list is no list).

    The rows keep every other column of ``lists`` (for example an owner or a resource type), so
    a table of many lists parses in one distributed pass: split, explode, strip, drop empties,
    normalise. ``only_targets`` takes the result as it is and keeps every row where a list said ALL.
    """
    raw = F.col(raw_col)
    keep = [F.col(c) for c in lists.columns if c != raw_col]
    whole = is_all_targets(raw)
    items = lists.filter(raw.isNotNull()).select(
        *keep, whole.alias("all_targets"), F.explode(F.when(whole, F.array(F.lit(""))).otherwise(F.split(raw, ","))).alias("_item"))
    items = items.withColumn("_item", strip_text("_item")).filter(F.col("all_targets") | (F.col("_item") != F.lit("")))
    return items.select(*keep, F.when(~F.col("all_targets"), normalize_id("_item")).alias(out_col), "all_targets")


def parse_targets(spark: SparkSession, raw: object) -> DataFrame | None:
    """Parse one configured target list.

    Returns ``None`` for "every resource" and otherwise a DataFrame of distinct normalised ids,
    possibly empty (``","`` selects nothing). ``raw`` may be text or a number a config loader
    produced; it is read through its text form, as written.
    """
    text = "" if raw is None else str(raw)
    if text.strip() == "" or text.strip().upper() == ALL_TARGETS:
        return None
    one = spark.createDataFrame([(text,)], T.StructType([T.StructField("raw", T.StringType())]))
    return explode_target_lists(one).select("target_id").distinct()


def id_list(values: Iterable[object] | None) -> list[str]:
    """Literal id lists (exempt ids): text form, NULL and blank entries dropped."""
    if values is None:
        return []
    if isinstance(values, (str, int)):
        values = [values]
    out = []
    for v in values:
        if v is None:
            continue
        s = str(v)
        if s != "":
            out.append(s)
    return out
