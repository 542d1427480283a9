"""Size checks that guard every broadcast.

A side is broadcast only after counting shows it holds at most ``max_rows`` rows and 256 MB of text. The count
is an ordinary partial/final aggregate: one partial count per partition and a one-row-per-
partition exchange, so it costs one scan of the side and nothing more. (A ``limit(n+1)`` count
would instead funnel up to n+1 rows of *every* partition into a single task.) The sides checked
are dimensions, inventories and id sets, never the fact table. Beyond the bound callers take a
shuffle strategy instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A price list, target list or job inventory of up to a million rows, projected to the join
# columns, builds a hashed relation of roughly 100 MB (Spark reserves about 32 MB even for a few
# rows): well within executor memory. Real price lists hold thousands of rows.
DEFAULT_MAX_BROADCAST_ROWS = 1_000_000


# Broadcast text is bounded by its bytes as well: a million rows of long strings are gigabytes.
DEFAULT_MAX_BROADCAST_BYTES = 256 << 20


def text_bytes(df: DataFrame) -> Column:
    """Bytes of the strings of a row, nested ones included."""
    def sizes(column: Column, kind: T.DataType) -> list[Column]:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return [F.coalesce(F.octet_length(column), F.lit(0))]
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in sizes(column.getField(f.name), f.dataType)]
        return []

    out = F.lit(0).cast("long")
    for f in df.schema.fields:
        for x in sizes(F.col(f"`{f.name}`"), f.dataType):
            out = out + x
    return out


def has_at_most(df: DataFrame, max_rows: int, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> bool:
    if max_rows <= 0:
        return False
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(text_bytes(df)), F.lit(0)).alias("bytes")).first()
    return found["rows"] <= max_rows and found["bytes"] <= max_bytes


def shuffle_side(df: DataFrame) -> DataFrame:
    """Mark a join side that must not be broadcast. Without a hint Spark could still broadcast it
    on a file-size estimate, which a well-compressed large table can make look small; a
    sort-merge join spills instead of running out of memory and lets AQE split skewed keys."""
    return df.hint("merge")


def broadcast_if_bounded(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``(broadcast(df), True)`` when ``df`` has at most ``max_rows`` rows, else
    ``(shuffle_side(df), False)``."""
    if has_at_most(df, max_rows):
        return F.broadcast(df), True
    return shuffle_side(df), False
