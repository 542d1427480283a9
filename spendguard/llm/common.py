"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that cross to a Python worker at once: a batch of very long documents stays small.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, max_bytes: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches of this session by bytes, so that a Python worker's memory depends
    on the batch bound (or on the one longest row), not on rows times their length. A smaller
    bound that the session already has stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > max_bytes:
        spark.conf.set(key, str(max_bytes))


def text_of(text_col: str) -> Column:
    """The whole text, a null one as the empty text."""
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def column(name: str) -> Column:
    return F.col(f"`{name}`")


_TABLE: dict[Hashable, Any] = {}


def worker_table(key: Hashable, make: Callable[[], Any]) -> Any:
    """A table that a Python worker keeps between tasks, made when it is first asked for. A worker
    keeps the table of one operator only: the next operator's takes its place, so the memory of a
    worker that serves many operators is that of the largest table, not of all."""
    if key not in _TABLE:
        _TABLE.clear()
        _TABLE[key] = make()
    return _TABLE[key]
