"""Reading the inputs: catalog tables or Parquet paths."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def read_table(spark: SparkSession, source: str) -> DataFrame:
    """A catalog table name (``catalog.schema.table``) or a Parquet path/directory."""
    if "/" in source or source.endswith(".parquet"):
        return spark.read.parquet(source)
    return spark.table(source)


def read_listing(spark: SparkSession, source: str, schema: T.StructType, *, required: bool = False) -> DataFrame:
    """A listing by the name of its table or its path, with the columns of ``schema``.

    One that cannot be resolved (no such table or path, no files in it, not readable as a table, or
    without a column of ``schema``) counts as empty, with a warning, unless it is ``required``. A read
    that fails later, in a task, fails the query: an action list of half an inventory would be wrong.
    """
    try:
        found = read_table(spark, source)
        return found.select(*(found[f"`{f.name}`"].cast(f.dataType).alias(f.name) for f in schema.fields))
    except AnalysisException as why:
        if required:
            raise
        log.warning("listing %s is not available and counts as empty: %s", source, why.getCondition() or why)
        return spark.createDataFrame([], schema)
