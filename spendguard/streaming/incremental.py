"""The budget check without re-reading the month: usage is summed once, when it arrives.

A daily batch check reads all usage of the month so far (terabytes late in a month on a large
account). Here a Structured Streaming query with an ``availableNow`` trigger, started on the same
schedule, reads only the files that arrived since its last run and sums their quantities per SKU and
end time into a totals table, one partition per micro-batch. The totals table has the columns of a
usage table, so the check itself is :func:`spendguard.plans.budget_check` over it, with the prices of
that moment: a price that arrives late, or a version that changes, counts from the next check on, and
the size of the price list is checked on every run.

No state is kept between batches. A micro-batch replaces its own partition and nothing else, so a
retried batch leaves the same rows, and a reader sees every earlier batch whole at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spendguard.plans.audit import insert_by_name, quote_name
from spendguard.schemas import USAGE_TOTALS


def usage_totals(usage: DataFrame) -> DataFrame:
    """Usage summed per SKU and end time: priced alike, since a price holds for a SKU at a time."""
    return usage.groupBy("sku_name", "usage_end_time", "usage_date").agg(F.sum("usage_quantity").alias("usage_quantity"))


def default_checkpoint(spark: SparkSession, name: str) -> str:
    """A stable folder under the cluster's ``spark.checkpoint.dir`` (the same across runs, so the
    stream resumes where it stopped)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("spark.checkpoint.dir is not set; pass checkpoint= explicitly")
    return f"{base.rstrip('/')}/spendguard/{name}"


def ensure_totals_table(spark: SparkSession, table: str, end_time_type: str = "timestamp") -> None:
    """Create the totals table if it is missing, partitioned by batch. ``end_time_type`` is the type
    of the usage's end times."""
    cols = ", ".join(f"{f.name} {end_time_type if f.name == 'usage_end_time' else f.dataType.simpleString()}" for f in USAGE_TOTALS.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quote_name(table)} ({cols}) USING parquet PARTITIONED BY (batch_id)")


def _has_checkpoint(spark: SparkSession, folder: str) -> bool:
    """Whether a stream has run with this checkpoint folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/metadata")
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def start_usage_totals(usage_stream: DataFrame, *, table: str, checkpoint: str | None = None,
                       trigger: dict | None = None, rebuild: bool = False) -> StreamingQuery:
    """Start summing ``usage_stream`` into ``table``. The default trigger processes what has arrived
    and stops (``availableNow``); pass e.g. ``{"processingTime": "1 hour"}`` to keep it running.

    One checkpoint belongs to one table. A table that holds totals is refused with a new checkpoint:
    the stream would number its batches from 0 again, replace some totals and count others twice.
    If the checkpoint is lost, ``rebuild=True`` empties the table and sums all usage anew.
    """
    spark = usage_stream.sparkSession
    ensure_totals_table(spark, table, usage_stream.schema["usage_end_time"].dataType.simpleString())
    folder = checkpoint or default_checkpoint(spark, f"usage_totals/{table}")
    if not _has_checkpoint(spark, folder) and not spark.table(quote_name(table)).isEmpty():
        if not rebuild:
            raise ValueError(f"{table} holds totals, but {folder} is a new checkpoint: pass rebuild=True to sum all usage anew")
        spark.sql(f"TRUNCATE TABLE {quote_name(table)}")

    def publish(batch: DataFrame, batch_id: int) -> None:
        totals = usage_totals(batch).withColumn("batch_id", F.lit(batch_id).cast("long"))
        session = batch.sparkSession
        key, before = "spark.sql.sources.partitionOverwriteMode", session.conf.get("spark.sql.sources.partitionOverwriteMode")
        session.conf.set(key, "dynamic")  # of the stream's own session: only this batch's partition is replaced
        try:
            insert_by_name(totals, table, totals.schema, overwrite=True)
        finally:
            session.conf.set(key, before)

    writer = usage_stream.writeStream.foreachBatch(publish).option("checkpointLocation", folder)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_usage_totals(spark: SparkSession, table: str) -> DataFrame:
    """The totals as a usage table (the stream writes through its own session, so cached file
    listings of this session are refreshed first)."""
    spark.catalog.refreshTable(quote_name(table))
    return spark.table(quote_name(table)).drop("batch_id")
