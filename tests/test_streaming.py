"""Incremental usage totals: each file is summed once, and the check over the sums equals the batch."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from spendguard.plans import budget_check
from spendguard.sources import fixtures as fx
from spendguard.streaming import read_usage_totals, start_usage_totals, usage_totals

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="generated tables not present")


def _check(usage, prices):
    return tuple(budget_check(usage, prices, fx.THRESHOLD, fx.AS_OF).first())


@pytest.fixture
def landing(spark, tmp_path):
    """A folder that usage files land in, and a way to run the stream over what has arrived."""
    lineitem = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    path, table = str(tmp_path / "landing"), f"7_sg_{tmp_path.name}"

    def run():
        stream = fx.usage_from_lineitem(spark.readStream.schema(lineitem.schema).parquet(path))
        query = start_usage_totals(stream, table=table, checkpoint=str(tmp_path / "stream"))
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    yield lineitem, path, table, run
    spark.sql(f"DROP TABLE IF EXISTS `{table}`")


def test_two_runs_read_only_new_files_and_match_the_batch(spark, landing):
    lineitem, path, table, run = landing
    first, second = lineitem.filter("l_orderkey % 2 = 0"), lineitem.filter("l_orderkey % 2 = 1")
    prices = fx.list_prices(spark, SF_DIR)
    first.write.parquet(path)
    assert run() == first.count()
    assert _check(read_usage_totals(spark, table), prices) == _check(fx.usage_from_lineitem(first), prices)
    early = spark.table(f"`{table}`").where("batch_id = 0").collect()
    second.write.mode("append").parquet(path)
    assert run() == second.count()
    assert _check(read_usage_totals(spark, table), prices) == _check(fx.usage(spark, SF_DIR), prices)
    assert sorted(map(str, spark.table(f"`{table}`").where("batch_id = 0").collect())) == sorted(map(str, early))  # untouched
    assert run() == 0


def test_a_price_that_arrives_late_prices_earlier_usage(spark, landing):
    lineitem, path, table, run = landing
    lineitem.write.parquet(path)
    run()
    prices = fx.list_prices(spark, SF_DIR)
    few = prices.filter(F.crc32(F.col("sku_name").cast("binary")) % 3 == 0)
    for known in (few, prices):
        assert _check(read_usage_totals(spark, table), known) == _check(fx.usage(spark, SF_DIR), known)


def test_a_repeated_batch_replaces_its_own_partition(spark, landing, tmp_path):
    """The stream's checkpoint is lost after the write: the batch runs again under its number."""
    import shutil

    lineitem, path, table, run = landing
    lineitem.write.parquet(path)
    run()
    shutil.rmtree(tmp_path / "stream" / "commits")
    run()
    totals = read_usage_totals(spark, table)
    assert totals.agg(F.sum("usage_quantity")).first()[0] == fx.usage(spark, SF_DIR).agg(F.sum("usage_quantity")).first()[0]


def test_price_list_beyond_the_broadcast_bound(spark):
    usage, prices = fx.usage(spark, SF_DIR), fx.list_prices(spark, SF_DIR)
    shuffled = budget_check(usage_totals(usage), prices, fx.THRESHOLD, fx.AS_OF, max_broadcast_rows=0)
    assert tuple(shuffled.first()) == _check(usage, prices)


def test_no_totals_are_within_budget(spark):
    assert _check(usage_totals(fx.usage(spark, SF_DIR).limit(0)), fx.list_prices(spark, SF_DIR)) == ("WITHIN_BUDGET", None)


def test_fractions_of_a_millionth_decide_alike(spark):
    """Ten rows of a millionth at a price of 0.4 pass a threshold that their cut total would not."""
    from decimal import Decimal

    from spendguard import schemas as S

    at = dt.datetime(2026, 4, 2)
    usage = spark.createDataFrame([("a", Decimal("0.000001"), at, at.date())] * 10, S.USAGE)
    prices = spark.createDataFrame([("a", dt.datetime(2026, 1, 1), None, ((Decimal("0.400000"),),))], S.LIST_PRICES)
    for rows in (usage, usage_totals(usage).withColumn("usage_quantity", F.col("usage_quantity").cast("decimal(28,6)"))):
        assert tuple(budget_check(rows, prices, "0.0000035", at.date()).first()) == ("OVER_BUDGET", Decimal("0.000004000000"))
        assert budget_check(rows, prices, "0.000004", at.date()).first()[0] == "WITHIN_BUDGET"


def test_a_lost_checkpoint_is_refused_or_rebuilds(spark, landing, tmp_path):
    lineitem, path, table, run = landing
    lineitem.write.parquet(path)
    run()
    total = read_usage_totals(spark, table).agg(F.sum("usage_quantity")).first()[0]
    stream = fx.usage_from_lineitem(spark.readStream.schema(lineitem.schema).parquet(path))
    with pytest.raises(ValueError, match="rebuild"):
        start_usage_totals(stream, table=table, checkpoint=str(tmp_path / "other"))
    start_usage_totals(stream, table=table, checkpoint=str(tmp_path / "other"), rebuild=True).awaitTermination()
    assert read_usage_totals(spark, table).agg(F.sum("usage_quantity")).first()[0] == total
    assert run() == 0  # the first checkpoint is still known
