from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from spendguard import schemas as S  # noqa: E402
from spendguard.session import checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[*]")
        .appName("spendguard-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    # Tests only: install a checkpoint folder when the session has none.
    checkpoint_dir(session, fallback=str(base / "checkpoints"))
    yield session
    session.stop()


def schedule(cron="0 0 8 * * ?", tz="UTC", status="UNPAUSED"):
    return (cron, tz, status)


def settings(name, *, schedule=None, continuous=None, trigger=None):
    return (name, schedule, continuous, trigger)


def job(job_id, status="UNPAUSED"):
    """An inventory row: a job on a schedule, named after its id."""
    return (job_id, settings(f"job {job_id}", schedule=schedule(status=status)))


@pytest.fixture
def jobs_df(spark):
    def build(rows):
        return spark.createDataFrame(rows, S.JOBS)
    return build


@pytest.fixture
def clusters_df(spark):
    def build(rows):
        return spark.createDataFrame(rows, S.CLUSTERS)
    return build


def ids(df, col):
    return sorted(r[col] for r in df.collect())
