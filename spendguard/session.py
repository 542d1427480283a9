"""Session helpers for tests, the bench and the driver hook.

Operators never change session settings; only these helpers do, and only for local runs.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "spendguard",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A local session with the settings the oracle comparison relies on (UTC, AQE on, no UI)."""
    builder = SparkSession.builder
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPENDGUARD_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session has none is ``fallback`` installed, or, in a session whose tasks all run
    in this process (master ``local``: tests, the bench), a new temporary folder. On a cluster
    without the setting this raises: a machine-local folder is invisible to other executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    target = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not target and re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        target = tempfile.mkdtemp(prefix="spendguard-checkpoints-")
    if not target:
        raise RuntimeError("spark.checkpoint.dir is not set and no fallback was given")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target
