"""Every registered query against its independent DuckDB SQL, on the smallest generated tables."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, duck  # noqa: E402

from spendguard.oracle import SQL  # noqa: E402
from spendguard.registry import QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="generated tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_oracle_sql():
    assert set(SQL) == set(QUERIES)
    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, line, details = compare(spark, con, SF_DIR, name, QUERIES[name], SQL[name])
    assert ok, line + "\n" + details


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["budget_status", "current_spend"]
    assert df.count() == 1


TIME_SENSITIVE = ["audit_previous_month", "audit_rows", "resume_plan", "resume_unknown", "budget_status",
                  "mtd_usage", "price_as_of_usage"]


@pytest.mark.parametrize("name", TIME_SENSITIVE)
def test_results_do_not_depend_on_session_time_zone(spark, con, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        ok, line, details = compare(spark, con, SF_DIR, name, entry.queries()[name], entry.oracle_sql()[name])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert ok, line + "\n" + details
