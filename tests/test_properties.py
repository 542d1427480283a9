"""Property tests on generated inputs.

* The effective-dated join equals a brute-force evaluation of its definition, for random price
  versions (open ends, empty and overlapping intervals, gaps) and usage times on the boundaries,
  under both the broadcast and the salted sort-merge strategy.
* Target-item normalisation gives the same text in Spark as the oracle's SQL in DuckDB.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spendguard import schemas as S
from spendguard.functions import normalize_id
from spendguard.functions.ids import NUMERIC_TEXT
from spendguard.plans import price_usage

BASE = dt.datetime(2026, 1, 1)
SKUS = ["A", "B", "C"]

version = st.tuples(st.sampled_from(SKUS), st.integers(0, 40), st.one_of(st.none(), st.integers(0, 20)),
                    st.integers(1, 9))
fact = st.tuples(st.sampled_from(SKUS + ["Z"]), st.integers(0, 70), st.integers(-3, 9))

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def _brute_force(versions, facts):
    out = []
    for sku, t, q in facts:
        for vsku, start, length, price in versions:
            end = None if length is None else start + length
            if sku == vsku and t >= start and (end is None or t < end):
                out.append((sku, t, q, price))
    return sorted(out)


@SETTINGS
@given(st.lists(version, max_size=8), st.lists(fact, max_size=25))
def test_range_join_matches_brute_force(spark, versions, facts):
    def ts(h):
        return BASE + dt.timedelta(hours=h)

    prices = spark.createDataFrame(
        [(s, ts(a), None if n is None else ts(a + n), ((Decimal(p),),)) for s, a, n, p in versions], S.LIST_PRICES)
    usage = spark.createDataFrame([(s, Decimal(q), ts(t), ts(t).date()) for s, t, q in facts], S.USAGE)
    expected = _brute_force(versions, facts)
    for limit in (1_000_000, 0):
        priced = price_usage(usage, prices, max_broadcast_rows=limit, salt_buckets=3)
        got = sorted((r.sku_name, int((r.usage_end_time - BASE).total_seconds() // 3600), int(r.usage_quantity),
                      int(r.unit_price)) for r in priced.collect())
        assert got == expected


item = st.text(alphabet="0123456789.eE+-xdfn", min_size=1, max_size=10)


@SETTINGS
@given(st.lists(item, min_size=1, max_size=40))
def test_normalize_id_matches_oracle_sql(spark, items):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    got = {r.i: r.n for r in df.select("i", normalize_id(F.col("v")).alias("n")).collect()}
    con = duckdb.connect()
    rows = con.execute(
        f"""SELECT i, CASE WHEN regexp_full_match(v, '{NUMERIC_TEXT}') AND isfinite(TRY_CAST(v AS DOUBLE))
                           THEN CAST(CAST(trunc(TRY_CAST(v AS DOUBLE)) AS BIGNUM) AS VARCHAR) ELSE v END
            FROM (SELECT unnest(range(?)) AS i, unnest(?) AS v)""", [len(items), items]).fetchall()
    assert got == dict(rows)


job_id_text = st.text(alphabet="0123456789 +-.xe", min_size=0, max_size=22)


@SETTINGS
@given(st.lists(job_id_text, min_size=1, max_size=40))
def test_job_id_parse_matches_oracle_sql(spark, items):
    from spendguard.plans import parse_job_id

    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    got = {r.i: r.j for r in df.select("i", parse_job_id(F.col("v")).alias("j")).collect()}
    con = duckdb.connect()
    rows = con.execute(
        r"""SELECT i, TRY_CAST(NULLIF(regexp_extract(v, '^\s*([+-]?[0-9]+)\s*$', 1), '') AS BIGINT)
            FROM (SELECT unnest(range(?)) AS i, unnest(?) AS v)""", [len(items), items]).fetchall()
    assert got == dict(rows)
