"""Budget check: effective-dated pricing, month-to-date filter, threshold, money text, plans."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendguard import schemas as S
from spendguard.operators import effective_dated_join
from spendguard.plans import budget_check, month_to_date, price_usage, report_line, task_values

T0 = dt.datetime(2026, 4, 1)
AS_OF = dt.date(2026, 4, 15)


def usage(spark, rows):
    """rows: (sku, quantity, end_time); usage_date is the end time's date."""
    data = [(sku, None if q is None else Decimal(str(q)), t, t.date()) for sku, q, t in rows]
    return spark.createDataFrame(data, S.USAGE)


def prices(spark, rows):
    """rows: (sku, start, end, price)."""
    data = [(sku, s, e, ((Decimal(str(p)),),)) for sku, s, e, p in rows]
    return spark.createDataFrame(data, S.LIST_PRICES)


STD_PRICES = [("A", dt.datetime(2026, 1, 1), dt.datetime(2026, 4, 10), 2.0),
              ("A", dt.datetime(2026, 4, 10), None, 3.0),
              ("B", dt.datetime(2026, 1, 1), None, 10.0)]


def spend(status):
    row = status.first()
    return row.budget_status, row.current_spend


@pytest.mark.parametrize("max_rows", [1_000_000, 0])
def test_price_validity_bounds(spark, max_rows):
    u = usage(spark, [
        ("A", 1, dt.datetime(2026, 4, 10)),        # = end of v1 -> out of v1, = start of v2 -> in v2
        ("A", 1, dt.datetime(2026, 4, 9, 23)),     # v1
        ("A", 1, dt.datetime(2025, 12, 31)),       # before the first price: unpriced
        ("C", 1, dt.datetime(2026, 4, 12)),        # SKU without prices
        ("B", 2, dt.datetime(2030, 1, 1)),         # NULL end is open
    ])
    priced = price_usage(u, prices(spark, STD_PRICES), max_broadcast_rows=max_rows, salt_buckets=4)
    got = sorted((r.sku_name, r.usage_end_time, r.unit_price, r.line_cost) for r in priced.collect())
    assert got == [
        ("A", dt.datetime(2026, 4, 9, 23), Decimal("2.000000"), Decimal("2.000000000000")),
        ("A", dt.datetime(2026, 4, 10), Decimal("3.000000"), Decimal("3.000000000000")),
        ("B", dt.datetime(2030, 1, 1), Decimal("10.000000"), Decimal("20.000000000000")),
    ]


@pytest.mark.parametrize("max_rows", [1_000_000, 0])
def test_overlapping_prices_count_twice(spark, max_rows):
    p = prices(spark, [("A", dt.datetime(2026, 1, 1), None, 2.0), ("A", dt.datetime(2026, 3, 1), None, 5.0)])
    u = usage(spark, [("A", 1, dt.datetime(2026, 4, 2))])
    assert spend(budget_check(u, p, threshold=0, as_of=AS_OF, max_broadcast_rows=max_rows)) == (
        "OVER_BUDGET", Decimal("7.000000000000"))


def test_month_filter_bounds(spark):
    u = usage(spark, [("B", 1, dt.datetime(2026, 4, 1)), ("B", 1, dt.datetime(2026, 3, 31, 23)),
                      ("B", 1, dt.datetime(2026, 9, 1))])
    got = sorted(r.usage_date for r in month_to_date(u, AS_OF).collect())
    assert got == [dt.date(2026, 4, 1), dt.date(2026, 9, 1)]  # future usage counts too


def test_threshold_is_strict(spark):
    u = usage(spark, [("B", 5, dt.datetime(2026, 4, 2))])  # spend 50
    p = prices(spark, STD_PRICES)
    assert spend(budget_check(u, p, threshold=50, as_of=AS_OF))[0] == "WITHIN_BUDGET"
    assert spend(budget_check(u, p, threshold="49.99", as_of=AS_OF))[0] == "OVER_BUDGET"
    assert spend(budget_check(u, p, threshold=49, as_of=AS_OF)) == ("OVER_BUDGET", Decimal("50.000000000000"))


def test_empty_month_is_within_with_null_spend(spark):
    u = usage(spark, [("B", 5, dt.datetime(2026, 3, 2))])
    status = budget_check(u, prices(spark, STD_PRICES), threshold=0, as_of=AS_OF)
    assert spend(status) == ("WITHIN_BUDGET", None)
    assert tuple(task_values(status).first()) == ("WITHIN_BUDGET", None)
    assert report_line(status, 0).first().current_spend_text is None


def test_null_zero_negative_quantity(spark):
    u = usage(spark, [("B", None, dt.datetime(2026, 4, 2)), ("B", 0, dt.datetime(2026, 4, 2)),
                      ("B", -1.5, dt.datetime(2026, 4, 3)), ("B", 3, dt.datetime(2026, 4, 3))])
    assert spend(budget_check(u, prices(spark, STD_PRICES), as_of=AS_OF)) == (
        "WITHIN_BUDGET", Decimal("15.000000000000"))


def test_report_line_rounds_half_even(spark):
    status = spark.createDataFrame([("OVER_BUDGET", Decimal("1234567.125"))],
                                   "budget_status string, current_spend decimal(38,12)")
    row = report_line(status, 100000).first()
    assert (row.current_spend_text, row.threshold_text) == ("$1,234,567.12", "$100,000.00")


def test_task_values_cast_to_double(spark):
    u = usage(spark, [("B", 1, dt.datetime(2026, 4, 2))])
    row = task_values(budget_check(u, prices(spark, STD_PRICES), as_of=AS_OF)).first()
    assert row.current_spend == 10.0 and isinstance(row.current_spend, float)


def _plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_broadcasts_prices_and_prunes(spark, tmp_path):
    d = str(tmp_path / "usage")
    u = usage(spark, [("B", 1, dt.datetime(2026, 4, 2)), ("A", 2, dt.datetime(2026, 3, 2))])
    u.write.partitionBy("usage_date").parquet(d)
    status = budget_check(spark.read.parquet(d), prices(spark, STD_PRICES), as_of=AS_OF)
    assert spend(status) == ("WITHIN_BUDGET", Decimal("10.000000000000"))
    plan = _plan_text(status)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "PartitionFilters: [isnotnull(usage_date" in plan and ">= 2026-04-01" in plan


def test_plan_falls_back_to_salted_shuffle(spark):
    u = usage(spark, [("B", 1, dt.datetime(2026, 4, 2))])
    status = budget_check(u, prices(spark, STD_PRICES), as_of=AS_OF, max_broadcast_rows=0, salt_buckets=8)
    assert spend(status) == ("WITHIN_BUDGET", Decimal("10.000000000000"))
    assert "_version_salt" in status._jdf.queryExecution().optimizedPlan().toString()


def test_threshold_text_forms(spark):
    u = usage(spark, [("B", 5, dt.datetime(2026, 4, 2))])  # spend 50
    p = prices(spark, STD_PRICES)
    assert spend(budget_check(u, p, threshold="5e1", as_of=AS_OF))[0] == "WITHIN_BUDGET"
    assert spend(budget_check(u, p, threshold=" 4.9E+1 ", as_of=AS_OF))[0] == "OVER_BUDGET"
    assert report_line(budget_check(u, p, threshold="1e5", as_of=AS_OF), "1e5").first().threshold_text == "$100,000.00"
    with pytest.raises(ValueError):
        budget_check(u, p, threshold="inf", as_of=AS_OF)


def test_sums_of_many_decimals_are_priced_exactly(spark):
    """Quantities that were summed (28 digits) keep every place of the product."""
    from decimal import Decimal, localcontext

    from spendguard.functions import exact_product
    from spendguard.schemas import PRICE

    quantities = ["0.000010", "0.000001", "-0.000001", "-1234567.654321", "999.999999", "1000.000000", "123456789012345.678901", "-5000000000000000000.000001", None]
    prices = ["0.400000", "0.000001", "999999.999999", "-3.141592", "1.000000", None]
    pairs = [(None if q is None else Decimal(q), None if p is None else Decimal(p)) for q in quantities for p in prices]
    wide = T.DecimalType(28, 6)
    df = spark.createDataFrame(pairs, T.StructType([T.StructField("q", wide), T.StructField("p", PRICE)]))
    got = df.select("q", "p", exact_product(F.col("q"), wide, F.col("p"), PRICE).alias("cost"))
    assert got.schema["cost"].dataType == T.DecimalType(38, 12)
    rows = got.collect()
    with localcontext(prec=60):
        for r in rows:
            assert r.cost == (None if r.q is None or r.p is None else r.q * r.p), r


def test_amounts_with_trailing_zeros_are_cast_to_the_nearest_double(spark):
    """Also those of more places than are usual, at the ends of the type, and of types without room for a carry."""
    from spendguard.functions import with_double

    texts = ["0", "1234.5", "20987.520000", "-20987.520001", "0.000000000001", "0.1000005", "33333.333333333333", "4503599627.370497",
             "123456789012345678.123456", "9999999999999999999999999.999999999999", "-9999999999999999999999999.9999995", None]
    amounts = [None if x is None else Decimal(x) for x in texts]
    for kind in (T.DecimalType(37, 12), T.DecimalType(38, 12), T.DecimalType(31, 6)):
        fit = [x for x in amounts if x is None or -x.as_tuple().exponent <= kind.scale]
        fit = [x for x in fit if x is None or x.adjusted() < kind.precision - kind.scale]
        df = spark.createDataFrame(list(enumerate(fit)), T.StructType([T.StructField("n", T.LongType()), T.StructField("cost", kind)]))
        made = with_double(df, "cost")
        assert made.columns == ["n", "cost"]
        assert {r.n: r.cost for r in made.collect()} == {n: None if x is None else float(x) for n, x in enumerate(fit)}


def test_costs_are_cast_from_few_places(spark):
    """A cost that is the same with fewer places does not pass through its text."""
    from spendguard.registry import _flat_priced

    u, p = usage(spark, [("A", "7.25", dt.datetime(2026, 4, 11))]), prices(spark, STD_PRICES)
    flat = _flat_priced(price_usage(u, p))
    assert flat.first().line_cost == 21.75 and flat.schema["line_cost"].dataType == T.DoubleType()
    assert "decimal(32,6)" in flat._jdf.queryExecution().optimizedPlan().toString()


def _versions(spark, n, key="hot"):
    """One version after the other for an hour each, and one that is open."""
    start = dt.datetime(2024, 1, 1)
    rows = [(key, start + dt.timedelta(hours=k), start + dt.timedelta(hours=k + 1), k) for k in range(n)]
    return spark.createDataFrame(rows + [(key, start, None, -1), ("cold", start, None, -2)], "sku string, s timestamp, e timestamp, version int")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_indexed_versions_give_what_a_plain_join_gives(spark, kind, rows):
    import random

    rng = random.Random(7)
    day = dt.datetime(2023, 12, 20)
    versions = []
    for k in range(300):
        start = day + dt.timedelta(minutes=rng.randint(0, 60_000))
        length = rng.choice([None, dt.timedelta(0), dt.timedelta(seconds=1), dt.timedelta(minutes=7), dt.timedelta(days=3), dt.timedelta(days=900), -dt.timedelta(days=1)])
        versions.append((rng.choice(["hot", "hot", "warm", "cold", None]), start, None if length is None else start + length, k))
    facts = [(k, rng.choice(["hot", "warm", "cold", "none", None]), day + dt.timedelta(seconds=rng.randint(-10 ** 6, 5 * 10 ** 6)) if k % 50 else None) for k in range(600)]
    facts += [(1_000 + k, v[0], v[1]) for k, v in enumerate(versions)] + [(2_000 + k, v[0], v[2]) for k, v in enumerate(versions)]  # on the bounds
    v = spark.createDataFrame(versions, "sku string, s timestamp_ntz, e timestamp_ntz, version int").withColumns({c: F.col(c).cast(kind) for c in ("s", "e")})
    f = spark.createDataFrame(facts, "id int, sku string, t timestamp_ntz").withColumn("t", F.col("t").cast(kind))
    joined = [effective_dated_join(f, v, key="sku", at="t", start="s", end="e", max_broadcast_rows=rows, max_plain_versions=n) for n in (10 ** 6, 20)]
    plain, indexed = (sorted((r.id, r.version) for r in j.collect()) for j in joined)
    assert plain and plain == indexed and joined[0].columns == joined[1].columns


def test_candidates_do_not_grow_with_versions(spark):
    from spendguard.operators import range_join

    facts = spark.range(200).select(F.lit("hot").alias("sku"), F.timestamp_seconds(F.col("id") * 40_000 + 1_704_067_200).alias("t"), "id")
    most = []
    for n in (500, 5_000):
        v = _versions(spark, n).withColumnRenamed("sku", "v")
        many = v.groupBy("v").count().where(F.col("count") > 64).select(F.col("v").alias("_many"))
        f, w, agree = range_join._indexed(facts, v, many, "sku", "v", "t", "s", "e")
        tested = f.join(w, (F.col("sku") == F.col("v")) & agree).groupBy("id").count().agg(F.max("count")).first()[0]
        most.append(tested)
    assert most[0] == most[1] <= 8


def test_versions_of_a_bin_are_joined_by_runs(spark):
    """Each run holds neighbours in time, spans them, and no version is lost, also where many start at once."""
    from spendguard.operators import range_join

    day = dt.datetime(2024, 1, 1)
    rows = [("hot", 0, 0, day + dt.timedelta(hours=k % 130), None if k % 3 == 0 else day + dt.timedelta(hours=k % 130 + 2), k) for k in range(1_000)]
    rows += [("hot", 2, 5, day, day + dt.timedelta(hours=1), 1_000 + k) for k in range(130)]
    rows += [("cold", -1, 0, day, None, 2_000), (None, -1, 0, day, None, 2_001)]
    v = spark.createDataFrame(rows, "v string, _version_level int, _version_bin long, s timestamp, e timestamp, version int")
    runs = range_join._runs(v, ["v", "_version_level", "_version_bin"], "s", "e").collect()
    assert len(runs) == 16 + 3 + 1
    assert sorted(x.version for r in runs for x in r._run) == [*range(1_130), 2_000]
    for r in runs:
        assert len(r._run) <= range_join.RUN_VERSIONS
        assert r._first == min(x.s for x in r._run)
        assert r._last == (None if any(x.e is None for x in r._run) else max(x.e for x in r._run))
    spans = sorted((r._first, max(x.s for x in r._run)) for r in runs if r._version_level == 0)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_a_fact_meets_runs_not_versions(spark, rows):
    """The join itself gives one row a run; its versions are tested after it."""
    v = _versions(spark, 500).unionByName(_versions(spark, 500))
    f = spark.createDataFrame([("hot", dt.datetime(2024, 1, 1) + dt.timedelta(hours=k, minutes=30)) for k in range(20)] + [("cold", dt.datetime(2025, 1, 1))], "sku string, t timestamp")
    made = effective_dated_join(f, v, key="sku", at="t", start="s", end="e", max_broadcast_rows=rows)
    assert made.columns == ["sku", "t", "s", "e", "version"]
    assert sorted((r.sku, r.version) for r in made.collect()) == sorted([("hot", k) for k in range(20)] * 2 + [("hot", -1)] * 40 + [("cold", -2)] * 2)
    assert "inline(_run" in made._jdf.queryExecution().optimizedPlan().toString()


def test_usage_in_doubles_is_nearest_to_the_exact_amounts(spark):
    """By whole digits where they multiply without loss, and by the decimal product elsewhere."""
    from spendguard.plans import price_usage_in_doubles

    quantities = ["17", "0.25", "-0.1", "0", "123.456789", "0.000001", "-1234567.654321", "999999999999.999999", "-999999999999", "77"]
    amounts = ["901.01", "0", "-3.3", "0.000001", "1234.567891", "999999999999.999999", "999999999999", "-1000000000", "77"]
    at = dt.datetime(2026, 4, 11)
    u = usage(spark, [(f"{k}", q, at) for k in range(len(amounts)) for q in quantities])
    u = u.withColumn("usage_quantity", F.when(F.col("usage_quantity") != 77, F.col("usage_quantity")))
    p = prices(spark, [(f"{k}", dt.datetime(2026, 1, 1), None, a) for k, a in enumerate(amounts)])
    p = p.withColumn("pricing", F.when(F.col("pricing.effective_list.default") != 77, F.col("pricing")))
    made, exact = price_usage_in_doubles(u, p), price_usage(u, p)
    assert made.columns == exact.columns and all(made.schema[c].dataType == T.DoubleType() for c in ("usage_quantity", "unit_price", "line_cost"))
    want = [tuple(None if r[c] is None else float(r[c]) for c in ("usage_quantity", "unit_price", "line_cost")) for r in exact.collect()]
    got = [tuple(r[c] for c in ("usage_quantity", "unit_price", "line_cost")) for r in made.collect()]
    assert len(got) == len(quantities) * len(amounts) and sorted(map(repr, got)) == sorted(map(repr, want))


def test_usage_in_doubles_takes_other_types(spark):
    from spendguard.plans import price_usage_in_doubles

    u = usage(spark, [("A", "7.25", dt.datetime(2026, 4, 11))])
    for kind in ("double", "decimal(28,6)", "decimal(38,6)"):
        row = price_usage_in_doubles(u.withColumn("usage_quantity", F.col("usage_quantity").cast(kind)), prices(spark, STD_PRICES)).first()
        assert (row.usage_quantity, row.unit_price, row.line_cost) == (7.25, 3.0, 21.75)


def test_heavy_keys_are_counted_before_the_index(spark):
    """A key's share is that of its usage; rows made for the levels of the index do not count."""
    from unittest import mock

    from spendguard.operators import range_join

    v = _versions(spark, 500)
    f = spark.createDataFrame([("hot", dt.datetime(2024, 1, 2))] * 3 + [("cold", dt.datetime(2024, 1, 2))] * 3, "sku string, t timestamp")
    with mock.patch.object(range_join, "heavy_keys", wraps=range_join.heavy_keys) as counted:
        made = effective_dated_join(f, v, key="sku", at="t", start="s", end="e", max_broadcast_rows=0)
    assert counted.call_args.args[0].columns == ["sku", "t"]
    assert sorted(r.version for r in made.collect()) == [-2] * 3 + [-1] * 3 + [24] * 3


def test_versions_without_a_bin_are_spread_further(spark, monkeypatch):
    """For keys with many facts alone, and with the same rows; other versions are copied as before."""
    from spendguard.operators import range_join

    v = _versions(spark, 200)
    f = spark.range(400).select(F.lit("hot").alias("sku"), F.timestamp_seconds(F.col("id") * 1_800 + 1_704_067_200).alias("t"), "id")
    made = []
    for many in (401, 400):
        monkeypatch.setattr(range_join, "MANY_FACTS", many)
        joined = effective_dated_join(f, v, key="sku", at="t", start="s", end="e", max_broadcast_rows=0, salt_buckets=3)
        made.append((sorted((r.id, r.version) for r in joined.collect()), joined._jdf.queryExecution().optimizedPlan().toString()))
    assert made[0][0] == made[1][0] and len(made[0][0]) == 800
    assert ["THEN 48 ELSE 3" in plan for _, plan in made] == [False, True]
