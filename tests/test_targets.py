"""Target lists: ALL / blank means everything; items are split, stripped and normalised."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spendguard.functions import explode_target_lists, is_all_targets, normalize_id, parse_integer, parse_targets
from spendguard.operators import selection


def parsed(spark, raw):
    df = parse_targets(spark, raw)
    return None if df is None else {r.target_id for r in df.collect()}


@pytest.mark.parametrize("raw", ["aLL", "\tALL \n", "\n", None, "ALL\x0b"])
def test_all_and_blank_mean_everything(spark, raw):
    assert parsed(spark, raw) is None


def test_items_are_split_stripped_and_read_as_the_numbers_they_are(spark):
    """Every spelling of some numbers, among names that only look like numbers, in one list."""
    numbers = [7, 40, 123456, 98765432109876]
    spellings = [f(n) for n in numbers for f in (str, "{:.1f}".format, "{:e}".format, "  {}\t".format, "00{}".format, "+{}".format) if float(f(n)) == n]
    names = ["k-77-x1", "e5", "12e", "7f3a9c", "svc one", "1__5"]
    raw = " ,".join(spellings + names) + ",,"
    assert parsed(spark, raw) == {str(n) for n in numbers} | set(names)
    assert parsed(spark, 98765432109876) == parsed(spark, 98765432109876.0) == {"98765432109876"}


def test_comma_only_is_empty_not_all(spark):
    assert parsed(spark, ",") == set()


def test_all_among_items_is_literal(spark):
    assert parsed(spark, "ALL,1") == {"ALL", "1"}


@pytest.mark.parametrize("item, expected", [
    ("0410", "410"),          # leading zeros go
    ("-5.7", "-5"),           # truncation toward zero
    ("-0.5", "0"),
    ("+5", "5"),
    (".5", "0"),
    ("5.", "5"),
    ("1e3", "1000"),
    ("12345d", "12345d"),     # Spark's cast would read these as numbers: they must stay text
    ("8f", "8f"),
    ("0x1p3", "0x1p3"),
    ("nan", "nan"),
    ("inf", "inf"),
    ("1e400", "1e400"),       # infinite as a double
    ("9007199254740993", "9007199254740992"),  # beyond 2^53 precision is lost, as with a float
    ("8.99e18", "8990000000000000000"),
    ("9e18", "9000000000000000000"),
    ("1e19", "10000000000000000000"),
    ("-1e19", "-10000000000000000000"),
    ("12345678901234567890", "12345678901234567168"),
    ("1e23", "99999999999999991611392"),
    ("8.1e31", "81000000000000000203279728377856"),
    ("8.2e31", str(int(8.2e31))),
    ("1e37", str(int(1e37))),
    ("-1.5e60", str(int(-1.5e60))),
    ("1.7976931348623157e308", str(int(1.7976931348623157e308))),
    ("9223372036854775807", "9223372036854775808"),
    ("1_000", "1000"),
    ("1_0.5_0e1_0", "105000000000"),
    ("1__0", "1__0"), ("_1", "_1"), ("1_", "1_"), ("1_.0", "1_.0"), ("1._0", "1._0"), ("1e_5", "1e_5"),
    ("\u0664\u0662", "42"), ("\u0967_\u0968", "12"), ("\uff11\uff12.\uff15", "12"), ("\U0001d7cf\U0001d7ce", "10"),
    ("\u00b2", "\u00b2"),     # a digit, but not a decimal one
    ("\u2003 77 \u00a0", "77"),
    ("5\n", "5"),
    ("0" * 30_000 + "7", "7"),
    ("c1", "c1"),
])
def test_normalize_id(spark, item, expected):
    got = spark.createDataFrame([(item,)], "v string").select(normalize_id("v").alias("n")).first().n
    assert got == expected


def test_numbers_are_read_as_float_and_int_read_them(spark):
    """Random spellings, and random doubles of every size, against Python's own parsers."""
    import random

    rng = random.Random(3)
    digits = ["0123456789", "".join(chr(0x660 + k) for k in range(10)), "".join(chr(0x966 + k) for k in range(10)), "".join(chr(0xff10 + k) for k in range(10))]
    parts = ["_", "__", ".", "e", "E", "+", "-", " ", "\u3000", "\x1f", "x", "inf", "nan"]
    items = ["".join(rng.choice(rng.choice(digits)) if rng.random() < 0.7 else rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(3_000)]
    items += [repr(rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-5, 308)) for _ in range(400)]

    def number(v):
        try:
            return str(int(float(v)))
        except (ValueError, OverflowError):
            return v

    def integer(v):
        try:
            n = int(v)
        except ValueError:
            return None
        return n if -2 ** 63 <= n < 2 ** 63 else None

    df = spark.createDataFrame([(v,) for v in items], "v string").select("v", normalize_id("v").alias("n"), parse_integer("v").alias("i"))
    wrong = [(r.v, r.n, r.i) for r in df.collect() if (r.n, r.i) != (number(r.v), integer(r.v))]
    assert not wrong, wrong[:5]


def test_an_item_is_read_in_one_go(spark):
    """However often a step's result is used, the plan computes it once."""
    df = spark.createDataFrame([("1e300",)], "v string").select(normalize_id("v").alias("n"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert {step: plan.count(step) for step in ("translate(", "aggregate(", "try_cast")} == {"translate(": 1, "aggregate(": 1, "try_cast": 1}
    assert df.first().n == str(int(1e300))


def test_an_id_set_is_read_once(spark, tmp_path):
    """The lists behind a set are scanned for the check alone; what is joined is what was written."""
    spark.createDataFrame([("1, 2_0",), ("3.0",)], "raw string").write.parquet(str(tmp_path / "lists"))
    ids = explode_target_lists(spark.read.parquet(str(tmp_path / "lists"))).select("target_id", "all_targets")
    jobs = spark.range(30).withColumnRenamed("id", "job_id")
    for rows in (10, 0):
        kept = selection.only_targets(jobs, "job_id", ids, max_broadcast_rows=rows)
        assert "Scan parquet" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.job_id for r in kept.collect()) == [1, 3, 20]


def test_normalize_null_stays_null(spark):
    got = spark.createDataFrame([(None,)], "v string").select(normalize_id("v").alias("n")).first().n
    assert got is None


def test_explode_keeps_other_columns_and_flags_all_lists(spark):
    lists = spark.createDataFrame(
        [("JOB", " 1 , 2.0 ,"), ("JOB", "ALL"), ("CLUSTER", "c1,,c2"), ("APP", ","), ("APP", "\t"), ("APP", None)],
        "resource_type string, raw string")
    rows = sorted((tuple(r) for r in explode_target_lists(lists).collect()), key=str)
    assert rows == sorted([("CLUSTER", "c1", False), ("CLUSTER", "c2", False), ("JOB", "1", False), ("JOB", "2", False),
                           ("JOB", None, True), ("APP", None, True)], key=str)


def test_is_all_targets(spark):
    df = spark.createDataFrame([("ALL",), ("x",), ("",), (" all ",)], "raw string")
    assert [r.a for r in df.select(is_all_targets(F.col("raw")).alias("a")).collect()] == [True, False, True, True]


def test_id_set_with_all_targets_is_bounded_by_its_bytes(spark, monkeypatch):
    ids = spark.createDataFrame([("x" * 50, False), ("y" * 50, False), (None, False)], "target_id string, all_targets boolean")
    assert selection.check_ids(ids).broadcast
    monkeypatch.setattr(selection, "DEFAULT_MAX_BROADCAST_BYTES", 99, raising=False)
    assert not selection.check_ids(ids).broadcast
