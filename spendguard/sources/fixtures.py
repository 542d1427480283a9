"""Inputs in the shapes the plans expect, derived from the generated TPC-H-style tables, so every
registered query reads whole tables and its work grows with them.

| input        | from      | rule                                                                   |
|--------------|-----------|------------------------------------------------------------------------|
| usage        | lineitem  | SKU = partkey div 4; quantity; end = shipdate + (orderkey % 24) hours  |
| list_prices  | part      | version = partkey % 4, 600 days each, the last one open-ended; empty   |
|              |           | validity when partkey % 7 = 0 (gaps); price = retail price             |
| jobs         | orders    | kind by priority digit, pause status by order status, no settings when |
|              |           | orderkey % 97 = 0, placeholder cron when orderkey % 10 = 3             |
| runs         | events    | active when event type is view or click                                |
| clusters     | customer  | state by market segment                                                |
| warehouses   | supplier  | state by nation key % 4                                                |
| apps         | part      | one app per part                                                       |
| audit        | orders    | type by orderkey % 5, with unparseable and missing job ids             |
| target_lists | orders,   | raw target text per type, in the formats a config loader produces      |
|              | customer, |                                                                        |
|              | supplier, |                                                                        |
|              | part      |                                                                        |
| outcomes     | all four  | whether each stop call succeeded                                       |

Every source row gives a row: the modulo rules assign attributes (kind, state, type, id format). Where
usage must find no price, the price's validity is empty; where a list must target nothing, it
holds commas or ids that do not exist.

The DuckDB oracle derives the same tables independently (flat) in ``spendguard.oracle``.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendguard.schemas import (
    ACTED_BY,
    ACTION_STOPPED,
    APP,
    CLUSTER,
    JOB,
    MONTH_FORMAT,
    PLACEHOLDER_CRON,
    PLACEHOLDER_TIMEZONE,
    PRICE,
    QUANTITY,
    WAREHOUSE,
)

# Parameters of the fixture scenario.
AS_OF = _dt.date(1998, 6, 15)
NOW = _dt.datetime(1998, 6, 15, 12, 0, 0)
THRESHOLD = 50000
EXEMPT_JOBS = ("100", "300")
OWN_CLUSTER = "0410-000001-abc"
PRICE_EPOCH = "1995-01-01 00:00:00"
VERSION_DAYS = 600
# The type of the lists that hold edge cases.
EDGE = "EDGE"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


def sku_of(partkey: Column) -> Column:
    return F.concat(F.lit("SKU-"), _text(F.floor(partkey / F.lit(4))))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_from_lineitem(_read(spark, sf_dir, "lineitem"))


def usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same usage rows as a file stream over the lineitem files (for incremental runs)."""
    return usage_from_lineitem(_lineitem_stream(spark, sf_dir))


def _lineitem_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _read(spark, sf_dir, "lineitem").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/lineitem*.parquet")


def _millionths(n: Column) -> Column:
    """0.000000 to 0.999999, from a whole number."""
    return (n % 1_000_000).cast(QUANTITY) * F.lit(Decimal("0.000001"))


def fractional_usage(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Usage whose quantities use all six decimal places."""
    li = _lineitem_stream(spark, sf_dir) if stream else _read(spark, sf_dir, "lineitem")
    quantity = F.col("l_quantity").cast(QUANTITY) + _millionths(F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104_729).cast(QUANTITY)
    return usage_from_lineitem(li.withColumn("l_quantity", quantity.cast(QUANTITY)))


def fractional_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price list with prices that use all six decimal places."""
    price = F.col("p_retailprice").cast(PRICE) + _millionths(F.col("p_partkey") * 15_485_863).cast(PRICE)
    return prices_from_part(_read(spark, sf_dir, "part").withColumn("p_retailprice", price.cast(PRICE)))


HOT_SKU = "SKU-HOT"
# Days over which the versions of the hot SKU start, and how long those of each kind hold.
HOT_DAYS, HOT_LONG_DAYS, HOT_KINDS = 2_600, 400, 500


def hot_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of which about a third is of one SKU."""
    return usage(spark, sf_dir).withColumn("sku_name", F.when(F.crc32(F.col("sku_name").cast("binary")) % 3 == 0, F.lit(HOT_SKU)).otherwise(F.col("sku_name")))


def hot_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price list, and one SKU with a version for every part: most hold for a day, some for long,
    and some are in force until further notice."""
    part = _read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    start = F.lit(PRICE_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(days=(key * 37 % HOT_DAYS).cast("int"), hours=(key % 24).cast("int"))
    days = F.when(key % HOT_KINDS == 1, HOT_LONG_DAYS).otherwise(1)
    hot = part.select(F.lit(HOT_SKU).alias("sku_name"), start.alias("price_start_time"),
                      F.when(key % HOT_KINDS != 0, start + F.make_dt_interval(days=days)).alias("price_end_time"),
                      F.struct(F.struct(F.col("p_retailprice").cast(PRICE).alias("default")).alias("effective_list")).alias("pricing"))
    return list_prices(spark, sf_dir).unionByName(hot)


def _since_as_of() -> Column:
    """Days from the scenario's date to the session's own."""
    return F.datediff(F.current_date(), F.lit(AS_OF))


def usage_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage, moved so that the scenario's date is the session's own."""
    days = F.make_dt_interval(days=_since_as_of())
    return usage(spark, sf_dir).withColumns({"usage_end_time": F.col("usage_end_time") + days, "usage_date": F.date_add("usage_date", _since_as_of())})


def prices_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.make_dt_interval(days=_since_as_of())
    return list_prices(spark, sf_dir).withColumns({c: F.col(c) + days for c in ("price_start_time", "price_end_time")})


def audit_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit rows of the current and earlier months, moved alike; the month from the moved date."""
    moved = F.col("timestamp") + F.make_dt_interval(days=_since_as_of())
    return audit(spark, sf_dir).withColumn("timestamp", moved).withColumn("month", F.date_format("timestamp", MONTH_FORMAT))


def usage_from_lineitem(li: DataFrame) -> DataFrame:
    return li.select(
        sku_of(F.col("l_partkey")).alias("sku_name"),
        F.col("l_quantity").cast(QUANTITY).alias("usage_quantity"),
        (F.col("l_shipdate") + F.make_dt_interval(hours=(F.col("l_orderkey") % 24).cast("int"))).alias("usage_end_time"),
        F.to_date("l_shipdate").alias("usage_date"),
    )


def list_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices_from_part(_read(spark, sf_dir, "part"))


def prices_from_part(part: DataFrame) -> DataFrame:
    version = (F.col("p_partkey") % 4).cast("int")
    start = F.lit(PRICE_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(days=version * VERSION_DAYS)
    end = F.when(version != 3, F.lit(PRICE_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(days=(version + 1) * VERSION_DAYS))
    return part.select(
        sku_of(F.col("p_partkey")).alias("sku_name"),
        start.alias("price_start_time"),
        F.when(F.col("p_partkey") % 7 == 0, start).otherwise(end).alias("price_end_time"),
        F.struct(F.struct(F.col("p_retailprice").cast(PRICE).alias("default")).alias("effective_list")).alias("pricing"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    digit = F.substring("o_orderpriority", 1, 1)
    status = F.when(F.col("o_orderstatus") == "F", "PAUSED").when(F.col("o_orderstatus") == "O", "UNPAUSED")
    placeholder = key % 10 == 3
    cron = F.when(placeholder, F.lit(PLACEHOLDER_CRON)).otherwise(
        F.concat(F.lit("0 0 "), _text(key % 24), F.lit(" * * ?")))
    tz = (F.when(placeholder, F.lit(PLACEHOLDER_TIMEZONE))
          .when(cust % 3 == 0, "UTC").when(cust % 3 == 1, "America/New_York").otherwise("Asia/Tokyo"))
    even = cust % 2 == 0
    file_arrival = F.when(even, F.concat(F.lit('{"url": "/landing/c'), _text(cust), F.lit('/"}')))
    table_update = F.when(~even, F.concat(F.lit('{"table_names": ["sales.t'), _text(cust), F.lit('"]}')))
    schedule = F.when(digit.isin("2", "5"), F.struct(cron.alias("quartz_cron_expression"), tz.alias("timezone_id"),
                                                     status.alias("pause_status")))
    continuous = F.when(digit == "1", F.struct(status.alias("pause_status")))
    # Priority 5 has a schedule and a trigger: the schedule wins.
    trigger = F.when(digit.isin("3", "5"), F.struct(file_arrival.alias("file_arrival"),
                                                     table_update.alias("table_update"),
                                                     status.alias("pause_status")))
    settings = F.when(key % 97 != 0, F.struct(
        F.concat(F.lit("job-"), _text(key)).alias("name"),
        schedule.alias("schedule"), continuous.alias("continuous"), trigger.alias("trigger")))
    return o.select(key.alias("job_id"), settings.alias("settings"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("job_id"),
                    F.col("event_type").isin("view", "click").alias("active"))


def cluster_id_of(custkey: Column) -> Column:
    return F.concat(F.lit("0410-"), F.format_string("%06d", custkey), F.lit("-abc"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    state = (F.when(seg == "BUILDING", "RUNNING").when(seg == "AUTOMOBILE", "RESIZING")
             .when(seg == "MACHINERY", "PENDING").when(seg == "HOUSEHOLD", "TERMINATED")
             .when(seg == "FURNITURE", "TERMINATING"))
    return c.select(cluster_id_of(F.col("c_custkey")).alias("cluster_id"), F.col("c_name").alias("cluster_name"),
                    state.alias("state"))


def warehouse_id_of(suppkey: Column) -> Column:
    return F.concat(F.lit("wh"), _text(suppkey))


def warehouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    n = F.col("s_nationkey") % 4
    state = F.when(n == 0, "RUNNING").when(n == 1, "STARTING").when(n == 2, "STOPPED").otherwise("STOPPING")
    return s.select(warehouse_id_of(F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"),
                    state.alias("state"))


def app_name_of(name: Column, partkey: Column) -> Column:
    return F.concat(F.regexp_replace(name, " ", "-"), F.lit("-"), _text(partkey))


def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select(app_name_of(F.col("p_name"), F.col("p_partkey")).alias("name"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    r = key % 5
    rtype = (F.when(r == 0, JOB).when(r == 1, CLUSTER).when(r == 2, WAREHOUSE).when(r == 3, APP)
             .otherwise("OTHER"))
    rid = (F.when(key % 35 == 0, F.concat(F.lit("bad-"), _text(key)))
           .when(r == 0, _text(cust * 11))
           .otherwise(F.concat(F.lit("r"), _text(cust))))
    # Kept as the wall-clock (TIMESTAMP_NTZ) value it is in the source, so the rows read the same
    # whatever the session time zone; the plans only carry this column along.
    ts = F.col("o_orderdate")
    return o.select(
        rtype.alias("resource_type"),
        F.lit(ACTION_STOPPED).alias("action"),
        rid.alias("resource_id"),
        F.concat(F.lit("n"), _text(cust)).alias("resource_name"),
        ts.alias("timestamp"),
        F.lit(ACTED_BY).alias("acted_by"),
        F.date_format(F.col("o_orderdate"), MONTH_FORMAT).alias("month"),
    )


def _scientific(key: Column) -> Column:
    """Integer text in the scientific notation a YAML loader may produce: 12345 -> 1.2345e+4."""
    s = _text(key)
    return F.when(F.length(s) > 1, F.concat(F.substring(s, 1, 1), F.lit("."), F.substr(s, F.lit(2)),
                                            F.lit("e+"), _text(F.length(s) - 1))
                  ).otherwise(F.concat(s, F.lit("e+0")))


def target_lists(spark: SparkSession, sf_dir: str, resource_type: str | None = None) -> DataFrame:
    """``(resource_type, raw)``: raw target text per resource type, one list per source row.
    With ``resource_type`` only that type's lists are built (from its one source table)."""
    builders = {JOB: _job_target_lists, CLUSTER: _cluster_target_lists, WAREHOUSE: _warehouse_target_lists,
                APP: _app_target_lists, EDGE: _edge_target_lists}
    kinds = [resource_type] if resource_type is not None else list(builders)
    frames = [builders[k](spark, sf_dir).select(F.lit(k).alias("resource_type"), F.col("raw")) for k in kinds]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _job_target_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early orders name their job in one of several spellings; of the later ones some lists hold
    nothing but commas and the others an id that no job has."""
    o = _read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    k = _text(key)
    m = key % 4
    named = (F.when(m == 0, F.concat(k, F.lit(", "), _text(key + 1)))
             .when(m == 1, F.concat(F.lit(" "), k, F.lit(".0 ,")))
             .when(m == 2, F.concat(_scientific(key), F.lit(",job-"), k))
             .otherwise(F.concat(F.lit("0"), k, F.lit(",,"))))
    other = F.when(m == 0, F.lit(",")).when(m == 1, F.lit(" , ,")).otherwise(F.concat(F.lit("none-"), k))
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return o.select(F.when(early, named).otherwise(other).alias("raw"))


def _cluster_target_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.concat(F.lit(" "), cluster_id_of(F.col("c_custkey")), F.lit(" ,"))
    return _read(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") < 5, named).otherwise(F.lit(",,")).alias("raw"))


def _warehouse_target_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = warehouse_id_of(F.col("s_suppkey"))
    return _read(spark, sf_dir, "supplier").select(
        F.when(F.col("s_nationkey") < 12, own).otherwise(F.concat(F.lit("gone-"), own)).alias("raw"))


def _app_target_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = app_name_of(F.col("p_name"), F.col("p_partkey"))
    return _read(spark, sf_dir, "part").select(F.when(F.col("p_size") <= 10, own).otherwise(F.concat(own, F.lit("-old"))).alias("raw"))


# How target text can look at its edges; every supplier has one of them.
EDGE_LISTS = ("ALL", " all ", "", " \t", ",", "ALL,1", "0x1f,8f,12345d", "nan,inf,-Infinity", "1e19, 12345678901234567890", "-9.9e18,-0.5,+7.",
              "9007199254740993,9.5e18", "1e400,.5,1e-400", "0410-000001-abc, 0007")


def _edge_target_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, EDGE_LISTS)), (F.col("s_suppkey") % len(EDGE_LISTS) + 1).cast("int"))
    return _read(spark, sf_dir, "supplier").select(raw.alias("raw"))


# Spellings of a whole number (#), with its digits in several scripts, and of numbers beyond a long;
# the lists of the last row are no numbers.
ARABIC, DEVANAGARI, WIDE = "٠١٢٣٤٥٦٧٨٩", "०१२३४५६७८९", "０１２３４５６７８９"
NUMBER_FORMS = ("#", "1_0#", "#_000.5_0", " \u3000#\u00a0", "+00#", "-#.99", "#e1_0", "#e20", "-#E+30", "#e37", "1.#e300", "#e303", "9.#e-5", ".5#",
                "#e310", "#__0", "_#", "#_", "#_.0", "#._0", "#e_1", "0x#", "#f", "inf#", "1.7976931348623157e308", "9223372036854775807", "9223372036854775808")


def number_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item``: every part key in one of many spellings."""
    key = _text(F.col("p_partkey"))
    script = F.col("p_partkey") % 4
    digits = (F.when(script == 1, F.translate(key, "0123456789", ARABIC)).when(script == 2, F.translate(key, "0123456789", DEVANAGARI))
              .when(script == 3, F.translate(key, "0123456789", WIDE)).otherwise(key))
    form = F.element_at(F.array(*map(F.lit, NUMBER_FORMS)), (F.col("p_partkey") % len(NUMBER_FORMS) + 1).cast("int"))
    return _read(spark, sf_dir, "part").select(F.replace(form, F.lit("#"), digits).alias("item"))


# Spellings of a job id in the audit table; the last four are no integers.
JOB_ID_FORMS = ("#", "+#", "0#", "\u00a0#\u2003", "wide", "arabic", "1_#", "#.0", "#__1", "#e0", "_#")


def spelled_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit rows with all ids those of jobs, in one of many spellings."""
    o = _read(spark, sf_dir, "orders")
    key = _text(F.col("o_orderkey"))
    form = F.element_at(F.array(*map(F.lit, JOB_ID_FORMS)), (F.col("o_custkey") % len(JOB_ID_FORMS) + 1).cast("int"))
    spelled = (F.when(form == "wide", F.translate(key, "0123456789", WIDE)).when(form == "arabic", F.translate(key, "0123456789", ARABIC))
               .otherwise(F.replace(form, F.lit("#"), key)))
    return o.select(F.lit(JOB).alias("resource_type"), F.lit(ACTION_STOPPED).alias("action"), spelled.alias("resource_id"),
                    F.concat(F.lit("n"), key).alias("resource_name"), F.col("o_orderdate").alias("timestamp"), F.lit(ACTED_BY).alias("acted_by"),
                    F.date_format("o_orderdate", MONTH_FORMAT).alias("month"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(resource_type, resource_id, ok)``: whether the stop call for a resource succeeded."""
    o = _read(spark, sf_dir, "orders").select(
        F.lit(JOB).alias("resource_type"), _text(F.col("o_orderkey")).alias("resource_id"),
        (F.col("o_totalprice") >= 20000).alias("ok"))
    c = _read(spark, sf_dir, "customer").select(
        F.lit(CLUSTER).alias("resource_type"), cluster_id_of(F.col("c_custkey")).alias("resource_id"),
        (F.col("c_acctbal") >= 0).alias("ok"))
    s = _read(spark, sf_dir, "supplier").select(
        F.lit(WAREHOUSE).alias("resource_type"), warehouse_id_of(F.col("s_suppkey")).alias("resource_id"),
        (F.col("s_acctbal") >= 0).alias("ok"))
    p = _read(spark, sf_dir, "part").select(
        F.lit(APP).alias("resource_type"), app_name_of(F.col("p_name"), F.col("p_partkey")).alias("resource_id"),
        (F.col("p_size") <= 45).alias("ok"))
    return o.unionByName(c).unionByName(s).unionByName(p)
