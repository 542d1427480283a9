"""Effective-dated (temporal range) join: each fact row meets the version rows of its key whose
half-open validity ``[start, end)`` holds the fact's time; a NULL end means still in force.

Strategy:
* The versions side (a price list) is projected to the join columns and broadcast when
  counting it shows it is small. The facts (usage, the big side) are then never shuffled:
  each scan task probes a hash table on the key and checks the range as a residual.
* Beyond the bound both sides are shuffled (a sort-merge join, so Spark cannot fall back to a
  broadcast on a file-size estimate). The keys that hold a large share of the facts are counted
  first (there are at most ``2 * salt_buckets`` of them); only their facts are spread over
  ``salt_buckets`` sub-keys by a hash of their time (deterministic, so a retried task sees the
  same rows), and only their version rows are copied once per sub-key. AQE skew-join splitting
  stays on as a second line. (Keys of a million facts and more: 16 times as many sub-keys for the
  versions that have no bin in the index below.)
* Keys with very many versions are joined through an index over time in either strategy. A closed
  version belongs to the level whose bins are as wide as its validity or up to four times as wide, and
  so to at most two bins; a fact probes one bin on each level that its key uses. What a fact
  is tested against is then bounded by the versions in force around its time, not by the versions
  that the key has collected. Versions still in force are a list of their own, without a bin.
  The versions of a bin are joined by runs of neighbours in time: a fact meets a run as one row, is
  tested against the time that the run spans, and then against its versions one after the other.

Semantics match a plain inner join: facts with no version vanish, facts in two overlapping
versions appear twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendguard.operators.sizing import DEFAULT_MAX_BROADCAST_BYTES, DEFAULT_MAX_BROADCAST_ROWS, shuffle_side, text_bytes

DEFAULT_SALT_BUCKETS = 32
#: Versions of a key that each fact of the key is tested against without an index.
MAX_PLAIN_VERSIONS = 64
#: Keys with an index that may be broadcast with their levels, at most 20 numbers a key.
MAX_INDEXED_KEYS = 100_000
#: Bins of a level are four times as wide as those of the level below; the lowest are a second wide.
FANOUT_BITS, LEVELS = 2, 20
#: The level of versions without a bin: those of keys without an index, and those still in force.
NO_LEVEL = -1
#: Sub-keys for versions without a bin, which all facts of a key meet, for one for those in a bin, and
#: the facts of each heavy key from which on the copies are few beside the rows that the join gives.
UNBINNED_SALTS, MANY_FACTS = 16, 1_000_000
#: Versions of a bin that are joined as one row.
RUN_VERSIONS = 64


def effective_dated_join(facts: DataFrame, versions: DataFrame, *, key: str, at: str, start: str, end: str,
                         max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                         salt_buckets: int = DEFAULT_SALT_BUCKETS,
                         max_plain_versions: int = MAX_PLAIN_VERSIONS) -> DataFrame:
    vkey = f"_version_{key}"
    v = versions.withColumnRenamed(key, vkey)
    in_range = (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    same = F.col(key) == F.col(vkey)
    # one pass over the versions: how many, how wide, and how many of one key
    sizes = v.groupBy(vkey).agg(F.count(F.lit(1)).alias("n"), F.sum(text_bytes(v)).alias("bytes"))
    found = sizes.agg(F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), F.max(F.when(F.col(vkey).isNotNull(), F.col("n"))).alias("most")).first()
    small = max_broadcast_rows > 0 and (found["rows"] or 0) <= max_broadcast_rows and (found["bytes"] or 0) <= DEFAULT_MAX_BROADCAST_BYTES
    kinds = {f.dataType for f in facts.schema.fields if f.name == at} | {f.dataType for f in v.schema.fields if f.name in (start, end)}
    buckets = max(1, int(salt_buckets))
    heavy = heavy_keys(facts, key, 1 / (2 * buckets)) if buckets > 1 and not small else {}
    indexed = False
    if (found["most"] or 0) > max_plain_versions and len(kinds) == 1:
        many = sizes.where(F.col("n") > max_plain_versions).select(F.col(vkey).alias("_many"))
        facts, v, bins = _indexed(facts, v, many, key, vkey, at, start, end)
        v = _runs(v, [vkey, "_version_level", "_version_bin"], start, end)
        same, indexed = same & bins, True
    near = (F.col(at) >= F.col("_first")) & (F.col("_last").isNull() | (F.col(at) < F.col("_last"))) if indexed else in_range
    more = buckets * UNBINNED_SALTS if indexed and heavy and min(heavy.values()) >= MANY_FACTS else buckets
    salts = [F.when(F.col(c) == NO_LEVEL, more).otherwise(buckets) if more > buckets else F.lit(buckets) for c in ("_level", "_version_level")]
    joined = _joined(facts, v, same & near, key, vkey, at, small, list(heavy), *salts)
    if not indexed:
        return joined
    joined = joined.drop("_level", "_bin", "_version_level", "_version_bin", "_first", "_last")
    return joined.select("*", F.inline("_run")).drop("_run").where(in_range)


def _joined(facts: DataFrame, v: DataFrame, cond: Column, key: str, vkey: str, at: str, small: bool, heavy: list, salts: Column, version_salts: Column) -> DataFrame:
    if small:
        return facts.join(F.broadcast(v), cond, "inner").drop(vkey)
    salted = facts.withColumn("_salt", F.when(F.col(key).isin(heavy), F.pmod(F.xxhash64(F.col(at)), salts).cast("int")).otherwise(0))
    copies = F.when(F.col(vkey).isin(heavy), F.sequence(F.lit(0), version_salts - 1)).otherwise(F.array(F.lit(0)))
    copied = shuffle_side(v.withColumn("_version_salt", F.explode(copies)))
    return salted.join(copied, cond & (F.col("_salt") == F.col("_version_salt")), "inner").drop(vkey, "_salt", "_version_salt")


def _seconds(c: Column, kind: T.DataType) -> Column:
    """Whole seconds of a time on a scale that never runs backwards within one type: instants as
    such, wall-clock times by their fields (a conversion to instants may swap them when clocks change)."""
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(c)
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400
    return days if isinstance(kind, T.DateType) else days + F.hour(c) * 3_600 + F.minute(c) * 60 + F.second(c)


def _bin(seconds: Column, level: Column) -> Column:
    return F.call_function("shiftright", seconds, (level * FANOUT_BITS).cast("int"))


def _indexed(facts: DataFrame, v: DataFrame, many: DataFrame, key: str, vkey: str, at: str, start: str, end: str) -> tuple[DataFrame, DataFrame, Column]:
    """Facts and versions with a level and a bin, and the condition that both agree."""
    kind = v.schema[start].dataType
    # at most one key of every ``max_plain_versions`` versions; they are counted before a broadcast
    keys = many.count()
    few = keys <= MAX_INDEXED_KEYS
    v = v.join(F.broadcast(many) if few else shuffle_side(many), F.col(vkey) == F.col("_many"), "left")
    low, high = _seconds(F.col(start), kind), _seconds(F.col(end), kind)
    binned = F.col("_many").isNotNull() & F.col(end).isNotNull()
    wide = F.greatest(high - low, F.lit(1).cast("long"))
    # the lowest level whose bins are as wide as the validity
    level = F.least(F.ceil(F.length(F.bin(wide - 1)) * F.when(wide > 1, 1).otherwise(0) / FANOUT_BITS), F.lit(LEVELS - 1)).cast("int")
    v = v.withColumn("_version_level", F.when(binned, level).otherwise(F.lit(NO_LEVEL)))
    bins = F.when(F.col("_version_level") >= 0, F.sequence(_bin(low, F.col("_version_level")), _bin(F.greatest(low, high), F.col("_version_level")))).otherwise(F.array(F.lit(0).cast("long")))
    # an empty validity holds no time
    v = v.where(F.col("_many").isNull() | F.col(end).isNull() | (F.col(start) < F.col(end)))
    v = v.withColumn("_version_bin", F.explode(bins))
    levels = v.where(F.col("_many").isNotNull()).groupBy(F.col("_many").alias("_indexed")).agg(F.collect_set("_version_level").alias("_levels"))
    # once a fact, not once a level
    facts = facts.withColumn("_seconds", _seconds(F.col(at), kind))
    if few:
        facts = facts.join(F.broadcast(levels), F.col(key) == F.col("_indexed"), "left").withColumn(
            "_level", F.explode(F.coalesce("_levels", F.array(F.lit(NO_LEVEL))))).drop("_indexed", "_levels")
    else:  # every level that any key uses: at most 21 numbers
        used = [r[0] for r in v.select("_version_level").distinct().collect()]
        facts = facts.withColumn("_level", F.explode(F.array(*map(F.lit, used))))
    facts = facts.withColumn("_bin", F.when(F.col("_level") >= 0, _bin(F.col("_seconds"), F.col("_level"))).otherwise(F.lit(0).cast("long"))).drop("_seconds")
    agree = (F.col("_level") == F.col("_version_level")) & (F.col("_bin") == F.col("_version_bin"))
    return facts, v.drop("_many"), agree


def _runs(v: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """The versions of each bin in the order of their start, ``RUN_VERSIONS`` a row, with the time that
    they span (no ``_last`` where one of them is in force). Versions without a key meet no fact."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(start)) - 1
    fields = F.struct(*[F.col(f"`{c}`") for c in v.columns if c not in by])
    numbered = v.where(F.col(by[0]).isNotNull()).withColumn("_run_number", F.floor(place / RUN_VERSIONS))
    return numbered.groupBy(*by, "_run_number").agg(
        F.collect_list(fields).alias("_run"), F.min(start).alias("_first"),
        F.when(F.count(end) == F.count(F.lit(1)), F.max(end)).alias("_last")).drop("_run_number")


def heavy_keys(rows: DataFrame, key: str, share: float) -> dict:
    """The keys that hold at least ``share`` of the rows, so at most ``1 / share`` of them, and their rows.
    Counted with a partial aggregate per task; a streaming side cannot be counted and has none."""
    if rows.isStreaming:
        return {}
    counts = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.sum("_rows").alias("_total")).select("_total").scalar()
    return {r["_key"]: r["_rows"] for r in counts.filter(F.col("_rows") >= total * share).collect()}
