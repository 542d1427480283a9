"""Perspective rotation of multi-party dialogues.

Every participant of a conversation gets the dialogue rendered with itself as the assistant and the
others as named users; the loss mask covers the assistant's own words and their closing mark. System
turns are shown to all and are nobody's perspective.

An opening mark inside a text or a name is escaped, so nobody's words read as a turn of someone else.

The result has one row per perspective and turn with the turn's rendered text and its place in the
whole rendering, so a conversation of any length is never gathered in one task. Places are prefix
sums in two levels: all rows are sorted into ranges of about equal size, lengths are summed by range,
the ranges' sums of a conversation are accumulated, and within a range the turns are accumulated from
there. A long conversation lies in many ranges, whatever its turns' numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import column, text_of

SYSTEM, UNKNOWN = "system", "unknown"
#: Marks of the rendering.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
ESCAPED = "<\\|"
#: Turns of one number and speaker are ordered by so many characters of text, and then by its hash.
TIE_CHARS = 64


def _escaped(text: Column) -> Column:
    return F.replace(text, F.lit(OPEN), F.lit(ESCAPED))


def _header(speaker: Column, perspective: Column) -> Column:
    name = (F.when(speaker == SYSTEM, F.lit(SYSTEM)).when(speaker == perspective, F.lit("assistant"))
            .otherwise(F.concat(F.lit("user name="), _escaped(speaker))))
    return F.concat(F.lit(OPEN), name, F.lit(CLOSE))


def rotate(turns: DataFrame, *, conversation_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """``conv_id``, ``perspective``, ``turn``, ``speaker``, ``rendered``, ``start`` and ``end``
    (code points of the whole rendering, end exclusive) and ``loss_start`` and ``loss_end`` (the
    part that is learned; null for others' turns).

    A null text is empty, a null speaker is called unknown, a null turn comes first. Turns of one
    number follow each other by speaker, by the first characters of the text and by the text's hash;
    repeated rows are repeated turns. A null conversation is a conversation of its own. One without a participant besides the system has no
    rows. Other columns are ignored, and an empty table has no rows.
    """
    checkpoint_dir(turns.sparkSession)
    rows = turns.select(
        column(conversation_col).alias("_c"), column(turn_col).alias("_t"),
        F.coalesce(column(speaker_col).cast("string"), F.lit(UNKNOWN)).alias("_s"), text_of(text_col).alias("_x"))
    people = rows.where(F.col("_s") != SYSTEM).select(F.col("_c").alias("_pc"), F.col("_s").alias("_p")).distinct()
    seen = rows.join(people, F.col("_c").eqNullSafe(F.col("_pc"))).drop("_pc")
    header = _header(F.col("_s"), F.col("_p"))
    order = ["_t", "_s", "_k", "_y", "_z"]
    seen = (seen.withColumn("_h", F.char_length(header)).withColumn("_r", F.concat(header, _escaped(F.col("_x")), F.lit(END)))
            .withColumn("_n", F.char_length("_r").cast("long"))
            .withColumns({"_k": F.substring("_x", 1, TIE_CHARS), "_y": F.sha2(F.col("_x").cast("binary"), 256), "_z": F.monotonically_increasing_id()}).drop("_x"))
    # written, so that both uses of the ranges see the same ones
    seen = seen.repartitionByRange("_c", "_p", *order).withColumn("_b", F.spark_partition_id()).checkpoint()
    sums = seen.groupBy("_c", "_p", "_b").agg(F.sum("_n").alias("_sum"))
    earlier = Window.partitionBy("_c", "_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("_c").alias("_bc"), F.col("_p").alias("_bp"), F.col("_b").alias("_bb"),
                        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    placed = seen.join(bases, F.col("_c").eqNullSafe(F.col("_bc")) & (F.col("_p") == F.col("_bp")) & (F.col("_b") == F.col("_bb")))
    within = Window.partitionBy("_c", "_p", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("_base") + F.sum("_n").over(within)
    mine = F.col("_s") == F.col("_p")
    return (placed.withColumn("_end", end)
            .select(F.col("_c").alias("conv_id"), F.col("_p").alias("perspective"), F.col("_t").alias("turn"), F.col("_s").alias("speaker"),
                    F.col("_r").alias("rendered"), (F.col("_end") - F.col("_n")).alias("start"), F.col("_end").alias("end"),
                    F.when(mine, F.col("_end") - F.col("_n") + F.col("_h")).alias("loss_start"), F.when(mine, F.col("_end")).alias("loss_end")))


#: The same over the table ``conversations`` in DuckDB.
SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '{UNKNOWN}') AS speaker, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'),
seen AS (
  SELECT t.conv_id, perspective, turn, speaker, text,
    '{OPEN}' || CASE WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || replace(speaker, '{OPEN}', '{ESCAPED}') END || '|>' || chr(10) AS header
  FROM t JOIN people ON t.conv_id IS NOT DISTINCT FROM people.conv_id),
shown AS (SELECT *, header || replace(text, '{OPEN}', '{ESCAPED}') || '<|end|>' || chr(10) AS rendered FROM seen),
placed AS (
  SELECT *, CAST(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, left(text, {TIE_CHARS}), sha256(text)
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stop FROM shown)
SELECT conv_id, perspective, turn, speaker, rendered, stop - length(rendered) AS start, stop AS "end",
  CASE WHEN speaker = perspective THEN stop - length(rendered) + length(header) END AS loss_start,
  CASE WHEN speaker = perspective THEN stop END AS loss_end
FROM placed
"""
