"""Quality rules: repetition within a text, and lines that many documents of one host share.

Base rules look at one text: its words and symbols, lines that repeat an earlier line, and words in
windows of three words that the text holds more than once.

The cross-document rule hashes every normalised line, counts the distinct documents of each host that
hold it, and removes the lines above both limits: a number of documents, and a share of the host's
documents. The document of the smallest id in which a host has the line keeps it, so that no line goes
altogether. A document that loses more than a share of its characters is depleted and is rejected.

Only DataFrame functions are used. The texts are read once; what later steps need of them (the
counts and a hash and a size per line) is written to the checkpoint folder. Lines are counted as
(line, document) pairs first and as lines afterwards, so a line of a third of all documents meets in
one task as partial counts alone. The lines above the limits are broadcast if they are counted to be
few and are joined by a shuffle otherwise, and a document's removed characters are added up before they
are shuffled by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import column, text_of

#: A line goes if it stands in more documents of a host than this, and in more than this share of them.
MAX_DOCUMENTS, MAX_SHARE = 5, 0.01
#: A document is depleted if the lines that go hold more than this share of its characters, white space not counted.
MAX_REMOVED = 0.5
#: The base rules: least number of words, and the largest percentage of repeated ones.
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Lines above the limits that may be broadcast (two longs each).
BROADCAST_LINES = 1_000_000
WINDOW = 3
#: Repeated hashes of a text that are looked for one by one.
FEW_HASHES = 16

_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = "[#*$%&|<>]"


def _without_gaps(text: Column, by: str, gaps: str) -> Column:
    """``text`` with each of the characters ``gaps`` replaced; a byte search, not a pattern."""
    for gap in gaps:
        text = F.replace(text, F.lit(gap), F.lit(by))
    return text


def words_of(text: Column) -> Column:
    """The words of a text in order."""
    return F.filter(F.split(_without_gaps(text, " ", _WHITE[1:]), " "), lambda w: w != "")


def normalised_lines(text: Column) -> Column:
    """The lines of a text that hold a word: lower case, without white space, and 0 for each run of
    digits."""
    plain = F.regexp_replace(_without_gaps(F.lower(text), "", _WHITE.replace("\n", "")), "[0-9]+", "0")
    return F.filter(F.split(plain, "\n"), lambda line: line != "")


def base_counts(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and
    ``n_repeat_words`` of column ``text``.

    Windows are compared by hashes. The hashes that a text holds more than once are found in its
    sorted hashes; few of them are looked for in the text as they are, and for many of them the
    (hash, place) pairs are sorted, so the work of n words grows as n log n however often a
    text repeats itself. Texts without a repeated hash, which are most, end there.
    """
    keep, t = rows.columns, F.col(text)
    lines = F.filter(F.split(t, "\n"), lambda line: F.trim(line, F.lit(_WHITE)) != "")
    rows = rows.withColumn("_words", words_of(t)).withColumn("_lines", lines)
    w = F.col("_words")
    rows = rows.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(w, lambda x: F.xxhash64(x)).alias("_each"))
    base = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    h, e = F.col("_hashes"), F.col("_each")
    # the words' hashes are a column of their own: what a lambda refers to is not computed for each element
    rows = rows.select(*base, F.transform(F.slice(e, 1, F.greatest(F.size(e) - (WINDOW - 1), F.lit(0))),
                                          lambda x, i: F.xxhash64(x, *(F.get(e, i + k) for k in range(1, WINDOW)))).alias("_hashes"))
    longs, pairs = F.array().cast("array<bigint>"), F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.select(*base, "_hashes", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)).otherwise(longs).alias("_in_order"))
    o = F.col("_in_order")
    rows = rows.select(*base, "_hashes", F.array_distinct(F.filter(o, lambda x, i: x == F.get(o, i + 1))).alias("_twice"))
    twice = F.col("_twice")
    rows = rows.select(*base, "_hashes", "_twice", F.when(F.size(twice) > FEW_HASHES, F.sort_array(
        F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(pairs).alias("_sorted"))
    s = F.col("_sorted")

    def repeated(x: Column, i: Column) -> Column:
        def like(at: Column) -> Column:
            return F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))
        return like(i - 1) | like(i + 1)

    in_sorted = F.sort_array(F.transform(F.filter(s, repeated), lambda x: x["i"]))
    in_place = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())
    places = F.when(F.size(s) > 0, in_sorted).otherwise(in_place)
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("words"))
    covered = F.aggregate(places, start, lambda seen, at: F.struct(
        at.alias("last"), (seen["words"] + F.least(F.lit(WINDOW), at - seen["last"])).alias("words")), lambda seen: seen["words"])
    return rows.select(*base, F.when(F.size(twice) > 0, covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


def line_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
               max_documents: int = MAX_DOCUMENTS, max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED,
               broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``kept``, and what the cross-document rule
    found: ``n_removed_lines`` and ``n_removed_chars``.

    A null or empty text has no words and fails the base rules. Rows that share an id are one
    document in the counts and keep a row each, a repeated row as often as it stands there; a row
    without an id is a document of its own, behind those with one. A null host is a host of its own.
    A text of any length is one row, whose lines and windows are arrays in one task. Of documents that
    tie for a line the smallest id keeps it, in all of its rows. Ids are compared as what they are.
    Other columns, whatever their names, are ignored; an empty table has no rows.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    rows = docs.select(column(id_col).alias("_id"), F.xxhash64(F.lit("host"), column(host_col).cast("string")).alias("_host"),
                       text_of(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    lines = F.transform(normalised_lines(F.col("_text")), lambda x: F.struct(
        F.xxhash64(F.col("_host"), x).alias("key"), F.char_length(x).alias("chars")))
    read = base_counts(rows.withColumn("_keys", lines), "_text").drop("_text").checkpoint()

    # a document without an id is told from others by its row
    who = F.struct(F.col("_id").isNull().alias("unnamed"), F.col("_id").alias("id"), F.when(F.col("_id").isNull(), F.col("_row")).alias("row"))
    named = read.withColumn("_who", who)
    of_line = (named.select("_host", "_who", F.explode(F.array_distinct(F.transform("_keys", lambda x: x["key"]))).alias("key"))
               .groupBy("key", "_who").agg(F.min("_host").alias("_host"))
               .groupBy("key").agg(F.count("*").alias("documents"), F.min("_who").alias("first"), F.min("_host").alias("_host"))
               .where(F.col("documents") > max_documents))
    of_host = (named.select("_host", "_who").distinct().groupBy("_host").agg(F.count("*").alias("all")))
    above = (of_line.join(of_host, "_host").where(F.col("documents") > max_share * F.col("all"))
             .select("key", "first").checkpoint())
    few = above.count() <= broadcast_lines
    gone = (named.select("_row", "_who", F.inline("_keys")).join(F.broadcast(above) if few else above.hint("merge"), "key")
            .where(~F.col("_who").eqNullSafe(F.col("first")))
            .groupBy("_row").agg(F.count("*").alias("n_removed_lines"), F.sum("chars").cast("long").alias("n_removed_chars")))
    out = read.join(gone, "_row", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_removed_lines", "n_removed_chars")})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    depleted = F.col("n_removed_chars") > max_removed * F.col("word_chars")
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_removed_lines", "n_removed_chars")


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: The same rows in DuckDB, with the default limits.
SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS word
  FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs)
),
windows AS (
  SELECT r, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
),
often AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows WHERE c IS NOT NULL),
repeated AS (
  SELECT r, count(DISTINCT place) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM often WHERE n > 1) GROUP BY r
),
sizes AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY r),
raw_lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE trim(line, {_SPACE}) <> '' GROUP BY r
),
lines AS (
  SELECT * FROM (SELECT r, doc_id, source, unnest(string_split(regexp_replace(regexp_replace(lower(text), '[\x09\x0B-\x0D\x20]', '', 'g'),
                 '[0-9]+', '0', 'g'), chr(10))) AS line FROM docs)
  WHERE line <> ''
),
hosts AS (SELECT source, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'row ' || CAST(r AS VARCHAR))) AS everything FROM docs GROUP BY source),
above AS (
  SELECT l.source, l.line, min(doc_id) AS first_id, min(r) FILTER (WHERE doc_id IS NULL) AS first_row
  FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, l.line, h.everything
  HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'row ' || CAST(r AS VARCHAR))) > greatest({MAX_DOCUMENTS}, {MAX_SHARE} * h.everything)
),
gone AS (
  SELECT l.r, count(*) AS n_removed_lines, sum(length(l.line)) AS n_removed_chars
  FROM lines l JOIN above a ON l.source IS NOT DISTINCT FROM a.source AND l.line = a.line
  WHERE NOT coalesce(CASE WHEN a.first_id IS NULL THEN l.r = a.first_row ELSE l.doc_id = a.first_id END, FALSE)
  GROUP BY l.r
),
counted AS (
  SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, CAST(coalesce(s.word_chars, 0) AS BIGINT) AS word_chars,
         CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(w.n_repeat_words, 0) AS n_repeat_words,
         coalesce(g.n_removed_lines, 0) AS n_removed_lines, CAST(coalesce(g.n_removed_chars, 0) AS BIGINT) AS n_removed_chars
  FROM docs d LEFT JOIN sizes s USING (r) LEFT JOIN raw_lines l USING (r) LEFT JOIN repeated w USING (r) LEFT JOIN gone g USING (r)
),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_removed_chars <= {MAX_REMOVED} * word_chars AS kept, n_removed_lines, n_removed_chars
FROM judged"""
