"""I-Match fingerprints on several randomised lexicon subsets.

The lexicon holds the terms of a chosen band of inverse document frequency, counted over all
documents. Subsets of it are drawn once, by seeds, before any text is looked at: each holds a fixed
share of the lexicon, a half to 1/256. Of a text the distinct lexicon terms are kept and sorted, and
each subset gives one hash of those that it holds. The large subsets tell texts that differ in a few
terms; the small ones are what texts that share a part of their terms still have in common. Two
texts are as alike as the share of their subsets with a term whose hashes agree.

Only DataFrame functions are used. The lexicon is a single value, an array of buckets by the leading
bits of a term's hash, so membership is exact and takes one bucket of a few terms. A term of the band
stands in a minimum share of all documents, so the lexicon has at most (terms of an average document) /
(that share) terms, however many documents there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import column, text_of

#: Share of all documents that hold a lexicon term: at least, at most.
MIN_SHARE, MAX_SHARE = 1e-3, 2e-2
#: A seed's subset holds one of 2^k terms. More of the small ones: texts that share two thirds of a
#: hundred lexicon terms have little but those in common.
HALVINGS = (1, 2, 3, 4, 5, 5, 6, 6, 6, 7, 7, 7, 8, 8, 8, 8)
SEEDS = len(HALVINGS)
#: Bits of a term's hash that one seed uses; four seeds share a hash.
_FIELD = 16


def terms_of(text: Column) -> Column:
    """Hashes of the distinct lower-case words of a text; no order."""
    text = F.lower(text)
    for gap in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(gap), F.lit(" "))
    return F.array_distinct(F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon_of(docs: DataFrame, n: int, *, text_col: str, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> tuple[Column, int]:
    """The lexicon of ``docs``, of ``n`` rows: a scalar, an array of 2^bits buckets of terms, and bits."""
    terms = docs.select(F.explode(terms_of(text_of(text_col))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    lexicon = terms.where(F.col("df").between(n * min_share, n * max_share)).select("t").checkpoint()
    bits = max(1, lexicon.count().bit_length())
    buckets = lexicon.groupBy(_bucket(F.col("t"), bits).alias("at")).agg(F.collect_list("t").alias("terms"))
    # as many rows as the lexicon has terms, twice at most
    every = docs.sparkSession.range(1 << bits).join(buckets, F.col("id") == F.col("at"), "left").select("id", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "terms"))), lambda x: x["terms"]).alias("lexicon")).scalar(), bits


def _bucket(term: Column, bits: int) -> Column:
    return F.shiftrightunsigned(term, 64 - bits)


def in_subset(term: Column, seed: int) -> Column:
    """Whether a term belongs to the subset of a seed, which is so for one of 2^k terms."""
    mixed = F.shiftrightunsigned(F.xxhash64(F.lit(seed // 4), term), _FIELD * (seed % 4))
    return mixed.bitwiseAND(F.lit((1 << HALVINGS[seed]) - 1)) == 0


def _subset_hash(terms: Column, seed: int) -> Column:
    """Hash of the terms that the seed's subset holds; null if it holds none."""
    inside = F.filter(terms, lambda t: in_subset(t, seed))
    return F.when(F.exists(terms, lambda t: in_subset(t, seed)), F.xxhash64(F.lit(seed), inside))


def with_fingerprint(rows: DataFrame, text: str, out: str, lexicon: Column, bits: int) -> DataFrame:
    """``rows`` with the hashes of the seeds of column ``text`` as an array in ``out``: of its sorted
    distinct lexicon terms; of a text without any all of its terms, and of one without words its own
    hash. A subset without a term of the text has no hash; a text of which no subset holds a term has
    one hash of all the terms in their place."""
    # A subquery may not stand in a lambda; as a column that is used once it is put there by the
    # optimizer (CollapseProject), and no row ever carries the lexicon.
    before = rows.columns
    kept, every = f"_{out}_kept", f"_{out}_every"
    rows = rows.select("*", terms_of(F.col(text)).alias(every))  # used more than once, so a step of its own
    rows = rows.select("*", lexicon.alias("_lexicon")).select(
        *before, every, F.filter(every, lambda t: F.array_contains(F.get("_lexicon", _bucket(t, bits).cast("int")), t)).alias(kept))
    rows = rows.select(*before, F.array_sort(F.when(F.size(kept) > 0, F.col(kept)).when(F.size(every) > 0, F.col(every))
                                             .otherwise(F.array(F.xxhash64(F.lit("text"), F.col(text))))).alias(kept))
    hashes = F.array(*(_subset_hash(F.col(kept), s) for s in range(SEEDS)))
    rows = rows.select(*before, kept, hashes.alias(out))
    found = F.exists(out, lambda h: h.isNotNull())
    return rows.select(*before, F.when(found, F.col(out)).otherwise(F.array(F.xxhash64(F.lit("terms"), F.col(kept)))).alias(out))


def _shown(hashes: str) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.coalesce(F.lower(F.hex(h)), F.lit("0"))), "-")


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets with a term of either text whose hashes agree; 0 where there is no
    fingerprint to compare with, and 1 for equal ones."""
    def count(test) -> Column:
        return sum((F.coalesce(test(F.get(a, F.lit(s)), F.get(b, F.lit(s))), F.lit(False)).cast("int") for s in range(SEEDS)), F.lit(0))

    same, either = count(lambda x, y: x == y), count(lambda x, y: x.isNotNull() | y.isNotNull())
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(same / F.greatest(either, F.lit(1)))


def next_ids(ids: DataFrame) -> DataFrame:
    """``_id`` and ``_next`` for a table of distinct ``_id`` without nulls: the next smaller one, and the
    largest after the smallest. Ranges of ids are ordered on their own and then linked, so no task
    sees all of them; only one row of each range meets in one task."""
    ranged = ids.repartitionByRange(F.desc("_id")).withColumn("_range", F.spark_partition_id()).checkpoint()
    edges = ranged.groupBy("_range").agg(F.max("_id").alias("_first"))
    whole = Window.orderBy("_range")
    everything = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("_range", F.coalesce(F.lead("_first").over(whole), F.max("_first").over(everything)).alias("_after"))
    within = Window.partitionBy("_range").orderBy(F.desc("_id"))
    return (ranged.join(F.broadcast(edges), "_range")  # a row per partition
            .select("_id", F.coalesce(F.lead("_id").over(within), F.col("_after")).alias("_next")))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_chars``, ``edited`` fingerprint and text hash, and
    likeness to the edited and the next text.

    The edited text has its last third replaced by as much of the next document's start, in
    descending order of the ids (the first one's after the last). A null text is the empty text. Of
    rows that share an id the one with the smallest text is the next document of others. A row
    without an id is nobody's next; its last third is left out and it has no next to be like (0).
    Repeated rows stay repeated. A text of any length is one row, whose terms are an array in one
    task. Other columns are ignored; an empty table has no rows.
    """
    checkpoint_dir(docs.sparkSession)
    rows = docs.select(column(id_col).alias("_id"), text_of(text_col).alias("_text"))
    sizes = rows.groupBy("_id").agg(F.max(F.floor(F.char_length("_text") / 3)).alias("_need"), F.count("*").alias("_rows")).checkpoint()
    n = sizes.agg(F.sum("_rows")).first()[0] or 0
    lexicon, bits = lexicon_of(rows, n, text_col="_text")

    named = rows.where(F.col("_id").isNotNull())
    known = sizes.where(F.col("_id").isNotNull())
    order = next_ids(known.select("_id")).checkpoint()
    # what is asked of each document: as much of its start as the one before it in the order needs
    asked = order.join(known, "_id").select(F.col("_next").alias("_id"), F.col("_id").alias("_for"), "_need")
    starts = (named.join(asked.hint("merge"), "_id").groupBy("_id", "_for")
              .agg(F.min(F.substring("_text", F.lit(1), F.col("_need").cast("int"))).alias("_start"))
              .select(F.col("_for").alias("_id"), "_start", F.col("_id").alias("_next")))
    both = named.join(starts.hint("merge"), "_id")
    alone = rows.where(F.col("_id").isNull()).select("_id", "_text", F.lit("").alias("_start"), F.lit(None).cast(rows.schema["_id"].dataType).alias("_next"))

    def printed(part: DataFrame) -> DataFrame:
        cut = F.floor(F.col("_n") / 3).cast("int")
        part = part.withColumn("_n", F.char_length("_text"))
        part = part.withColumn("_edited", F.concat(F.substring("_text", F.lit(1), F.col("_n") - cut), F.substring("_start", F.lit(1), cut)))
        part = with_fingerprint(with_fingerprint(part, "_text", "_f", lexicon, bits), "_edited", "_e", lexicon, bits)
        return part.select("_id", "_next", F.col("_n").cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
                           "_f", "_e", F.xxhash64("_text").alias("_h"))

    done = printed(both.unionByName(alone)).checkpoint()
    # of rows that share an id the smallest text's
    repeated = known.where(F.col("_rows") > 1).select("_id")
    least = named.join(repeated.hint("merge"), "_id", "left_semi").groupBy("_id").agg(F.xxhash64(F.min("_text")).alias("_least"))
    nexts = (done.where(F.col("_id").isNotNull()).select("_id", "_f", "_h").join(least, "_id", "left").where(F.coalesce(F.col("_least") == F.col("_h"), F.lit(True)))
             .groupBy(F.col("_id").alias("_next")).agg(F.min("_f").alias("_g")))
    return (done.join(nexts, "_next", "left")
            .select(F.col("_id").alias(id_col), "n_chars", "edited_sha256",
                    _shown("_f").alias("fingerprint"), _shown("_e").alias("edited_fingerprint"),
                    likeness(F.col("_f"), F.col("_e")).alias("near_edited"), likeness(F.col("_f"), F.col("_g")).alias("near_next")))
