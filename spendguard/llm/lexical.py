"""Ranked lexical search: item terms against all documents, by dense blocked matrix products.

Scores are whole numbers. A document's impact of a term depends on the term's count and on the
document's length; a term's weight on how many documents hold it. A score is the sum of weight times
impact over an item's terms.

1. Items are worked off in passes of bounded size. The terms of a pass get compact numbers in the
   order in which its items use them.
2. One pass over the documents counts what the weights need and writes the documents as tiles: the
   compact numbers and counts of the terms that the pass asks for, and nothing else of the text.
3. For each tile of documents, tiles of weights (items x terms) are multiplied by tiles of impacts
   (terms x documents) in float64. A tile of terms is closed before any item's weights in it, times
   the largest impact, reach 2^53, so every partial sum is exact; the partial sums are added as 64-bit
   integers.
4. Of each tile product an item keeps its highest scores and all that tie with the last of them, and
   the ties are broken by the documents' ids. Tasks' lists are merged in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import column

TOP = 10
#: Documents, terms and items of a tile; terms that a tile of documents may hold before it is closed.
TILE_DOCS, TILE_TERMS, TILE_ITEMS, TILE_ENTRIES = 1_024, 1_024, 512, 1 << 20
#: Items of a pass and the sum of their distinct terms: what the driver and each worker hold of them.
PASS_ITEMS, PASS_TERMS = 4_096, 200_000
#: Lists of one item that meet in the first step of the merge.
MERGE_BUCKETS = 64
#: An impact is below this, and a sum of whole numbers below 2^53 is exact in a double.
IMPACT_BOUND, EXACT = 1_000_000, 1 << 53

#: Letters A-Z in lower case, and a blank for every ASCII character that is neither letter nor digit.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_TILES = ("ids binary, unnamed binary, terms binary, starts binary, numbers binary, counts binary, "
          "n_docs long, n_terms long, df_numbers array<int>, df array<long>")


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order. A byte of 128 or more is part of a letter beyond ASCII."""
    return text.translate(_PLAIN).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """Of a term that stands ``counts`` times in a document of ``lengths`` terms."""
    m = 100 - 75 + (75 * lengths * n_docs) // all_terms
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


class Vocabulary:
    """Items as rows of (compact term number, repeats), and the number of each term."""

    def __init__(self, items: list[dict[bytes, int]]):
        self.number: dict[bytes, int] = {}
        for item in items:
            for term in item:
                self.number.setdefault(term, len(self.number))
        self.items = [(np.array([self.number[t] for t in item], dtype=np.int64), np.array(list(item.values()), dtype=np.int64)) for item in items]


def _tiles(batches: Iterator[pd.DataFrame], number: dict[bytes, int], tile_docs: int, tile_entries: int) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _TILES.split(", ")]
    n_docs = n_terms = 0
    df = np.zeros(len(number), dtype=np.int64)
    ids: list[int] = []
    unnamed: list[int] = []
    sizes: list[int] = []
    lengths: list[int] = []
    numbers: list[int] = []
    counts: list[int] = []

    def flush() -> pd.DataFrame:
        found = np.array(numbers, dtype=np.int32)
        np.add.at(df, found, 1)
        row = (np.array(ids, dtype=np.int64).tobytes(), np.array(unnamed, dtype=np.int8).tobytes(), np.array(lengths, dtype=np.int64).tobytes(),
               np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64).tobytes(), found.tobytes(), np.array(counts, dtype=np.int64).tobytes(),
               0, 0, None, None)
        for x in (ids, unnamed, sizes, lengths, numbers, counts):
            x.clear()
        return pd.DataFrame([row], columns=names)

    for batch in batches:
        for key, text in zip(batch["_id"], batch["_text"], strict=True):
            if text is None:
                continue
            words = terms_of(text)
            if not words:
                continue
            n_docs += 1
            n_terms += len(words)
            found = Counter(filter(number.__contains__, words))
            if not found:
                continue
            ids.append(0 if key is None else int(key))
            unnamed.append(key is None)
            sizes.append(len(found))
            lengths.append(len(words))
            numbers.extend(map(number.__getitem__, found))
            counts.extend(found.values())
            if len(ids) >= tile_docs or len(numbers) >= tile_entries:
                yield flush()
    if ids:
        yield flush()
    some = np.flatnonzero(df)
    yield pd.DataFrame([(None, None, None, None, None, None, n_docs, n_terms, some.astype(np.int32).tolist(), df[some].tolist())], columns=names)


class Blocks:
    """The weights of a pass as dense blocks: for each tile of items the tiles of terms that they
    use. A weight beyond what one tile may hold is spread over several."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, tile_items: int, tile_terms: int, limit: int = EXACT // IMPACT_BOUND - 1):
        self.n, self.tiles = len(items), []
        for low in range(0, len(items), tile_items):
            entries: dict[int, list[tuple[int, int]]] = {}
            for row, (terms, repeats) in enumerate(items[low:low + tile_items]):
                for term, w in zip(terms.tolist(), (repeats * weights[terms]).tolist(), strict=True):
                    if w:
                        entries.setdefault(term, []).append((row, w))
            rows = min(tile_items, len(items) - low)
            self.tiles.append((low, rows, list(self._cut(entries, rows, tile_terms, limit))))

    @staticmethod
    def _cut(entries: dict[int, list[tuple[int, int]]], rows: int, tile_terms: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(term numbers, dense weights): ``limit`` bounds the sum of an item's weights in a tile."""
        left = {t: list(v) for t, v in sorted(entries.items())}
        while left:
            room = np.full(rows, limit, dtype=np.int64)
            taken, columns = [], []
            for term in list(left):
                if len(taken) == tile_terms:
                    break
                now = np.zeros(rows)
                after = []
                for row, w in left[term]:
                    part = min(w, int(room[row]))
                    now[row] = part
                    room[row] -= part
                    if w > part:
                        after.append((row, w - part))
                taken.append(term)
                columns.append(now)
                if after:
                    left[term] = after
                    break  # full for some item: the rest of its weights goes to the next tile
                del left[term]
            yield np.array(taken, dtype=np.int64), np.stack(columns, axis=1)


def score_tile(blocks: Blocks, n_numbers: int, starts: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first item, scores as items x documents) of a tile of documents, exact 64-bit integers."""
    n = len(starts) - 1
    doc = np.repeat(np.arange(n), np.diff(starts))
    order = np.argsort(numbers, kind="stable")
    numbers, doc, values = numbers[order], doc[order], values[order].astype(np.float64)
    first = np.searchsorted(numbers, np.arange(n_numbers + 1))
    for low, rows, tiles in blocks.tiles:
        scores = np.zeros((rows, n), dtype=np.int64)
        for terms, dense in tiles:
            sizes = first[terms + 1] - first[terms]
            there = np.flatnonzero(sizes)  # terms that no document of the tile holds add nothing
            if not len(there):
                continue
            at = np.concatenate([np.arange(first[t], first[t + 1]) for t in terms[there]])
            impact = np.zeros((len(there), n))
            impact[np.repeat(np.arange(len(there)), sizes[there]), doc[at]] = values[at]
            scores += (dense[:, there] @ impact).astype(np.int64)
        yield low, scores


class _Best:
    """The highest scores of each item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.floor = top, np.ones(items, dtype=np.int64)
        self.parts: list[np.ndarray] = []
        self.waiting = 0

    def add(self, low: int, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        n = scores.shape[1]
        least = self.floor[low:low + len(scores)]
        if n > self.top:
            least = np.maximum(least, np.partition(scores, n - self.top, axis=1)[:, n - self.top])
        item, doc = np.nonzero(scores >= least[:, None])  # with all that tie with the last one
        if len(item):
            self.parts.append(np.stack([item + low, scores[item, doc], unnamed[doc], ids[doc]]))
            self.waiting += len(item)
        if self.waiting > max(100_000, 4 * self.top * len(self.floor)):
            self.reduce()

    def reduce(self) -> np.ndarray:
        """(item, score, unnamed, id) of at most ``top`` of each item, highest score and smallest id first."""
        if not self.parts:
            return np.empty((4, 0), dtype=np.int64)
        every = np.concatenate(self.parts, axis=1)
        item, score, unnamed, ids = every[:, np.lexsort((every[3], every[2], -every[1], every[0]))]
        start = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        place = np.arange(len(item)) - np.repeat(start, np.diff(np.r_[start, len(item)]))
        keep = place < self.top
        last = place == self.top - 1
        self.floor[item[last]] = score[last]
        kept = np.stack([item, score, unnamed, ids])[:, keep]
        self.parts, self.waiting = [kept], kept.shape[1]
        return kept


def _passes(items: DataFrame, pass_items: int, pass_terms: int) -> tuple[DataFrame, int]:
    """``items`` with a number ``_pass``, each pass within both bounds or of one item alone."""
    found = items.agg(F.count("*").alias("n"), F.sum(F.size("_terms")).alias("terms")).first()
    n = max(1, -(-found["n"] // pass_items), -(-(found["terms"] or 0) // pass_terms))
    while True:
        dealt = items.withColumn("_pass", F.pmod(F.xxhash64("_item", "_terms", F.lit(n)), F.lit(n)).cast("int"))
        largest = dealt.groupBy("_pass").agg(F.count("*").alias("n"), F.sum(F.size("_terms")).alias("terms")).where(
            (F.col("n") > 1) & ((F.col("n") > pass_items) | (F.col("terms") > pass_terms)))
        if largest.isEmpty():
            return dealt, n
        n *= 2


def rank(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
         top: int = TOP, tile_docs: int = TILE_DOCS, tile_terms: int = TILE_TERMS, tile_items: int = TILE_ITEMS,
         pass_items: int = PASS_ITEMS, pass_terms: int = PASS_TERMS) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: of each row of ``items`` the ``top``
    documents with the highest scores above 0, ties to the smaller id.

    A null or empty text has no terms: such a document counts nowhere and such an item finds
    nothing. A text of any length is taken whole. Each row of ``docs`` is a document of its own, also
    a repeated one; one without an id ranks behind those of the same score. Each row of ``items`` is
    an item of its own: a repeated one repeats its result, and a null item id stays null. Document
    ids are integers. Other columns are ignored; if either table is empty so is the result.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    texts = docs.select(column(id_col).cast("string").alias("_id"), column(text_col).cast("string").cast("binary").alias("_text"))

    @F.pandas_udf("array<struct<term:binary,n:long>>")
    def counted(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [] if t is None else list(Counter(terms_of(bytes(t))).items()))

    asked = (items.select(column(item_col).alias("_item"), counted(column(item_text_col).cast("string").cast("binary")).alias("_terms"))
             .where(F.size("_terms") > 0).groupBy("_item", "_terms").agg(F.count("*").alias("_copies")).checkpoint())
    dealt, n_passes = _passes(asked, pass_items, pass_terms)
    dealt = dealt.checkpoint()
    kind = items.schema[item_col].dataType
    found = None
    for k in range(n_passes):
        rows = dealt.where(F.col("_pass") == k).collect()  # bounded by the pass
        if rows:
            part = _one_pass(texts, [{bytes(x["term"]): x["n"] for x in r["_terms"]} for r in rows], top, tile_docs, tile_terms, tile_items)
            named = spark.createDataFrame([(i, r["_item"], r["_copies"]) for i, r in enumerate(rows)], asked.select(F.lit(0).alias("_number"), "_item", "_copies").schema)
            part = part.join(F.broadcast(named), "_number")  # as many rows as the pass has items
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "rank int, _doc long, score long").withColumns({"_item": F.lit(None).cast(kind), "_copies": F.lit(1).cast("long")})
    return (found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
            .select(F.col("_item").alias(item_col), "rank", F.col("_doc").alias(id_col), "score"))


def _one_pass(texts: DataFrame, items: list[dict[bytes, int]], top: int, tile_docs: int, tile_terms: int, tile_items: int) -> DataFrame:
    """``_number`` (place in ``items``), ``rank``, ``_doc`` and ``score``."""
    spark = texts.sparkSession
    vocabulary = Vocabulary(items)
    numbers = spark.sparkContext.broadcast(vocabulary.number)
    tiles = texts.mapInPandas(lambda b: _tiles(b, numbers.value, tile_docs, TILE_ENTRIES), _TILES).checkpoint()
    seen = tiles.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, all_terms = seen["docs"] or 0, seen["terms"] or 0
    # at most a row for each term of the pass
    df = (tiles.where(F.col("df").isNotNull()).select(F.explode(F.arrays_zip("df_numbers", "df")).alias("x"))
          .groupBy(F.col("x.df_numbers").alias("number")).agg(F.sum("x.df").alias("df")).collect())
    weights = np.zeros(len(vocabulary.number), dtype=np.int64)
    for r in df:
        weights[r["number"]] = weight(n_docs, r["df"])
    shared = spark.sparkContext.broadcast((vocabulary.items, weights))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, w = shared.value
        blocks = Blocks(wanted, w, tile_items, tile_terms)
        best = _Best(blocks.n, top)
        for batch in batches:
            for row in batch.itertuples(index=False):
                starts, lengths = np.frombuffer(row.starts, np.int64), np.frombuffer(row.terms, np.int64)
                values = impacts(np.frombuffer(row.counts, np.int64), np.repeat(lengths, np.diff(starts)), n_docs, all_terms)
                ids, unnamed = np.frombuffer(row.ids, np.int64), np.frombuffer(row.unnamed, np.int8).astype(np.int64)
                for low, scores in score_tile(blocks, len(w), starts, np.frombuffer(row.numbers, np.int32), values):
                    best.add(low, scores, ids, unnamed)
        item, points, unnamed, ids = best.reduce()
        yield pd.DataFrame({"_number": item.astype(np.int32), "score": points, "_unnamed": unnamed, "_doc": ids,
                            "_part": np.full(len(item), TaskContext.get().partitionId(), dtype=np.int32)})

    lists = (tiles.where(F.col("ids").isNotNull()).select("ids", "unnamed", "terms", "starts", "numbers", "counts")
             .mapInPandas(score, "_number int, score long, _unnamed long, _doc long, _part int"))
    order = [F.desc("score"), F.col("_unnamed"), F.col("_doc")]
    bucket = F.pmod(F.col("_part"), F.lit(MERGE_BUCKETS))
    for keys in ([F.col("_number"), bucket], [F.col("_number")]):
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return lists.select("_number", "rank", F.when(F.col("_unnamed") == 0, F.col("_doc")).alias("_doc"), "score")


#: The same rows in DuckDB.
SQL = rf"""
WITH doc_terms AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
),
tfs AS (SELECT r, doc_id, term, count(*) AS tf FROM doc_terms GROUP BY r, doc_id, term),
lengths AS (SELECT r, count(*) AS n FROM doc_terms GROUP BY r),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM lengths),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs, corpus GROUP BY term, n_docs
),
item_terms AS (
  SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)
),
queries AS (SELECT i, item_id, term, count(*) AS repeats FROM item_terms GROUP BY i, item_id, term),
scores AS (
  SELECT i, item_id, t.r, t.doc_id,
         CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // all_terms)))) AS BIGINT) AS score
  FROM queries JOIN tfs t USING (term) JOIN weights USING (term) JOIN lengths l ON l.r = t.r, corpus
  GROUP BY i, item_id, t.r, t.doc_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scores WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= {TOP}"""
