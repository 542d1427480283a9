"""Exact top-k search by tiles.

Queries and vectors are dealt to a grid: query rows go to every column of vectors, vector rows to
every row of queries, and one cell holds a bounded number of both. A cell multiplies its tile in
slices, selects each query's k best of the tile, and the tiles' lists are merged in a tree: first
over groups of neighbouring columns, then over the groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column

#: Rows of a tile, of a slice that is multiplied at once, and lists that one merge takes.
TILE_QUERIES, TILE_VECTORS = 4_096, 8_192
SLICE_QUERIES, SLICE_VECTORS = 256, 4_096
MERGE = 32


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """Components as integers, floor(scale * x) of each x as a double; null for a vector that is
    null, empty or holds a component that is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.int64) for v in vectors])


def best_of_tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(row of queries, row of vectors, score) of each query's k best, its own id left out; equal
    scores in the order of the ids, which must ascend."""
    out: list[tuple[int, int, int]] = []
    # a product of integers is exact in doubles while every partial sum stays below 2^53
    top = max(int(np.abs(queries).max(initial=0)), 1) * max(int(np.abs(vectors).max(initial=0)), 1) * queries.shape[1]
    kind = np.float64 if top < 2 ** 53 else object
    turned = vectors.astype(kind).T
    for q0 in range(0, len(queries), SLICE_QUERIES):
        part = queries[q0:q0 + SLICE_QUERIES].astype(kind)
        found = []
        for v0 in range(0, len(ids), SLICE_VECTORS):
            scores = part @ turned[:, v0:v0 + SLICE_VECTORS]
            scores[query_ids[q0:q0 + SLICE_QUERIES, None] == ids[None, v0:v0 + SLICE_VECTORS]] = -np.inf
            for _ in range(min(k, scores.shape[1])):
                at = scores.argmax(axis=1)  # the first of equal ones, so the smallest id
                value = scores[np.arange(len(part)), at]
                found += [(q0 + i, v0 + int(j), int(s)) for i, (j, s) in enumerate(zip(at, value, strict=True)) if s > -np.inf]
                scores[np.arange(len(part)), at] = -np.inf
        found.sort(key=lambda x: (x[0], -x[2], x[1]))
        count: dict[int, int] = {}
        for x in found:
            if count.setdefault(x[0], 0) < k:
                count[x[0]] += 1
                out.append(x)
    return out


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = 256.0, tile_queries: int = TILE_QUERIES, tile_vectors: int = TILE_VECTORS) -> DataFrame:
    """``query_id``, ``rank`` from 1, the found id and ``score``, the integer inner product of the
    quantised vectors, for each row for which ``is_query`` (a condition on ``vectors``) holds.

    Rows without an id and vectors that are null, empty or hold a component that is null or not
    finite take no part. A row that is repeated with the same vector counts once; an id with several
    vectors is a candidate with each, and a query whose list is the best of any of them. A query is
    scored against vectors of its own length only. No rows give no rows.
    """
    rows = (vectors.select(column(id_col).alias("_id"), quantised(column(vector_col), scale).alias("_v"), is_query.alias("_q"))
            .where(F.col("_id").isNotNull() & F.col("_v").isNotNull()).dropDuplicates(["_id", "_v"]))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce("_q", F.lit(False))).alias("q"),
                     F.max(F.abs(F.col("_id").cast("double"))).alias("most")).first()
    columns, lines = max(1, math.ceil(sizes["n"] / tile_vectors)), max(1, math.ceil(sizes["q"] / tile_queries))
    kind = rows.schema["_id"].dataType

    def dealt(n: int, salt: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "_id", "_v"), F.lit(n)).cast("int")

    # one row per query or vector and cell that it meets
    query_side = (rows.where("_q").select("_id", "_v", dealt(lines, "line").alias("_line"),
                                          F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("_column")))
    vector_side = rows.select(F.col("_id").alias("_found"), F.col("_v").alias("_w"), dealt(columns, "column").alias("_at"),
                              F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("_from"))

    def cell(key, queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        if queries.empty or found.empty:
            return pd.DataFrame(out, columns=["query_id", "_column", "_found", "score"])
        for width, some in queries.groupby(queries["_v"].map(len)):
            among = found[found["_w"].map(len) == width].sort_values("_found", kind="stable")
            if len(among):
                q_ids, ids = some["_id"].to_numpy(), among["_found"].to_numpy()
                out += [(q_ids[i], int(key[1]), ids[j], s) for i, j, s in best_of_tile(q_ids, _matrix(some["_v"]), ids, _matrix(among["_w"]), k)]
        return pd.DataFrame(out, columns=["query_id", "_column", "_found", "score"])

    tiles = query_side.groupBy("_line", "_column").cogroup(vector_side.groupBy("_from", "_at")).applyInPandas(
        cell, f"query_id {kind.simpleString()}, _column int, _found {kind.simpleString()}, score long")

    def merged(lists: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "_found")
        return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    level = columns
    lists = tiles.withColumn("_group", F.col("_column"))
    while level > MERGE:
        lists = merged(lists.withColumn("_group", F.floor(F.col("_group") / MERGE).cast("int")), "_group")
        level = math.ceil(level / MERGE)
    return merged(lists).select("query_id", "rank", F.col("_found").alias(id_col), "score")


#: The same over the table ``embeddings`` in DuckDB, for queries with an id divisible by 50.
SQL = """
WITH r AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r q JOIN r c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""
