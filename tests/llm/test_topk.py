from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from oracle import same
from spendguard.llm import topk
from spendguard.llm.queries import ORACLE_SQL, op9_topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    def fine(v):
        return v and all(x is not None and np.isfinite(x) for x in v)
    keep = {(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v in rows if i is not None and fine(v)}
    out = []
    for q in sorted({i for i, _ in keep if i % 50 == 0}):
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for i, v in keep if i == q for c, w in keep if c != q and len(v) == len(w))
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best[:k])]
    return sorted(out)


def run(spark, rows, schema=SCHEMA, **options):
    df = topk.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0, **options)
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_against_brute_force_over_many_tiles(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 4) / 3]) for i in range(400)]  # many ties
    assert run(spark, rows, tile_queries=3, tile_vectors=10) == brute(rows, 5)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]),
            (50, [0.5, -0.5]), (7, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0]), (8, [0.25, 0.25]), (150, [9.0])]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == []
    extra = [(i, v, 1, 2) for i, v in rows]
    assert run(spark, extra, SCHEMA + ", score int, rank int") == brute(rows, 5)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert same(op9_topk(spark, sf), sf, ORACLE_SQL["op9_topk"])


def test_scores_beyond_doubles_keep_their_order():
    big = 2 ** 30
    vectors = np.array([[big, i] for i in range(4)], dtype=np.int64)
    out = topk.best_of_tile(np.array([3]), np.array([[big, 1]], dtype=np.int64), np.arange(4), vectors, 4)
    assert out == [(0, i, big * big + i) for i in (2, 1, 0)]
