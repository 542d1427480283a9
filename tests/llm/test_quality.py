from __future__ import annotations

import random
import zlib

import numpy as np

from spendguard.llm import quality
from spendguard.llm.queries import op6_quality


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "and", "of", "water", "house", "river", "green", "walk", "under", "often"]
    good = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 200))) + "." for _ in range(n)]
    bad = [" ".join(rng.choice(words) + rng.choice(["%%%", "###", "&&&"]) for _ in range(rng.randint(5, 200))) for _ in range(n)]
    return good, bad


def test_learns_compression_and_handles_edges(spark):
    good, bad = texts(1, 150)
    rows = [(i, t) for i, t in enumerate(good + bad)]
    labels = [(i, 1 if i < 150 else 0) for i, _ in rows] + [(None, 1), (0, 1), (900, 0), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    more_good, more_bad = texts(2, 30)
    odd = [(1000, None), (1001, ""), (None, "the river"), (1002, "é" * 50_000), (1000, None)]
    new = [(i + 2000, t) for i, t in enumerate(more_good + more_bad)]
    frame = spark.createDataFrame([(*r, "x", 9.0) for r in new + odd], "doc_id long, text string, _text string, score double")
    out = quality.scored(frame, model).collect()
    assert len(out) == len(new) + len(odd) and out[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    by = {r.doc_id: r for r in out}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert np.mean([by[i].predicted == (i < 2030) for i, _ in new]) > 0.95
    assert by[1000].score == by[1001].score and by[None].held_out is False
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert quality.scored(frame.limit(0), model).collect() == []


def test_held_out_rows_are_not_learned_from(spark):
    good, bad = texts(3, 100)
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    def fit(flip):
        labels = [(i, int(i < 100) ^ int(flip and zlib.crc32(str(i).encode()) % 5 == 0)) for i, _ in rows]
        return quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert fit(False) == fit(True)


def test_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    one = quality.fit(docs, spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int"))
    assert all(r.score > 0.5 for r in quality.scored(docs, one).collect())


def test_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in op6_quality(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if out[r.doc_id].held_out]
    good = np.array([out[r.doc_id].score for r in labels if r.quality == 1])
    bad = np.array([out[r.doc_id].score for r in labels if r.quality == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.9 and (good >= 0.3).mean() > 0.95
