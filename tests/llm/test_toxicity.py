from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from spendguard.llm import toxicity
from spendguard.llm.queries import op2_toxicity

WORDS = ["the", "and", "of", "water", "house", "river", "green", "walk", "under", "often", "stone", "cloud"]


def corpus(seed, n, start=0):
    """Rows of text with both categories; insults are a word, or a stem with any ending."""
    rng = random.Random(seed)
    rows = []
    for i in range(start, start + n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(10, 80))]
        toxic, noise = rng.random() < 0.3, rng.random() < 0.2
        if toxic:
            words += rng.choices(["fool", "grumpf" + "".join(rng.choices("aeiou", k=4))], k=2)
        if noise:
            words += ["zzz"] * 3
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(not noise), int(toxic)))
    return rows


def fitted(spark, rows, **options):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in rows] + [(None, 0, 1), (10 ** 6, 1, 1)], "doc_id long, quality int, toxic int")
    return toxicity.fit(docs, labels, toxicity.categories(), **options)


def test_chain_learns_both_categories(spark):
    chain = fitted(spark, corpus(1, 400))
    assert [x.name for x in chain.links] == ["low_quality", "toxic"] and len(chain.links[1].before) == 1
    new = corpus(2, 200, 5000)
    odd = [(1, None, 0, 0), (2, "", 0, 0), (None, "fool grumpfaaaa", 0, 0), (3, "x" * 100_000, 0, 0), (1, None, 0, 0)]
    frame = spark.createDataFrame([(r[0], r[1], 7, "y") for r in new + odd], "doc_id long, text string, predicted int, _p string")
    out = toxicity.scored(frame, chain).collect()
    assert len(out) == len(new) + len(odd) and list(out[0].asDict()) == ["doc_id", "low_quality_probability", "toxic_probability", "predicted"]
    by = {r.doc_id: r for r in out}
    assert np.mean([by[i].predicted == t for i, _, _, t in new]) > 0.98
    assert np.mean([(by[i].low_quality_probability > 0.5) == (q == 0) for i, _, q, _ in new]) > 0.98
    assert by[1].toxic_probability == by[2].toxic_probability < 0.5 and by[None].predicted == 1
    assert toxicity.scored(frame.limit(0), chain).collect() == []


def test_fit_does_not_depend_on_the_order_of_rows(spark):
    rows = corpus(3, 120)
    assert fitted(spark, rows) == fitted(spark, rows[::-1])


def test_later_model_uses_out_of_fold_predictions():
    """The second category is the first one: its weight on the first one's probability tells it."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300).astype(float)
    texts = [np.array(sorted({int(7 + v), *rng.integers(100, 2000, 5)})) for v in y]
    chain = toxicity.fit_chain(texts, np.arange(300) % toxicity.FOLDS, {"a": y, "b": y})
    first = chain.links[1].before[0]
    assert chain.links[0].before == () and first > 0.5
    # a random first category has out-of-fold probabilities that say nothing
    noise = rng.integers(0, 2, 300).astype(float)
    chain = toxicity.fit_chain(texts, np.arange(300) % toxicity.FOLDS, {"a": noise, "b": y})
    assert abs(chain.links[1].before[0]) < 1 < 2 * first


def test_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), toxicity.categories())
    assert {r.toxic_probability for r in toxicity.scored(docs, none).collect()} == {0.5}
    one = toxicity.fit(docs, spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int"), {"toxic": F.col("toxic") == 1})
    assert all(r.toxic_probability < 0.5 for r in toxicity.scored(docs, one).collect())


def test_query_on_unseen_folds(spark):
    """Accuracy on rows that a second fit did not see."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    chain = toxicity.fit(docs, labels.where(~held), toxicity.categories())
    out = {r.doc_id: r for r in toxicity.scored(docs, chain).collect()}
    rows = labels.where(held).collect()
    assert np.mean([out[r.doc_id].predicted == r.toxic for r in rows]) > 0.95
    assert sum(out[r.doc_id].predicted for r in rows if r.toxic == 0) <= 0.02 * len(rows)
    assert op2_toxicity(spark, sf).count() == docs.count()


def test_features_are_words_and_stems():
    known = toxicity._Known(toxicity.word_features)
    found = toxicity.features("Grumpfa grumpfe", known)
    assert len(found) == 5 and zlib.crc32(b"grump*") % toxicity.DIMENSIONS in found


def test_a_repeated_id_is_learned_once(spark):
    rows = [(i, f"word{i % 7} {'vile' if i % 3 == 0 else 'kind'} text{i}") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    once, often = (toxicity.fit(spark.createDataFrame(x, "doc_id long, text string"), labels, toxicity.categories()) for x in (rows, rows + [rows[0]] * 30))
    assert once == often
