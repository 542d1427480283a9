"""The corpus pipeline: each stage against a brute-force version on its own input."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from spendguard.llm import common, quality, secrets, toxicity
from test_near_dedup import brute
from test_packing import check, direct

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*SCHEMA_NAMES).collect()), key=str)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def test_stages_and_run(spark, tmp_path):
    docs = common.table(spark, SF, "documents")
    seen = {r.doc_id: tuple(r) for r in docs.select(*SCHEMA_NAMES).collect()}
    labels = common.table(spark, SF, "labels")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "minhash_near_dedup", "secret_scans", "packing"]

    def step(name, docs):
        path = str(tmp_path / name)
        stage[name](spark, docs, SF).write.parquet(path)
        return spark.read.parquet(path)

    def kept(df):
        assert df.columns == docs.columns
        out = rows_of(df)
        assert all(seen[r[0]] == r for r in out)
        return {r[0] for r in out}

    chain = toxicity.fit(docs, labels, toxicity.categories())
    words = toxicity._Known(toxicity.word_features)
    toxic = {i for i, r in seen.items() if chain.probabilities(toxicity.features(r[1] or "", words))[-1] >= 0.5}
    one = step("toxicity", docs)
    assert kept(one) == set(seen) - toxic
    toxic_labels = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(toxic & toxic_labels) > 0.9 * len(toxic_labels) and not toxic & {r.doc_id for r in labels.where("toxic = 0").collect()}

    model = quality.fit(one, labels)
    two = step("quality_classifier", one)
    x = {r.doc_id: quality.difference(quality.pd.Series([r.text or ""]), model.good, model.bad)[0] for r in one.collect()}
    assert kept(two) == {i for i, v in x.items() if 1 / (1 + np.exp(-(model.slope * v + model.intercept))) >= quality.THRESHOLD}

    three = step("minhash_near_dedup", two)
    assert kept(three) == {i for i, _, _, keep in brute([(r.doc_id, r.text) for r in two.collect()], 5) if keep}

    four = step("secret_scans", three)
    assert four.columns == docs.columns
    expected = [(i, secrets.mask(t, "<secret>"), *rest, len(secrets.mask(t, "<secret>"))) for i, t, *rest, _ in rows_of(three)]
    assert rows_of(four) == sorted(expected, key=str)

    five = step("packing", four)
    check([r.asDict() for r in five.collect()], {r.doc_id: direct(r.text) for r in four.collect()}, 2048)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, five.collect()))


def test_odd_rows_pass_through_every_stage(spark, tmp_path):
    rows = [(1, None, "en", "s", None), (2, "", "en", None, 0), (None, "no id", None, "s", 5), (4, "same text here", "en", "s", 14),
            (4, "same text here", "en", "s", 14), (5, "same text here", "de", "s", 14), (6, "x" * 60_000, "en", "s", 60_000), (7, "password=abcdefghijkl", "en", "s", 21)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", _quality string")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs.write.parquet(str(tmp_path / f"{k}-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
        if name == "minhash_near_dedup":
            before = docs.count()
        docs = stage(spark, docs, SF)
        assert docs.columns == [*SCHEMA_NAMES, "_quality"]
        if name == "minhash_near_dedup":
            left = docs.groupBy("doc_id").agg(F.count("*").alias("n")).collect()
            assert all(r.n == 1 for r in left) and not {4, 5} <= {r.doc_id for r in left} and len(left) <= before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
