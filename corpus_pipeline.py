"""A cleaning pipeline over ``documents``: stages of spendguard.llm, each written as Parquet and
reread as the next one's input.

Order: toxic documents go, low-quality documents go, one document of each group of near copies
stays, secrets are masked, and what is left is packed into sequences. Null texts, empty texts and
tables pass through the stages as the operators define it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendguard.llm import common, near_dedup, packing, quality, secrets, toxicity
from spendguard.llm.common import bound_batches, column, text_of
from spendguard.session import checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _whole(docs: DataFrame) -> DataFrame:
    """Each row as one column beside its text, so that no column of a stage meets one of the table."""
    return docs.select(F.struct(*map(column, docs.columns)).alias("doc"), text_of("text").alias("text"))


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go."""
    bound_batches(spark)
    chain = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), toxicity.categories())
    rows = toxicity.score(_whole(docs), chain, text_col="text", out_col="found")
    return rows.where(F.col("found.toxic") < toxicity.THRESHOLD).select("doc.*")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold go."""
    bound_batches(spark)
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality.score(_whole(docs), model, text_col="text", out_col="found").where(F.col("found") >= quality.THRESHOLD).select("doc.*")


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group stays, and of rows that share its id one;
    documents without words, and without an id, are in no group and stay."""
    bound_batches(spark)
    return near_dedup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and the count of its characters follows; no document goes."""
    bound_batches(spark)
    masked = secrets.mask_secrets(docs, text_col="text")
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of sequences of 2048 tokens."""
    bound_batches(spark)
    # smaller tables than on their own: the workers have served the other stages before
    packed = packing.pack(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"), known_words=750_000, known_spellings=300_000)
    return packing.pieces_with_crc(packed)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_filter),
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_dedup_filter),
    ("secret_scans", secret_scan),
    ("packing", pack),
]

#: The trained models and the tokenizer have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. Each result is written to the shared folder of
    ``spark.checkpoint.dir`` and read again, so that a lost executor costs one stage at most. A stage's
    folder goes when the next one is written; the last one is what the result is read from."""
    folder = f"{checkpoint_dir(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    docs, before = common.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)
        before = path
    return docs
