"""One registered query per operator, over its whole table with the operator's own parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, imatch, lexical, licenses, line_rules, near_dedup, packing, prefix_trie, quality, secrets, topk, toxicity
from .common import bound_batches, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bound_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks_path=ranks, pattern=public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode(encoded, ranks_path=ranks))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.categories()))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bound_batches(spark)
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path=public_tokenizers.path("word_bpe_49k.json"))
    return packing.pieces_with_crc(packed)


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return secrets.span_digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_rules(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_toxicity, op3_packing, op4_imatch, op5_near_dedup, op6_quality, op7_chat, op8_licenses, op9_topk, op10_secrets,
                            op11_lexical, op12_line_rules, op13_prefix_trie)
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op7_chat": chat.SQL, "op9_topk": topk.SQL, "op11_lexical": lexical.SQL, "op12_line_rules": line_rules.SQL,
                              "op13_prefix_trie": prefix_trie.SQL}
