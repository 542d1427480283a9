from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from spendguard.llm import byte_bpe
from spendguard.llm.queries import op1_byte_bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string"


def direct(text):
    return byte_bpe._encoding(RANKS, PATTERN).encode_ordinary(text or "")


def run(spark, rows, schema=SCHEMA, **options):
    docs = spark.createDataFrame(rows, schema)
    out = byte_bpe.decode(byte_bpe.encode(docs, ranks_path=RANKS, pattern=PATTERN, **options), ranks_path=RANKS)
    return sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in out.collect()), key=lambda r: (r[0] is None, r))


def expected(rows):
    return sorted(((r[0], direct(r[1]), (r[1] or "").encode()) for r in rows), key=lambda r: (r[0] is None, r))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "it's <|endoftext|> 'RE 日本語    x\n\n"), (3, "it's"), (None, "no id"), (None, "no id"), (4, "a\x1c\x1d b\x85c﻿")]
    assert run(spark, rows) == expected(rows)


def test_stitched_chunks(spark):
    rng = random.Random(5)
    parts = ["the", " quick", "\n\n", "   ", "'s", "'re", "'", "é", " ", "\t", "123", "!!", "\x1c", "日本", "ß", " ", "abcdefghij" * 3, "." * 20]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 400)))) for i in range(60)]
    rows += [(100, "a" * 700), (101, " " * 700), (102, "x y " * 300 + "b" * 90 + " c d" * 200), (103, "\n" * 65), (104, None), (100, "a" * 700)]
    assert run(spark, rows, chunk_chars=64, overlap_chars=32) == expected(rows)


@pytest.mark.parametrize("white", [" ", "\n", " \n\t", "\u3000 "])
def test_long_runs_of_white_space_are_what_the_library_makes_of_them(white):
    run = (white * 3_000)[:5_000]
    for text in ["a" + run + "b", run, "x" + run, run + "'s y", "1" + run + "2" + run + "\x1c" + run + "!", "é" + run[:2_047] + "b" + run[:2_048] + "日"]:
        assert np.frombuffer(byte_bpe.encode_text(text, RANKS, PATTERN), "<u4").tolist() == direct(text)


@pytest.mark.parametrize("white", [" ", "\n"])
def test_two_million_characters_of_white_space(spark, white):
    rows = [(1, "a" + white * 2_000_000 + "b c")]
    (_, ids, decoded), = run(spark, rows)
    assert decoded == rows[0][1].encode()
    tail = direct("a" + white * 4_000 + "b c")
    assert ids[0] == tail[0] and ids[-3:] == tail[-3:]


def test_a_lost_stitch_is_followed_by_several_pieces(spark):
    text = "x y " * 100 + "b" * 300 + " c d" * 400
    assert run(spark, [(1, text)], chunk_chars=64, overlap_chars=32) == expected([(1, text)])
    beyond = spark.createDataFrame([(0, "1", text)], "_n long, _key string, _text string")
    pieces = sorted((r["_piece"], r["_text"]) for r in byte_bpe.pieces_of(beyond, PATTERN, 64, 32).collect())
    assert "".join(t for _, t in pieces) == text
    assert len(pieces) > 20 and max(len(t) for _, t in pieces) < 500


def test_extra_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x " * 100, "a", b"b")], "doc_id long, text string, _text string, ids binary")
    assert byte_bpe.encode(docs, ranks_path=RANKS, pattern=PATTERN, chunk_chars=16, overlap_chars=8).columns == ["doc_id", "ids"]
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        byte_bpe.encode(docs, ranks_path=RANKS, pattern=PATTERN, chunk_chars=8, overlap_chars=16)


def test_query_against_direct_encoding(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op1_byte_bpe(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = direct(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
