from __future__ import annotations

import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers

from spendguard.llm import packing
from spendguard.llm.queries import op3_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=1)
def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def direct(text):
    return _tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


def check(pieces, ids, capacity):
    """Each id in exactly one piece; sequences gapless from 0 and within capacity. Returns sequences' lengths."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p["length"] > 0
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by_doc) == set(ids)
    for doc, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids[doc]))
            own = np.array(ids[doc][at:at + p["length"]], "<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(own)
            at += p["length"]
        assert at == len(ids[doc])
    lengths = []
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
        lengths.append(at)
    return lengths


def rows_of(spark, rows, schema="doc_id long, text string", **options):
    packed = packing.pack(spark.createDataFrame(rows, schema), tokenizer_path=PATH, **options)
    return [r.asDict() for r in packing.pieces_with_crc(packed).collect()]


def test_words_give_the_ids_of_the_whole_text():
    ids = packing.WordIds(PATH, known_words=6, known_spellings=5)
    for text in ["", "  ", "It's THE end.\n\nof\tit", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "Ünï cödé ÀÉ ẞ İ Σς K", "ä é ́x",
                 "x\x1cy\x85z w v", "12 345 3.14 !!! ***a*** don't 'RE word.### (x) µ ª º ÷ × ÿ", "日本語 テキスト", "w" * 200, "﻿ ​ zero​width"]:
        assert np.frombuffer(ids.of(text), "<u4").tolist() == direct(text)[:-1], text


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "one two three " * 30), (4, "word"), (5, "long " * 500)]
    pieces = rows_of(spark, rows, sequence_tokens=64, buffer_tokens=256)
    check(pieces, {i: direct(t) for i, t in rows}, 64)
    assert rows_of(spark, []) == []
    null_ids = rows_of(spark, [(None, "a"), (None, "a"), (7, "b")], "doc_id long, text string")
    assert sorted((p["doc_id"] is None, p["length"]) for p in null_ids) == [(False, 2), (True, 2), (True, 2)]
    extra = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, key string, start int")
    assert packing.pack(extra, tokenizer_path=PATH).columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def test_assignment_goes_to_the_cheapest_sequence_with_room():
    lengths = np.array([30, 10, 60, 50, 50])
    placed = packing.assign(lengths, 100)
    assert [p[0] for p in placed] == [2, 3, 4, 0, 1]
    assert placed[:3] == [(2, 0, 60, 0), (3, 0, 50, 1), (4, 0, 50, 1)] and placed[3:] == [(0, 0, 30, 0), (1, 0, 10, 0)]
    cut = packing.assign(np.array([70, 70, 60]), 100)
    assert sum(n for _, _, n, _ in cut) == 200 and max(k for *_, k in cut) == 1


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    lengths = check([r.asDict() for r in op3_packing(spark, sf).collect()], {r.doc_id: direct(r.text) for r in docs}, 2048)
    assert sum(lengths) > 0.97 * 2048 * len(lengths)
