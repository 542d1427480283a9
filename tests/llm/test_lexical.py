from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spendguard.llm import lexical


def _terms(text):
    if text is None:
        return []
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, top):
    bags = [(i, Counter(_terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, all_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for (doc, bag), n in zip(bags, sizes):
            score = 0
            for term in _terms(text):
                if bag[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    m = 100 - 75 + (75 * n * n_docs) // all_terms
                    score += w * ((1_000_000_000 * bag[term]) // (1000 * bag[term] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if unnamed else doc, -s) for k, (s, unnamed, doc) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def _corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["ÉCLAIR", "Straße", "Ünï", "x1Y2", "İ", "K"]
    text = lambda size: rng.choice([" ", "-", "\n", " $"]).join(rng.choices(words, weights=range(len(words), 0, -1), k=size))
    docs = [(k, text(rng.randint(1, 40))) for k in range(n)]
    docs += [(500 + k, docs[3][1]) for k in range(40)]          # many ties
    docs += [(7, docs[7][1]), (None, docs[3][1]), (None, "w1 w2"), (900, None), (901, ""), (902, " -- "), (-5, docs[3][1])]
    items = [(k, text(rng.randint(1, 12))) for k in range(20)] + [(50, None), (51, ""), (52, "nowhere"), (53, docs[3][1]), (53, docs[3][1]), (None, "w1"), (54, "w0 " * 500)]
    rng.shuffle(docs)
    return docs, items


def _run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.rank(d, i, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, dict(tile_docs=7, tile_terms=3, tile_items=4), dict(pass_items=3, pass_terms=20), dict(top=3, tile_docs=16)])
def test_as_by_definition(spark, options):
    docs, items = _corpus(1)
    assert _run(spark, docs, items, **options) == brute(docs, items, options.get("top", 10))


def test_empty_tables(spark):
    docs, items = _corpus(2, 10)
    assert _run(spark, [], items) == [] == _run(spark, docs, [])
    assert lexical.rank(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")).dtypes == [
        ("item_id", "string"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_clashing_columns_are_ignored(spark):
    docs, items = _corpus(3, 30)
    d = spark.createDataFrame([(*r, "s", 1) for r in docs], "doc_id long, text string, score string, _item int")
    i = spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, doc_id int, rank string")
    assert sorted((tuple(r) for r in lexical.rank(d, i).collect()), key=repr) == brute(docs, items, 10)


def test_very_long_text(spark):
    docs = [(1, "alpha " * 300_000 + "beta"), (2, "alpha beta"), (3, "gamma")]
    items = [(1, "alpha beta beta"), (2, "beta " * 50_000)]
    assert _run(spark, docs, items) == brute(docs, items, 10)


def test_partial_sums_stay_exact_beyond_one_tile():
    """Weights whose sum passes 2^53 are cut into tiles whose products do not."""
    items = [(np.array([0, 1, 2]), np.array([1, 1, 1])), (np.array([1]), np.array([1]))]
    weights = np.array([7, 3 * (lexical.EXACT // lexical.IMPACT_BOUND) + 12345, 5], dtype=np.int64)
    blocks = lexical.Blocks(items, weights, 2, 2)
    for _, _, tiles in blocks.tiles:
        assert all(dense.sum(axis=1).max() * lexical.IMPACT_BOUND < lexical.EXACT for _, dense in tiles) and len(tiles) > 3
    values = np.array([999_999, 999_998, 999_997])
    (_, scores), = lexical.score_tile(blocks, 3, np.array([0, 3]), np.array([0, 1, 2]), values)
    assert scores.tolist() == [[int(sum(int(a) * int(b) for a, b in zip(weights, values)))], [int(weights[1]) * 999_998]]


def test_terms_are_the_matches_of_the_pattern():
    for text in ["", "A-b_C9é\x00x\x7fy\u0080z", "ÀÈ Ünï x", "a\tb\nc", "KK"]:
        assert [t.decode() for t in lexical.terms_of(text.encode())] == _terms(text)
