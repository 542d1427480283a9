from __future__ import annotations

import random
import re

import numpy as np
import pytest

from spendguard.llm import near_dedup, sketch
from spendguard.llm.queries import op5_near_dedup

SCHEMA = "doc_id long, text string"


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent=80):
    """(id, set size, component, kept) of each row; ids are the nodes."""
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    postings = {}
    for k, (i, s) in enumerate(sets):
        for x in s if i is not None else ():
            postings.setdefault(x, []).append(k)
    pairs = {(a, b) for p in postings.values() if len(p) < 400 for n, a in enumerate(p) for b in p[n + 1:]}
    for a, b in pairs:
        (i, s), (j, t) = sets[a], sets[b]
        if 100 * len(s & t) >= percent * len(s | t) and root(i) != root(j):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=key)


def key(r):
    return tuple((x is None, x) for x in r)


def run(spark, rows, schema=SCHEMA, **options):
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, schema), **options)
    return sorted((tuple(r) for r in out.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=key)


def near_copies(rng, n_bases, copies, words, edits):
    """Groups of texts of which some pairs are links and others nearly are."""
    rows = []
    for base in range(n_bases):
        text = [f"w{base}x{rng.randint(0, 400)}" for _ in range(words)]
        for _ in range(copies):
            own = list(text)
            for k in rng.sample(range(words), rng.randint(0, edits)):
                own[k] = f"e{rng.randint(0, 10 ** 6)}"
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 7)  # several cells a bucket
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 3)  # and the way beyond a broadcast
    rows = near_copies(random.Random(4), 4, 40, 60, 6)
    got = run(spark, rows, shingle_words=2)
    assert got == brute(rows, 2)
    assert 4 < len({r[2] for r in got}) < len(rows)


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "One two"), (7, "one  two"), (9, long), (8, long + " end"), (None, "one"), (None, None),
            (10, "É a b c"), (11, "é a b c"), (12, "x y"), (12, "x y"), (13, "p q r"), (13, "s t u"), (14, "s t u"), (15, "a\x1cb a\x1cb"), (16, "a b")]
    for width in (2, 5):
        assert run(spark, rows, shingle_words=width) == brute(rows, width)
    extra = [(*r, "z", 1) for r in rows]
    assert run(spark, extra, SCHEMA + ", rep string, kept int", shingle_words=2) == brute(rows, 2)
    assert run(spark, []) == []
    assert run(spark, [(1, ""), (2, None)]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_sketches_estimate_the_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 200, 5000):
        a = np.unique(rng.integers(0, 2 ** 63, 2 * n).astype(np.uint64))
        x, y = a[:int(1.5 * n)], a[int(0.5 * n):]
        assert (sketch.sketch(x, 160) == sketch.sketch(x[::-1].copy(), 160)).all()
        same = (sketch.sketch(x, 160) == sketch.sketch(y, 160)).mean()
        assert abs(same - len(np.intersect1d(x, y)) / len(a)) < 0.17
        assert (sketch.sketch(x, 160) < np.iinfo(np.uint64).max).all()


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 99), (99, 100), (7, 7)]
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}


@pytest.mark.parametrize("percent", [80])
def test_query(spark, percent):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op5_near_dedup(spark, sf).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=key)
    assert got == brute(rows, 2, percent)
