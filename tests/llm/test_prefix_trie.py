from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spendguard.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, text[:32], hashlib.sha256(text.encode()).hexdigest(), text))
    own = {c: [(t[2], t[5]) for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def brute(rows):
    """Every prefix as a node, by definition."""
    convs = rebuilt(rows)
    members = defaultdict(list)
    members[()] = []
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.append((min(m, default=None), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def _conversations(seed, n=60, span=400, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(span), n):
        turns = [(c, k, rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "no", "ünï"])) for k in range(rng.randint(1, longest))]
        rows += turns
    copies = sorted({r[0] for r in rows})[:3]
    for k in range(12):  # equal conversations, and one that is another's prefix
        rows += [(span + 100 * k + 7, t, r, x) for c, t, r, x in rows if c == copies[k % 3]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, options", [(1, {}), (2, dict(broadcast_nodes=0))])
def test_nodes_as_by_definition(spark, seed, options):
    rows = _conversations(seed)
    assert found(prefix_trie.trie(spark.createDataFrame(rows, TURNS).repartition(3), **options)) == brute(rows)


def test_odd_rows(spark):
    """Null turns, roles, texts and ids, repeated turns and rows, negative ids, a turnless conversation."""
    rows = [(0, 0, "user", "a"), (0, None, None, "first"), (0, None, "user", None), (0, 0, "user", "a"), (0, 0, "assistant", "b" * 40 + "1"), (0, 0, "assistant", "b" * 40 + "0")]
    rows += [(None, 0, "user", "lost"), (-3, 0, "user", "a"), (-205, 1, "user", "a"), (-205, 0, "user", "c")]
    lonely = [c for c in range(300, 900) if zlib.crc32(str(c).encode()) % 6 == 5 and c % 100][:2]
    rows += [(c, 0, "user", "a") for c in lonely]  # nothing is left of them
    rows = [(*r, 1, "x") for r in rows]
    turns = spark.createDataFrame(rows, TURNS + ", d long, node string")
    assert found(prefix_trie.trie(turns)) == brute([r[:4] for r in rows])


def test_empty_table(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert found(prefix_trie.trie(spark.createDataFrame([], TURNS))) == [(None, 0, None, 0, 0, 1, 0, empty)]


def test_one_conversation_over_many_ranges(spark):
    """A long conversation, others that leave it at many depths, and one text that is very long."""
    rng = random.Random(5)
    base = [(0, k, "user", f"t{rng.randint(0, 3)}") for k in range(700)]
    base[3] = (0, 3, "user", "long " * 50_000)
    rows = list(base)
    late = [c for c in range(1000, 9000, 100) if c % 100 == 0][:25]
    for c in late:
        cut = rng.randint(1, 690)
        rows += [(c, t, r, x) for _, t, r, x in base[:cut]] + [(c, 10_000 + k, "user", f"z{c}") for k in range(rng.randint(0, 3))]
    turns = spark.createDataFrame(rows, TURNS).repartition(6)
    assert found(prefix_trie.trie(turns)) == brute(rows)


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 20) for b in range(a + 1, 40)] + [(2 ** 40 - 1, 2 ** 40 + 5), (0, 2 ** 50 + 3)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", prefix_trie.two_fattest(F.col("a"), F.col("b")).alias("f"))
    for a, b, f in df.collect():
        assert a < f <= b and (b - a > 100 or f == max(range(a + 1, b + 1), key=lambda x: x & -x))


def test_ends_hash_streams_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    ids = {1: list(range(-5, 500)), 2: [3], 3: [10 ** 15, 9]}
    df = spark.createDataFrame([(n, c) for n, v in ids.items() for c in v], "node long, conv long").repartition(4)
    got = {r.node: r.sha for r in prefix_trie.ends_hash(df).collect()}
    assert got == {n: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for n, v in ids.items()}
