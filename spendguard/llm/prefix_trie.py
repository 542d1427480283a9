"""Prefix trie of conversations as a Z-fast trie whose nodes are rows of a table.

A conversation is a string of turns, and a prefix is known by its length and a 122-bit hash. The hash
is a polynomial in the turns, so it is summed up over ranges of a long conversation in parallel. Paths
without a branch or an end are one compacted node, which covers the depths (a, g] and is stored under
its handle: the hash of its prefix at the two-fattest depth in (a, g], the multiple of the largest
power of two.

Conversations are inserted in batches. In each round

1. every pending conversation finds the deepest node whose whole extent is a prefix of it by fat binary
   search: it probes the handle at the two-fattest depth of what is left of its range, and the range
   goes on behind the node that it finds, or before the depth where there is none;
2. the edge on which it leaves that node, its exit node, is looked up by the hash one turn further, and
   the length of what both share is measured;
3. all exit nodes are split at all these places at once; of the conversations that go on from a place
   with the same turn the smallest is the round's leader and becomes a leaf with all the rest of its
   path, and the others are pending in the next round, from there on.

Rounds end when none is pending: equal conversations end at their leader's node in the next one. At
last members, children and sums are added up along the compacted paths and the edges are expanded to
one row per depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import column, text_of

#: Prime of the hashes, and the two points at which the polynomials are evaluated.
PRIME = (1 << 61) - 1
POINTS = (1_220_703_125_000_003, 762_939_453_125_017)
#: Rebuilding: conversations of one hundred share the first turns of the first one, fewer than so many.
GROUP, MOST_SHARED = 100, 6
#: Rows (nodes, or conversations that are searched for) that may be broadcast, about 150 bytes each;
#: and rows of a written table that one task reads.
BROADCAST_NODES, TASK_ROWS = 200_000, 20_000
#: Turns of one number are ordered by role, by so many characters of text, and by the text's hash.
TIE_CHARS = 32
#: Ids that are joined into one text on their way to a hash.
CHUNK_IDS = 4_096

_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _power(k: int, e: int) -> int:
    return pow(POINTS[k], e, PRIME)


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the largest power of two divides."""
    bits = (F.length(F.bin(low.bitwiseXOR(high))) - 1).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits)


# --- hashes of prefixes ----------------------------------------------------------------------------

_PREFIX = "_range int, conv long, d long, h1 long, h2 long, c long"


def _prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers, hashes and lengths of the prefixes within one sorted range of turns."""
    conv, d, h1, h2, c, p1, p2 = None, 0, 0, 0, 0, 1, 1
    for batch in batches:
        out = []
        for pid, key, s1, s2, n in zip(batch["_range"].tolist(), batch["conv"].tolist(), batch["s1"].tolist(), batch["s2"].tolist(), batch["n"].tolist(), strict=True):
            if key != conv:
                conv, d, h1, h2, c, p1, p2 = key, 0, 0, 0, 0, 1, 1
            d, c = d + 1, c + n
            p1, p2 = p1 * POINTS[0] % PRIME, p2 * POINTS[1] % PRIME
            h1, h2 = (h1 + s1 * p1) % PRIME, (h2 + s2 * p2) % PRIME
            out.append((pid, key, d, h1, h2, c))
        yield pd.DataFrame(out, columns=["_range", "conv", "d", "h1", "h2", "c"])


def _carried(carry: dict[tuple[int, int], tuple[int, int, int, int]]):
    """A function that adds to each prefix what the earlier ranges hold of its conversation."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pid, key, d, h1, h2, c in batch.itertuples(index=False, name=None):
                if (pid, key) in carry:
                    n, b1, b2, bc = carry[pid, key]
                    d, c = d + n, c + bc
                    h1, h2 = (b1 + _power(0, n) * h1) % PRIME, (b2 + _power(1, n) * h2) % PRIME
                out.append((key, d, h1, h2, c))
            yield pd.DataFrame(out, columns=["conv", "d", "h1", "h2", "c"])
    return run


def prefixes(turns: DataFrame, *, conversation_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv``, ``d``, ``h1``, ``h2``, ``c`` for every prefix of ``d`` > 0 turns: its two hashes and
    its code points. Ranges of turns are sorted and summed on their own; of each range one row, its
    last conversation's sums, goes to the driver."""
    role = text_of(role_col)
    text = text_of(text_col)
    rows = turns.where(column(conversation_col).isNotNull()).select(
        column(conversation_col).cast("long").alias("conv"), column(turn_col).alias("t"), role.alias("r"),
        F.substring(text, 1, TIE_CHARS).alias("x"), F.sha2(text.cast("binary"), 256).alias("y"),
        *(F.pmod(F.xxhash64(F.lit(k), role, text), F.lit(PRIME)).alias(f"s{k}") for k in (1, 2)),
        F.char_length(text).cast("long").alias("n"), F.monotonically_increasing_id().alias("z"))
    order = ["conv", F.col("t").asc_nulls_first(), "r", "x", "y", "z"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("_range"), "conv", "s1", "s2", "n")
    local = sorted_.mapInPandas(_prefixes, _PREFIX).checkpoint()
    edges = local.groupBy("_range").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "d", "h1", "h2", "c")).alias("last")).orderBy("_range").collect()
    carry: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    before = None  # the conversation that the range before ended with, and its sums
    for e in edges:
        key, n, h1, h2, c = e["last"]
        if before and before[0] == e["first"]:
            carry[e["_range"], e["first"]] = before[1:]
            if e["first"] == key:
                m, b1, b2, bc = before[1:]
                n, h1, h2, c = n + m, (b1 + _power(0, m) * h1) % PRIME, (b2 + _power(1, m) * h2) % PRIME, c + bc
        before = (key, n, h1, h2, c)
    return local.mapInPandas(_carried(carry), "conv long, d long, h1 long, h2 long, c long")


def shared_turns(conv: Column) -> Column:
    """Turns that a conversation takes from the first one of its hundred."""
    return F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED


def rebuilt(own: DataFrame) -> DataFrame:
    """The prefixes, from depth 0 on, of the rebuilt conversations: the first turns of another one
    and then the own ones behind as many. Hashes are linear in the turns, so a row's new hash follows
    from its old one and from those at the two seams."""
    few = own.where(F.col("d") < MOST_SHARED).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("d", "h1", "h2", "c"))).alias("few"))  # < 6 rows each
    sizes = own.groupBy("conv").agg(F.max("d").alias("n")).join(few, "conv")
    h, base = shared_turns(F.col("conv")), F.col("conv") - F.col("conv") % GROUP
    nothing = F.struct(*(F.lit(0).cast("long").alias(x) for x in ("d", "h1", "h2", "c")))
    info = (sizes.select("conv", "n", "few", h.alias("h"), base.alias("base"))
            .join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"), F.col("few").alias("base_few")), "base", "left")
            .withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
            .withColumn("into", F.coalesce(F.get("base_few", F.col("k").cast("int") - 1), nothing))
            .withColumn("from", F.coalesce(F.get("few", F.least("h", "n").cast("int") - 1), nothing)))
    taken = info.where("k > 0").select("conv", F.explode(F.slice("base_few", 1, F.col("k").cast("int"))).alias("p")).select("conv", "p.*")

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift = [[_power(k, -e) for e in range(MOST_SHARED)] for k in (0, 1)]
        for batch in batches:
            out = []
            for conv, d, h1, h2, c, kept, skipped, i1, i2, ic, f1, f2, fc in batch.itertuples(index=False, name=None):
                e = skipped - kept
                out.append((conv, d - e, (i1 + (h1 - f1) * shift[0][e]) % PRIME, (i2 + (h2 - f2) * shift[1][e]) % PRIME, ic + c - fc))
            yield pd.DataFrame(out, columns=["conv", "d", "h1", "h2", "c"])

    seams = info.select("conv", "k", "h", *(F.col("into")[x].alias(f"i_{x}") for x in ("h1", "h2", "c")), *(F.col("from")[x].alias(f"f_{x}") for x in ("h1", "h2", "c")))
    rest = own.join(seams, "conv").where(F.col("d") > F.col("h")).mapInPandas(moved, "conv long, d long, h1 long, h2 long, c long")
    roots = sizes.select("conv", *(F.lit(0).cast("long").alias(x) for x in ("d", "h1", "h2", "c")))
    return roots.unionByName(taken).unionByName(rest)


# --- the trie --------------------------------------------------------------------------------------

_NODE = ("a", "a1", "a2", "g", "e1", "e2", "n1", "n2", "f", "f1", "f2", "c_a", "c_g", "rep")


def _written(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows in the checkpoint folder, read by as many tasks as they need, and their number."""
    df = df.checkpoint()
    n = df.count()
    return df.coalesce(max(1, -(-n // TASK_ROWS))), n


def _hashes(prefix: DataFrame, conv: str, depth: str, *names: str) -> DataFrame:
    return prefix.select(F.col("conv").alias(conv), F.col("d").alias(depth), *(F.col(x).alias(n) for x, n in zip(("h1", "h2", "c"), names)))


def _look(rows: DataFrame, prefix: DataFrame, conv: str, depth: str, *names: str, small: bool) -> DataFrame:
    """``rows`` with the hashes (and the code points) of the prefix of ``conv`` at ``depth``. Few rows are
    sent to the prefixes; many meet them in a shuffle by conversation and depth."""
    table = _hashes(prefix, conv, depth, *names)
    return table.join(F.broadcast(rows), [conv, depth]) if small else rows.join(table, [conv, depth])


def _walk(rows: DataFrame, prefix: DataFrame, first: Column, last: Column, *names: str, small: bool) -> DataFrame:
    """``rows`` with the prefixes of ``rep`` at every depth ``d`` from ``first`` to ``last``."""
    table = _hashes(prefix, "rep", "d", *names)
    if small:
        return table.join(F.broadcast(rows), "rep").where((F.col("d") >= first) & (F.col("d") <= last))
    return rows.where(first <= last).withColumn("d", F.explode(F.sequence(first, last))).join(table, ["rep", "d"])


def _nodes(edges: DataFrame, prefix: DataFrame, small: bool) -> DataFrame:
    """Nodes for the edges (``rep``, ``a``, ``g``): the hashes and lengths at both ends, the hash one turn
    behind the upper end and the one at the handle."""
    edges = edges.withColumn("f", two_fattest(F.col("a"), F.col("g")))
    wanted = edges.select("rep", "a", "g", "f", F.explode(F.array(
        *(F.struct(F.lit(i).alias("i"), x.alias("d")) for i, x in enumerate((F.col("a"), F.col("g"), F.col("a") + 1, F.col("f")))))).alias("w"))
    found = _look(wanted.select("rep", "a", "g", "f", "w.*"), prefix, "rep", "d", "h1", "h2", "c", small=small)
    sums = [F.max(F.when(F.col("i") == i, F.col(f"h{k}"))).alias(f"{x}{k}") for i, x in enumerate("aenf") for k in (1, 2)]
    sums += [F.max(F.when(F.col("i") == i, F.col("c"))).alias(x) for i, x in enumerate(("c_a", "c_g"))]
    return found.groupBy("rep", "a", "g", "f").agg(*sums).select(*_NODE)


def _search(pending: DataFrame, nodes: DataFrame, prefix: DataFrame, rounds: int, small: bool) -> DataFrame:
    """Fat binary search of all ``pending`` (``conv``, ``size``, ``low``: depth of a node on its
    path) at once: ``low`` becomes the depth of the deepest node whose extent is on its path.

    A handle on the path of a node says that the path reaches into its edge. Whether it has the whole of
    it is looked up at the end, for the last such node alone: a later one behind it proves it.
    """
    handles = nodes.select("f", "f1", "f2", F.col("a").alias("_a"), F.col("g").alias("_g"))
    now = pending.select("conv", "size", "low", F.col("size").alias("high"), F.lit(None).cast("long").alias("before"))
    for k in range(rounds):
        # depth 0, where no handle is, for those that are done
        now = now.withColumn("f", F.when(F.col("low") < F.col("high"), two_fattest(F.col("low"), F.col("high"))).otherwise(0))
        now = _look(now, prefix, "conv", "f", "f1", "f2", small=small).join(handles, ["f", "f1", "f2"], "left")
        found = F.col("_g").isNotNull()
        inside = found & (F.col("_g") <= F.col("size"))
        low = F.when(inside, F.col("_g")).when(found, F.col("_a")).otherwise(F.col("low"))
        high = F.when(inside, F.greatest("high", "_g")).when(found, F.col("_a")).when(F.col("f") > 0, F.col("f") - 1).otherwise(F.col("high"))
        now = now.select("conv", "size", low.alias("low"), high.alias("high"), F.when(inside, F.col("_a")).when(found, F.lit(None)).otherwise(F.col("before")).alias("before"))
        if k % 4 == 3:
            now, _ = _written(now)
    extents = nodes.select(F.col("g").alias("low"), F.col("e1").alias("x1"), F.col("e2").alias("x2"), F.lit(True).alias("whole"))
    now = _look(now, prefix, "conv", "low", "x1", "x2", small=small).join(extents, ["low", "x1", "x2"], "left")
    return now.select("conv", "size", F.when(F.col("whole") | F.col("before").isNull(), F.col("low")).otherwise(F.col("before")).alias("low"))


def build(ends: DataFrame, prefix: DataFrame, broadcast_nodes: int = BROADCAST_NODES) -> tuple[DataFrame, int]:
    """The compacted nodes, without the root, and their number, of the conversations ``ends`` (``conv``,
    ``size``) with the prefixes ``prefix``. Every end of a conversation is the lower end of a node."""
    spark = prefix.sparkSession
    nodes, n_nodes = spark.createDataFrame([], ", ".join(f"{x} long" for x in _NODE)), 0
    pending, n = _written(ends.where("size > 0").select("conv", "size", F.lit(0).cast("long").alias("low")))
    rounds = (pending.agg(F.max("size")).first()[0] or 0).bit_length()
    while n:
        few, small = n <= broadcast_nodes, n_nodes <= broadcast_nodes
        table = F.broadcast(nodes) if small else nodes
        found = _search(pending, table, prefix, rounds, few) if n_nodes else pending
        out = _look(found.where("low < size").withColumn("next", F.col("low") + 1), prefix, "conv", "next", "n1", "n2", small=few)
        edge = nodes.select(F.col("a").alias("low"), "n1", "n2", "g", "rep")
        out, _ = _written(out.join(F.broadcast(edge) if small else edge, ["low", "n1", "n2"], "left"))
        leaving = out.where(F.col("rep").isNull()).select("conv", "size", F.col("low").alias("m"), "n1", "n2")
        on_edge = out.where(F.col("rep").isNotNull()).select("conv", "size", "low", "g", F.col("rep"))
        # what a conversation shares with its exit node's path
        mine = _walk(on_edge.select(F.col("conv").alias("rep"), F.col("rep").alias("other"), "size", "low", "g"), prefix,
                     F.col("low") + 1, F.least("g", "size"), "x1", "x2", small=few).withColumnsRenamed({"rep": "conv", "other": "rep"})
        both = mine.join(_hashes(prefix, "rep", "d", "x1", "x2"), ["rep", "d", "x1", "x2"])
        shared, _ = _written(both.groupBy("conv", "size", "low", "g", "rep").agg(F.max("d").alias("m")))
        cuts = shared.where("m < g").select("low", "g", "rep", "m").distinct()
        gone = cuts.select(F.col("low").alias("a"), "g", "rep").distinct()  # no more rows than conversations are pending
        old = nodes.join(F.broadcast(gone) if few else gone, ["a", "g", "rep"], "left_anti")
        places = cuts.unionByName(cuts.select("low", "g", "rep", F.col("g").alias("m")).distinct())
        # as many as different conversations leave one edge at different depths
        order = Window.partitionBy("low", "g", "rep").orderBy("m")
        pieces = places.select("rep", F.coalesce(F.lag("m").over(order), F.col("low")).alias("a"), F.col("m").alias("g"))
        beyond = _look(shared.where("m < size").withColumn("next", F.col("m") + 1), prefix, "conv", "next", "n1", "n2", small=few)
        going, _ = _written(leaving.unionByName(beyond.select("conv", "size", "m", "n1", "n2")))
        leaders = going.groupBy("m", "n1", "n2").agg(F.min(F.struct("conv", "size")).alias("leader"))
        leaves = leaders.select(F.col("leader.conv").alias("rep"), F.col("m").alias("a"), F.col("leader.size").alias("g"))
        first = leaders.select(F.col("leader.conv").alias("conv"))
        pending, n = _written(going.join(F.broadcast(first) if few else first, "conv", "left_anti").select("conv", "size", F.col("m").alias("low")))
        nodes, n_nodes = _written(old.unionByName(_nodes(pieces.unionByName(leaves), prefix, few)))
    return nodes, n_nodes


# --- rows of the trie ------------------------------------------------------------------------------

def _joined_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        nodes, convs = batch["node"].tolist(), batch["conv"].tolist()
        out, start = [], 0
        for k in range(1, len(nodes) + 1):
            if k == len(nodes) or nodes[k] != nodes[start] or k - start == CHUNK_IDS:
                out.append((nodes[start], convs[start], ",".join(map(str, convs[start:k]))))
                start = k
        yield pd.DataFrame(out, columns=["node", "first", "ids"])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's chunks, which follow each other: a running hash, whatever their number."""
    node, digest = None, None
    for batch in batches:
        out = []
        for key, ids in zip(batch["node"].tolist(), batch["ids"], strict=True):
            if key != node:
                if digest is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["node", "sha"])
    if digest is not None:
        yield pd.DataFrame([(node, digest.hexdigest())], columns=["node", "sha"])


def ends_hash(ends: DataFrame) -> DataFrame:
    """``node`` and ``sha``, the hash of the ascending ids ``conv`` that end there. Sorted ranges join
    their ids to chunks first, so the one task that a node's hash needs reads a row per chunk."""
    chunks = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInPandas(_joined_ids, "node long, first long, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInPandas(_hashed, "node long, sha string")


def trie(turns: DataFrame, *, conversation_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
         broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    A null role or text is empty; equal roles and texts are equal turns. A null turn comes first;
    turns of one number follow each other by role, by the first characters of the text and by the
    text's hash, and repeated rows are repeated turns. Rows without a conversation id belong to no
    conversation; ids are integers (the first one of a hundred is rounded towards 0). A conversation of
    any length is spread over tasks, and a text's length matters to its hash alone. Other columns are
    ignored. An empty table has the root alone, with no members and no smallest one.
    """
    spark = turns.sparkSession
    checkpoint_dir(spark)
    own, _ = _written(prefixes(turns, conversation_col=conversation_col, turn_col=turn_col, role_col=role_col, text_col=text_col))
    prefix, _ = _written(rebuilt(own))
    # the longest prefix of a conversation is all of it
    whole = prefix.groupBy("conv").agg(F.max(F.struct("d", "h1", "h2")).alias("end")).select("conv", F.col("end.d").alias("size"), "end.h1", "end.h2")
    whole, n_convs = _written(whole)
    nodes, n_nodes = build(whole.select("conv", "size"), prefix, broadcast_nodes)
    small = n_nodes <= broadcast_nodes
    few = F.broadcast if small else (lambda df: df)  # tables of a row per node
    nodes, _ = _written(nodes.withColumn("node", F.monotonically_increasing_id()))

    # ends of conversations, at the node of that extent; at the root (-1) those without a turn
    root = F.lit(-1).cast("long")
    extents = nodes.select(F.col("g").alias("size"), F.col("e1").alias("h1"), F.col("e2").alias("h2"), "node")
    ends, _ = _written(whole.join(few(extents), ["size", "h1", "h2"], "left").select("conv", F.when(F.col("size") == 0, root).otherwise(F.col("node")).alias("node")))
    ending = ends.groupBy("node").agg(F.count("*").alias("n_ends"), F.min("conv").alias("least"))
    up = extents.select(F.col("size").alias("a"), F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("node").alias("up"))
    edges = nodes.join(few(up), ["a", "a1", "a2"], "left").select("node", "rep", "a", "g", F.coalesce("up", root).alias("up"), "c_a", "c_g")
    below = edges.groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_below"))
    edges, _ = _written(edges.join(few(below), "node", "left").join(few(ending), "node", "left")
                        .select("node", "rep", "a", "g", "up", "c_a", "c_g", F.coalesce("n_below", F.lit(0)).alias("n_below"), F.coalesce("n_ends", F.lit(0)).alias("n_ends"), "least"))

    # each node with the nodes on its path, itself included: no more rows than the conversations have turns
    path = _walk(edges.select("node", "rep", "g"), prefix, F.lit(1).cast("long"), F.col("g"), "h1", "h2", small=small).select("node", F.col("d").alias("size"), "h1", "h2")
    path, _ = _written(path.join(few(extents.withColumnRenamed("node", "over")), ["size", "h1", "h2"]).select("node", "over"))
    facts = edges.select("node", "n_ends", "least", (F.col("n_below") == 0).cast("long").alias("leaf"))
    counts, _ = _written(path.join(few(facts), "node").groupBy(F.col("over").alias("node")).agg(
        F.sum("n_ends").alias("n_convs"), F.min("least").alias("conv_id"), F.sum("leaf").alias("n_leaves")))
    weights = edges.join(few(counts.select("node", "n_convs")), "node").select("node", ((F.col("n_convs") - 1) * (F.col("c_g") - F.col("c_a"))).alias("saved"))
    saved = path.where(F.col("node") != F.col("over")).join(few(weights), "node").groupBy(F.col("over").alias("node")).agg(F.sum("saved").alias("saved_below"))
    hashes, _ = _written(ends_hash(ends))

    # one row each
    least = whole.agg(F.min("conv")).first()[0]
    tops = edges.agg(F.count_if(F.col("up") == root).alias("children"), F.count_if(F.col("n_below") == 0).alias("leaves")).first()
    total = weights.agg(F.sum("saved")).first()[0] or 0
    own_sha = hashes.where(F.col("node") == -1).select("sha").first()
    top = spark.createDataFrame([(least, 0, None, n_convs, tops["children"], tops["leaves"] or 1, total, own_sha["sha"] if own_sha else _EMPTY_SHA)],
                                "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    nothing = F.lit(_EMPTY_SHA)
    above = counts.select(F.col("node").alias("up"), F.col("conv_id").alias("up_conv"))
    done = (edges.drop("n_ends", "least").join(few(counts), "node").join(few(saved), "node", "left").join(few(hashes), "node", "left").join(few(above), "up", "left")
            .withColumn("up_conv", F.when(F.col("up") == root, F.lit(least).cast("long")).otherwise(F.col("up_conv"))))
    # a row per depth: the prefix before it tells what its text adds
    rows = _walk(done, prefix, F.col("a"), F.col("g") - 1, "_1", "_2", "c_before", small=small).withColumn("depth", F.col("d") + 1)
    last = F.col("depth") == F.col("g")
    return rows.select(
        "conv_id", "depth", F.when(F.col("d") == F.col("a"), F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_below")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (F.coalesce("saved_below", F.lit(0)) + (F.col("n_convs") - 1) * (F.col("c_g") - F.col("c_before"))).cast("long").alias("saved_tokens"),
        F.when(last, F.coalesce("sha", nothing)).otherwise(nothing).alias("ends_sha256")).unionByName(top)


_CRC = ("xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), "
        "lambda c, x: list_reduce(range(8), lambda b, i: xor(b >> 1, 3988292384 * (b & 1)), xor(c, x)), CAST(4294967295 AS BIGINT)))")
#: The same rows in DuckDB: every prefix as the text of its turns' hashes.
SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), {TIE_CHARS}), sha256(coalesce(text, ''))) AS j
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {_CRC} % {MOST_SHARED} AS h FROM (SELECT DISTINCT conv_id FROM turns)),
starts AS (SELECT c.conv_id, b.j AS d, b.role, b.text FROM convs c JOIN turns b ON b.conv_id = c.base AND b.j <= c.h),
taken AS (SELECT conv_id, count(*) AS k FROM starts GROUP BY conv_id),
rebuilt AS (
  SELECT * FROM starts
  UNION ALL
  SELECT t.conv_id, coalesce(k, 0) + j - h, role, text FROM turns t JOIN convs c USING (conv_id) LEFT JOIN taken USING (conv_id) WHERE j > h
),
paths AS (
  SELECT conv_id, length(text) AS n, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, '' FROM convs
),
nodes AS (SELECT path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM paths GROUP BY path),
ends AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(path, length(path)) AS path FROM paths GROUP BY conv_id) GROUP BY path),
children AS (SELECT left(path, greatest(length(path) - 64, 0)) AS path, count(*) AS n_children FROM nodes WHERE path <> '' GROUP BY 1),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
above AS (SELECT unnest(list_transform(range(length(path) // 64 + 1), lambda k: left(path, k * 64))) AS path, n_children = 0 AS leaf, (n_convs - 1) * n AS saved FROM counted),
sums AS (SELECT path, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved) AS saved FROM above GROUP BY path)
SELECT c.conv_id, CAST(length(c.path) // 64 AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM counted c JOIN sums s ON s.path = c.path LEFT JOIN ends e ON e.path = c.path
LEFT JOIN nodes p ON c.path <> '' AND p.path = left(c.path, greatest(length(c.path) - 64, 0))"""
