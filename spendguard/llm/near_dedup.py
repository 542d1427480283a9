"""Near-duplicate documents by MinHash with fast similarity sketching, banding and exact verification.

1. Every text becomes the set of its word shingles and a fast similarity sketch of it, whose bands are
   the keys of buckets. Equal sets are one class, represented by its smallest id.
2. In each bucket all representatives are verified against one hub on their full sets, and the
   links make components.
3. Pairs of a bucket that the hub did not decide (neither of them is the hub, and they are in
   different components) are verified in tiles: a cell holds a bounded number of sets, multiplies
   them, and returns a spanning forest of the links it finds. So no pair goes unverified, and
   neither pairs nor links of a group are ever listed in full.

A pair at the threshold shares no bucket with a probability of (1 - 0.8^5)^32 = 3e-6; more similar
pairs are missed less often. Every cut of the lineage is a checkpoint in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from . import sketch as sk
from .common import column, text_of

SHINGLE_WORDS, PERCENT = 5, 80
BANDS, ROWS = 32, 5
#: Sets of one kind of block in a cell, and ids that may be broadcast (16 bytes each).
TILE, BROADCAST_IDS = 1_024, 1_000_000
_COLUMNS = 2_048


def _sketches(batches: Iterator[pd.DataFrame], words: int, bands: int, rows: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for key, text in zip(batch["_id"], batch["_text"], strict=True):
            found = sk.shingles(text, words)
            if len(found):
                keys = sk.band_keys(sk.sketch(found, bands * rows), rows)
                out.append((key, len(found), xxhash.xxh3_128_digest(found.tobytes()), keys.view(np.int64).tolist()))
            else:
                out.append((key, 0, None, None))
        yield pd.DataFrame(out, columns=["_id", "_n", "_set", "_bands"])


def links_of_tile(ids: np.ndarray, groups: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], cross: bool, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different groups that join the groups to a forest; between the two
    blocks alone if ``cross``. Exact: the sizes of the intersections are products of 0/1 rows."""
    n = len(ids)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    member, value = np.repeat(np.arange(n), size), np.concatenate(sets)
    _, place, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    slot = np.full(len(count), -1)
    slot[shared] = np.arange(len(shared))
    at = slot[place]
    member, at = member[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    member, at = member[order], at[order]
    both = np.zeros((n, n), dtype=np.float64)
    for low in range(0, len(shared), _COLUMNS):
        a, b = np.searchsorted(at, [low, low + _COLUMNS])
        dense = np.zeros((n, _COLUMNS), dtype=np.float32)
        dense[member[a:b], at[a:b] - low] = 1
        both += dense @ dense.T
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    linked &= groups[:, None] != groups[None, :]
    if cross:
        linked &= blocks[:, None] != blocks[None, :]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = root(int(groups[i])), root(int(groups[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of the graph of ``a``, ``b``, for
    every node that has an edge. Large and small stars take turns until nothing changes, which takes
    a number of rounds that grows with the logarithm of the nodes."""
    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    # a is the larger node of an edge
    now = (edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint())
    seen = state(now)
    while True:
        ways = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = ways.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a")
        new = (small.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
               .unionByName(lower.select("a", F.col("m").alias("b"))).distinct().checkpoint())
        found = state(new)
        if found == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        now, seen = new, found


def _within(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the distinct ids, which are broadcast if they are counted to be few."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids.hint("merge"), key, "left_semi")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                    percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles``, ``component_id`` (the smallest id that
    links reach, its own included) and ``kept`` (whether that is its own id). Two documents are
    linked if their shingle sets share ``percent`` of their union or more.

    A null text, an empty one and one without words have no shingles and no links. A row without an
    id takes no part in links: its component is null and it is kept. Rows that share an id are one
    document, linked if any of their texts is; a repeated row is kept as often as it stands there.
    A text of any length is one set of its shingles. Ids are integers; other columns are ignored,
    and an empty table has no rows.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    texts = docs.select(column(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))

    # the id travels as text: a null next to numbers must not turn them into floats
    sketched = (texts.select(F.col("_id").cast("string").alias("_id"), "_text")
                .mapInPandas(lambda b: _sketches(b, shingle_words, bands, rows), "_id string, _n long, _set binary, _bands array<long>")
                .withColumn("_id", F.col("_id").cast("long")).checkpoint())
    # a class is a distinct set; its key is a hash of the set's 128-bit hash
    key_of = F.xxhash64("_set")
    classes = (sketched.where(F.col("_set").isNotNull() & F.col("_id").isNotNull())
               .groupBy("_set").agg(F.min(F.struct("_id", "_bands")).alias("r"))
               .select("_set", key_of.alias("key"), F.col("r._id").alias("rep"), F.col("r._bands").alias("bands")).checkpoint())

    members = classes.select("key", F.explode("bands").alias("bucket"))
    counted = members.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("key").alias("hub")).where(F.col("rows") > 1)
    shared = members.join(counted, "bucket").checkpoint()

    # the sets of classes that share a bucket; with what other rows of their ids hold, which no class key meets
    asked = classes.join(shared.select("key").distinct(), "key", "left_semi").select(F.col("rep").alias("_id")).distinct()

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sk.shingles(t, shingle_words) for t in batch["_text"]]
            yield pd.DataFrame({"rep": batch["_id"], "_set": [xxhash.xxh3_128_digest(x.tobytes()) for x in found], "elements": [x.view(np.int64) for x in found]})

    sets = (_within(texts.where(F.col("_id").isNotNull()), asked, "_id").mapInPandas(sets_of, "rep long, _set binary, elements array<long>")
            .select("rep", key_of.alias("key"), "elements").dropDuplicates(["rep", "key"])
            .join(classes.select("key", "rep"), ["key", "rep"], "left_semi").checkpoint())

    star = shared.where(F.col("key") != F.col("hub")).select("key", "hub").distinct()
    hubs = sets.select(F.col("key").alias("hub"), F.col("rep").alias("b"), F.col("elements").alias("hub_elements"))
    sizes = F.size("elements"), F.size("hub_elements")
    both = F.size(F.array_intersect("elements", "hub_elements"))
    links = (star.join(sets.withColumnRenamed("rep", "a"), "key").join(hubs, "hub")
             .where(100 * F.least(*sizes) >= percent * F.greatest(*sizes))
             .where(100 * both >= percent * (sizes[0] + sizes[1] - both)).select("a", "b"))
    groups = components(links).checkpoint()

    # buckets of which some pairs are open
    grouped = (classes.select("key", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
               .select("key", "rep", F.coalesce("component", "rep").alias("component")))
    rest = shared.where((F.col("key") != F.col("hub")) & (F.col("rows") > 2)).select("bucket", "key", "rows").join(grouped, "key")
    mixed = rest.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket").checkpoint()
    blocks = F.ceil((F.col("rows") - 1) / TILE).cast("int")
    # a bucket's rows are exploded where they are, not gathered by bucket first
    cells = (_within(rest, mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
             .select("bucket", "i", "j", "key", "rep", "component", "block").join(sets, ["key", "rep"]))

    def verify(cell: pd.DataFrame) -> pd.DataFrame:
        cross = bool((cell["i"] != cell["j"]).iloc[0])
        found = links_of_tile(cell["rep"].to_numpy(), cell["component"].to_numpy(), cell["block"].to_numpy(),
                              [np.asarray(s, dtype=np.int64) for s in cell["elements"]], cross, percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    late = cells.groupBy("bucket", "i", "j").applyInPandas(verify, "a long, b long").distinct().checkpoint()
    if not late.isEmpty():
        # the new links join components; nodes without a link so far are components of their own
        def named(side: str) -> DataFrame:
            return groups.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))

        joined = components(late.join(named("a"), "a", "left").join(named("b"), "b", "left")
                            .select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))).checkpoint()
        new = late.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(groups, "node", "left_anti")
        groups = (groups.unionByName(new.select("node", F.col("node").alias("component")))
                  .join(joined.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left")
                  .select("node", F.coalesce("_to", "component").alias("component")).checkpoint())

    of_set = (classes.select("_set", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
              .select("_set", F.coalesce("component", "rep").alias("_component")))
    rows_of = sketched.select("_id", "_n", "_set")
    alone = rows_of.where(F.col("_set").isNull()).select("_id", "_n", F.col("_id").alias("_component"))
    # a document without an id meets its class as well, but has no component
    found = rows_of.where(F.col("_set").isNotNull()).join(of_set, "_set", "left").select(
        "_id", "_n", F.when(F.col("_id").isNotNull(), F.col("_component")).alias("_component"))
    return found.unionByName(alone).select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"),
        F.coalesce(F.col("_id") == F.col("_component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that are not kept; of rows that share an id the least remains
    (in the order of the columns)."""
    near = near_duplicates(docs, id_col=id_col, **options).checkpoint()
    known = near.where(column(id_col).isNotNull())
    rows = _without(docs, known.where(~F.col("kept")).select(id_col).distinct(), id_col)
    repeated = known.where("kept").groupBy(column(id_col)).agg(F.count("*").alias("_rows")).where("_rows > 1").select(id_col).checkpoint()
    if repeated.isEmpty():
        return rows
    names = docs.columns
    one = (_within(rows, repeated, id_col).groupBy(column(id_col).alias("_key"))
           .agg(F.min(F.struct(*map(column, names))).alias("_row")).select(*(F.col("_row")[n].alias(n) for n in names)))
    return _without(rows, repeated, id_col).unionByName(one)


def _without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among the distinct ids."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids.hint("merge"), key, "left_anti")
