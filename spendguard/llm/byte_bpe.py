"""Byte-level BPE encoding and decoding with overlapping chunks.

A text longer than one chunk is cut into chunks that overlap. The chunks are pre-tokenised in
parallel, each from its own start. Two neighbours are stitched at a place in their overlap where
both have a pre-token boundary: what the pattern matches from a position on depends only on the
text from there on, so from a common boundary on both chunks see the same pre-tokens. The pieces
between the stitches are then encoded in parallel, and a document's ids are the pieces' ids in
order. Decoding joins the raw bytes of the ids.

Only texts of more than one chunk are shuffled; a text within one chunk needs no stitch and is
encoded where it is read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, text_of

#: Code points of a chunk, and by how many it reaches into the next one.
CHUNK_CHARS, OVERLAP_CHARS = 65_536, 2_048
#: A match that ends closer than this to a chunk's end may go on (or look) beyond it.
_UNSURE = 4
#: Separators that Python's classes call white space and the encoder's do not, as another such character.
_NOT_SPACE = {c: "!" for c in range(0x1C, 0x20)}
#: White space as the encoder's classes have it, and a run of it that is encoded on its own.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{_WHITE}]{{2048,}}")


@lru_cache(maxsize=4)
def _encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _token_bytes(ranks_path: str) -> dict[int, bytes]:
    with open(ranks_path, "rb") as lines:
        return {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def _white_first(pattern: str) -> bool:
    """Whether the pattern's matches hold white space in front at most, and take of a run of it all but
    the last character, or all of it at the end of a text. Found by trying it on short runs."""
    import regex

    find = regex.compile(pattern).findall
    runs = [a * 5 for a in (" ", "\n", "\t", "\u3000", " \n", "\r\n\t", "\u00a0 ")]
    return all("".join(find(f"{x}{run}{y}")) == f"{x}{run}{y}" and find(f"{x}{run}")[-1] == run and find(f"{run}{y}")[0] == run[:-1]
               and run[:-1] in find(f"{x}{run}{y}") for run in runs for x in ("a", "1", "!", "'", "é") for y in ("b", "2", "?", "'s", "日"))


def encode_text(text: str, ranks_path: str, pattern: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers.

    A long run of white space is a single match but for its last character, and finding that match
    overflows the stack of the library's matcher. Such a run is cut out and its match is encoded on its own.
    """
    encoding = _encoding(ranks_path, pattern)
    ids: list[int] = []
    at = 0
    for run in _LONG_RUN.finditer(text) if _white_first(pattern) else ():
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += encoding.encode_ordinary(text[at:run.start()])
        ids += run_ids(text[run.start():end], encoding)
        at = end
    ids += encoding.encode_ordinary(text[at:] if at else text)
    return np.array(ids, dtype="<u4").tobytes()


def run_ids(run: str, encoding) -> list[int]:
    """Ids of a run of white space that is one match."""
    return encoding._encode_single_piece(run)


def boundaries(text: str, pattern: str, low: int, high: int, whole: bool) -> list[int]:
    """Ends of pre-tokens in [low, high] at which a neighbour may be stitched. The character before
    must not be white space, so that the piece before it is matched alike when it stands alone.
    Ends that text beyond ``text`` could change are left out unless it is ``whole``."""
    import regex

    text = text.translate(_NOT_SPACE)
    sure = len(text) if whole else len(text) - _UNSURE
    return [e for m in regex.finditer(pattern, text)
            if low <= (e := m.end()) <= min(high, sure) and not text[e - 1].isspace()]


def sure_boundaries(text: str, pattern: str, ends: list[int]) -> list[int]:
    """Those of the ends that are boundaries whatever stands before: white space follows, and no match
    goes from another character into white space."""
    return [e for e in ends if e < len(text) and text[e].isspace() and text[e] not in "\x1c\x1d\x1e\x1f"] if _white_first(pattern) else []


def _chunks(batches: Iterator[pd.DataFrame], size: int, overlap: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row, key, text in zip(batch["_n"], batch["_key"], batch["_text"], strict=True):
            n = -(-len(text) // size)
            for k in range(n):
                yield pd.DataFrame({"_n": [row], "_key": [key], "_chunk": [k], "_last": [k == n - 1],
                                    "_text": [text[k * size:(k + 1) * size + overlap]]})


def _check_sizes(chunk_chars: int, overlap_chars: int) -> None:
    if not 0 < overlap_chars <= chunk_chars:
        raise ValueError("0 < overlap_chars <= chunk_chars")


def pieces_of(beyond: DataFrame, pattern: str, size: int, overlap: int) -> DataFrame:
    """``_n``, ``_key``, ``_piece`` and ``_text``: the texts of ``beyond`` (``_n``, ``_key``, ``_text``)
    cut at boundaries of pre-tokens that neighbouring chunks share."""
    @F.pandas_udf("head array<int>, tail array<int>, sure array<int>")
    def pretokenise(text: pd.Series, last: pd.Series) -> pd.DataFrame:
        """Boundaries in the overlaps with the chunk before and the chunk after, both counted from
        the start of the overlap."""
        out = []
        for t, is_last in zip(text, last, strict=True):
            head = [] if len(t) == 0 else boundaries(t[:min(len(t), overlap)], pattern, 1, overlap, is_last and len(t) <= overlap)
            tail = [] if is_last else boundaries(t, pattern, size + 1, size + overlap, False)
            sure = sure_boundaries(t, pattern, tail)
            out.append((head, [e - size for e in tail], [e - size for e in sure]))
        return pd.DataFrame(out, columns=["head", "tail", "sure"])

    chunks = (beyond.mapInPandas(lambda b: _chunks(b, size, overlap), "_n long, _key string, _chunk long, _last boolean, _text string")
              .repartition("_n", "_key", "_chunk")
              .withColumn("_at", pretokenise("_text", "_last")))
    in_order = Window.partitionBy("_n", "_key").orderBy("_chunk")
    heads = F.lead("_at.head").over(in_order)
    stitched = (chunks
                .withColumn("_sure", F.when(~F.col("_last"), F.array_min(F.array_intersect(F.col("_at.sure"), heads))))
                .withColumn("_to", F.when(~F.col("_last"), F.coalesce("_sure", F.array_min(F.array_intersect(F.col("_at.tail"), heads)))))
                .withColumn("_from", F.lag("_to").over(in_order))
                # without a stitch a chunk's own boundaries are in doubt, and stay so up to the next one that is sure in itself
                .withColumn("_event", F.when(F.col("_chunk") == 0, 0).when(F.col("_from").isNull(), 1).when(F.lag("_sure").over(in_order).isNotNull(), 0))
                .withColumn("_lost", F.last("_event", ignorenulls=True).over(in_order))
                .withColumn("_next_lost", F.coalesce(F.lead("_lost").over(in_order), F.lit(0)))
                .withColumn("_piece", F.max(F.when(F.col("_lost") == 0, F.col("_chunk"))).over(in_order)))
    begin = F.when(F.col("_lost") == 0, F.coalesce("_from", F.lit(0))).otherwise(0)
    # up to the stitch if the next chunk is sure, else up to where the next chunk starts
    end = F.when(F.col("_last"), F.char_length("_text")).when(F.col("_next_lost") == 0, size + F.col("_to")).otherwise(size)
    return (stitched.select("_n", "_key", "_piece", "_chunk", F.substring("_text", begin + 1, end - begin).alias("_text"))
            .groupBy("_n", "_key", "_piece")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_text"))), lambda x: x["_text"]), "").alias("_text")))


def encode(docs: DataFrame, *, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row per row of ``docs``: its id and ``ids`` (binary, little-endian unsigned 32-bit).

    A null text is the empty text and has no ids. Repeated rows stay repeated; a null id stays null;
    other columns are ignored, and an empty table gives an empty one. Where an overlap has no common
    boundary (such as in one run of letters longer than it) the piece goes on to the next overlap
    with one that is sure whatever stands before, so only such a run itself is ever one piece.
    """
    _check_sizes(chunk_chars, overlap_chars)
    size, overlap = chunk_chars, overlap_chars

    @F.pandas_udf("binary")
    def encode_piece(text: pd.Series) -> pd.Series:
        return text.map(lambda t: encode_text(t, ranks_path, pattern))

    @F.pandas_udf("binary")
    def join_ids(pieces: pd.Series) -> pd.Series:
        return pieces.map(lambda parts: b"".join(parts))

    base = docs.select(column(id_col).alias("_id"), text_of(text_col).alias("_text"))
    within = base.where(F.char_length("_text") <= size)
    short = within.select("_id", encode_piece("_text").alias("ids"))

    # the id as text with a number of its row: equal rows stay apart
    beyond = base.where(F.char_length("_text") > size).select(
        F.monotonically_increasing_id().alias("_n"), F.col("_id").cast("string").alias("_key"), "_text")
    pieces = pieces_of(beyond, pattern, size, overlap).withColumn("ids", encode_piece("_text"))
    long = (pieces.groupBy("_n", "_key")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("_piece", "ids"))), lambda x: x["ids"]).alias("ids"))
            .select(F.col("_key").cast(base.schema["_id"].dataType).alias("_id"), join_ids("ids").alias("ids")))
    return short.unionByName(long).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, *, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the raw bytes of its ids in ``out_col``; null ids give null. An id that the
    vocabulary lacks is an error."""
    @F.pandas_udf("binary")
    def join_bytes(ids: pd.Series) -> pd.Series:
        get = _token_bytes(ranks_path).__getitem__
        return ids.map(lambda x: None if x is None else b"".join(map(get, np.frombuffer(x, "<u4").tolist())))

    return encoded.withColumn(out_col, join_bytes(column(ids_col)))


def digests(decoded: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The row of ``op1``: counts and SHA-256 of the ids and of the decoded bytes."""
    return decoded.select(
        column(id_col),
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
