"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A sequence costs ``linear * tokens + quadratic * sum(piece length ** 2)``: attention stays within a
piece. Documents are cut into pieces of at most one sequence; whole-sequence pieces stand alone, and
the rest are assigned in descending length, each to the sequence of lowest cost that has room. Where
none has room the piece is cut over those with most room, so that the sequences of a buffer hold
less than one sequence of padding together.

Each task packs what it reads, buffer by buffer, so nothing is shuffled: a buffer is bounded by its
tokens, and sequence numbers are unique because they start with the number of the partition.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, text_of, worker_table

SEQUENCE_TOKENS, BUFFER_TOKENS = 2_048, 1 << 20
#: Cost of a token, and of a pair of tokens that attend to each other, in a layer of width 1024:
#: 24 w^2 and 4 w operations, with the first scaled to 1.
LINEAR, QUADRATIC = 1.0, 4.0 / (24 * 1024)
#: Closes each document.
END_ID = 1
#: Spellings and words that a worker remembers the ids of (about 200 bytes each), and how long they may be.
KNOWN_SPELLINGS, KNOWN_WORDS, KNOWN_CHARS = 600_000, 1_600_000, 64
#: What the vocabulary's tokens at the end of a word end with.
WORD_END = "</w>"
#: Characters of the texts whose new words are looked up together.
GROUP_CHARS = 1 << 20

#: Letters and the marks behind them, or else a whole line.
_PARTS = re.compile(r"^([a-zà-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)$|^(.*)$", re.MULTILINE).findall
_LETTERS = re.compile(r"[a-zà-öø-ÿ]+").fullmatch
_BEYOND_LATIN = re.compile(r"[^\x00-\xff]").search


class WordIds(dict):
    """Ids of the words of a text that is split at blanks and line feeds, as little-endian bytes.

    The tokenizer drops white space and no match of its pattern spans any, so a text's ids are the
    ids of its words in order. A new word is looked up by its lower-case letters and by the marks
    behind them (two matches of the pattern), so that few spellings reach the tokenizer itself. The
    new words of a group of texts are looked up together, in one call of the tokenizer.
    The table of spellings is emptied when it is full; of the words' two halves the older one goes
    when the younger one is full, and words that are met again move to the younger one.
    """

    def __init__(self, tokenizer_path: str, known_words: int = KNOWN_WORDS, known_spellings: int = KNOWN_SPELLINGS):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer, self.known_words, self.known_spellings = Tokenizer.from_file(tokenizer_path), known_words, known_spellings
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def _encode(self, parts: list[str]) -> Iterator[bytes]:
        """The ids of each part, in the order of the parts. Words of letters alone are one match of the
        pattern each; they are encoded as one text, whose ids show where a word ends."""
        plain = [p for p in parts if _LETTERS(p)]
        ids = np.array(self._ids([" ".join(plain)])[0] if plain else [], dtype="<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) == len(plain):
            data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            found = {p: data[a:b] for p, a, b in zip(plain, at, at[1:])}
        else:  # a vocabulary without word ends
            found = {}
        rest = [p for p in parts if p not in found]
        found |= {p: np.array(x, dtype="<u4").tobytes() for p, x in zip(rest, self._ids(rest), strict=True)}
        return map(found.__getitem__, parts)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        joined, odd = "\n".join(words), set()
        if "<|" in joined or _BEYOND_LATIN(joined) or max(map(len, words), default=0) > KNOWN_CHARS:
            # lower case differs between libraries beyond Latin-1; special tokens are told by their case
            odd = {w for w in words if len(w) > KNOWN_CHARS or "<|" in w or _BEYOND_LATIN(w)}
            words = [w for w in words if w not in odd]
            joined = "\n".join(words)
        parts = _PARTS(joined.lower()) if words else []
        ids: dict[str, bytes] = {}
        asked = [w for w in odd if len(w) > KNOWN_CHARS]
        young, old = self.young, self.old
        every = {w for w in odd if len(w) <= KNOWN_CHARS}
        for column in zip(*parts):
            every.update(column)
        every.discard("")
        for part in every:
            known = young.get(part)
            if known is None:
                known = old.get(part)
                if known is None:
                    asked.append(part)
                    continue
                young[part] = known
            ids[part] = known
        for part, found in zip(asked, self._encode(asked), strict=True):
            ids[part] = found
            if len(part) <= KNOWN_CHARS:
                if len(self.young) >= self.known_words // 2:
                    self.young, self.old = {}, self.young
                self.young[part] = found
        ids[""] = b""
        for word, (letters, marks, other) in zip(words, parts, strict=True):
            self[word] = ids[letters] + ids[marks] if marks else ids[letters or other]
        for word in odd:
            self[word] = ids[word]

    def of_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        words = set().union(*split)
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.known_spellings:
            self.clear()
            new = list(words)
        self._learn(new)
        get = self.__getitem__
        return [b"".join(map(get, own)) for own in split]

    def of(self, text: str) -> bytes:
        return self.of_all([text])[0]


def word_ids(tokenizer_path: str, known_words: int, known_spellings: int) -> WordIds:
    return worker_table(("word ids", tokenizer_path, known_words, known_spellings), lambda: WordIds(tokenizer_path, known_words, known_spellings))


def _groups(batch: pd.DataFrame, chars: int) -> Iterator[tuple[list, list[str]]]:
    """The ids and texts of a batch in groups of about so many characters."""
    keys: list = []
    texts: list[str] = []
    size = 0
    for key, text in zip(batch["key"].tolist(), batch["text"], strict=True):
        keys.append(key)
        texts.append(text)
        size += len(text)
        if size >= chars:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def assign(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """(piece, start in it, length, sequence) of pieces of 1 to ``capacity`` tokens, in the order in
    which they enter their sequences. There are as many sequences as the tokens need. Ties: the
    earlier piece, the smaller sequence number."""
    room = np.full(-(-int(lengths.sum()) // capacity), capacity, dtype=np.int64)
    cost = np.zeros(len(room))
    placed = []
    for piece in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[piece])
        while left:
            fits = room >= left
            if fits.any():
                k, n = int(np.argmin(np.where(fits, cost, np.inf))), left
            else:
                k = int(np.argmax(room))
                n = int(room[k])
            placed.append((int(piece), start, n, k))
            room[k] -= n
            cost[k] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return placed


class _Packer:
    def __init__(self, first_sequence: int, capacity: int):
        self.sequence, self.capacity, self.out = first_sequence, capacity, []
        self.waiting: list[tuple] = []
        self.tokens = 0

    def add(self, key, ids: bytes) -> None:
        total, step = len(ids) // 4, self.capacity
        full = total // step * step
        for start in range(0, full, step):
            self.out.append((key, start, step, ids[4 * start:4 * (start + step)], total, self.sequence, 0))
            self.sequence += 1
        if total > full:
            self.waiting.append((key, full, ids[4 * full:], total))
            self.tokens += total - full

    def flush(self) -> None:
        if not self.waiting:
            return
        filled: dict[int, int] = {}
        for piece, start, n, k in assign(np.array([len(w[2]) // 4 for w in self.waiting]), self.capacity):
            key, base, ids, total = self.waiting[piece]
            self.out.append((key, base + start, n, ids[4 * start:4 * (start + n)], total, self.sequence + k, filled.get(k, 0)))
            filled[k] = filled.get(k, 0) + n
        self.sequence += len(filled)
        self.waiting, self.tokens = [], 0

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, *, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         sequence_tokens: int = SEQUENCE_TOKENS, buffer_tokens: int = BUFFER_TOKENS, end_id: int = END_ID,
         known_words: int = KNOWN_WORDS, known_spellings: int = KNOWN_SPELLINGS) -> DataFrame:
    """One row per piece: the document's id, ``start`` (its ids before the piece), ``length``,
    ``ids`` (binary, little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset``.

    A null or empty text is a document of the closing id alone. Every row is a document of its own,
    also a repeated one or one with a null id; other columns are ignored. An empty table has no
    pieces. A text of any length becomes as many pieces as it needs. What a worker remembers
    (``known_words``, ``known_spellings``) saves time and changes no result.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = word_ids(tokenizer_path, known_words, known_spellings).of_all
        packer = _Packer(TaskContext.get().partitionId() << 33, sequence_tokens)
        for batch in batches:
            for keys, texts in _groups(batch, GROUP_CHARS):
                for key, ids in zip(keys, ids_of(texts), strict=True):
                    packer.add(key, ids + end)
                    if packer.tokens >= buffer_tokens:
                        packer.flush()
            if packer.out:
                yield pd.DataFrame(packer.take(), columns=names)
        packer.flush()
        if packer.out:
            yield pd.DataFrame(packer.take(), columns=names)

    # the id travels as text: a null next to numbers must not turn them into floats
    kind = docs.schema[id_col].dataType
    packed = docs.select(column(id_col).cast("string").alias("key"), text_of(text_col).alias("text")).mapInPandas(
        run, "key string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return packed.select(F.col("key").cast(kind).alias(id_col), *names[1:])


def pieces_with_crc(packed: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``op3``: a checksum in place of a piece's ids."""
    return packed.select(column(id_col), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
