"""Word shingles and fast similarity sketches of texts, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import worker_table

#: Words whose hashes a worker remembers, and how long such a word may be.
KNOWN_WORDS, KNOWN_BYTES = 400_000, 64

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= KNOWN_BYTES:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = value
        return value


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a text. Words are what white space
    (0x20 and 0x09 to 0x0D) separates, with A-Z in lower case; a text of fewer words is one shingle,
    one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = worker_table("word hashes", _WordHashes)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(width, len(h))):
            out = mix(out * _ODD + h[j:j + n])
    return np.unique(out)


def sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty set: in round i each element falls into a random
    bin with value i + a random fraction, and in round size + b every element falls into bin b, so
    that each bin is filled; a bin keeps its least value. Two sketches agree in a coordinate with a
    probability of the sets' Jaccard similarity, and the share that agrees is concentrated around it."""
    out = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    at, width = 0, max(1, -(-2 * size // len(elements)))
    with np.errstate(over="ignore"):
        while at < size and (out == np.iinfo(np.uint64).max).any():
            rounds = np.arange(at, min(size, at + width), dtype=np.uint64)
            h = mix(elements[None, :] + mix(rounds + _ODD)[:, None])
            bins = ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
            value = (rounds[:, None] << np.uint64(48)) | (mix(h) >> np.uint64(16))
            order = np.lexsort((value.ravel(), bins.ravel()))
            b, v = bins.ravel()[order], value.ravel()[order]
            first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            out[b[first].astype(np.int64)] = np.minimum(out[b[first].astype(np.int64)], v[first])
            at += width
        for empty in np.flatnonzero(out == np.iinfo(np.uint64).max):
            h = mix(elements + mix(np.uint64(size + int(empty)) + _ODD))
            out[empty] = (np.uint64(size + int(empty)) << np.uint64(48)) | (mix(h) >> np.uint64(16)).min()
    return out


def band_keys(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each band of ``rows`` coordinates, different for equal bands at different places."""
    bands = coordinates[:len(coordinates) // rows * rows].reshape(-1, rows)
    with np.errstate(over="ignore"):
        out = mix(np.arange(len(bands), dtype=np.uint64) + _ODD)
        for j in range(rows):
            out = mix(out * _ODD + bands[:, j])
    return out
