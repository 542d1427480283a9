"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other. The model of each sees the words of a text and the
probabilities of the categories before it; in training those are out-of-fold predictions, so a model
learns from probabilities as good as the ones it will be given. The labels hold two categories:
``low_quality`` (spam and noise) comes first and ``toxic`` second.

Features are a text's distinct words and the first letters of its words (a stem carries insults in
languages that join words), of which each model keeps those that tell the classes apart most surely.
The models are fitted on a bounded sample: ``max_rows`` labelled rows with and as many without the
last category at most, in the order of a hash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, text_of, worker_table

MAX_ROWS, DIMENSIONS, STEMS = 2_500, 1 << 18, (3, 4, 5)
KEPT_FEATURES, FOLDS, RIDGE = 2_048, 3, 1e-4
THRESHOLD = 0.5
#: Words that a worker remembers the features of.
KNOWN_WORDS = 200_000

_WORDS = re.compile(r"\w+").findall


def categories() -> dict[str, Column]:
    """The chain over the table ``labels``, in its order."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def word_features(word: str) -> tuple[int, ...]:
    names = [word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)]
    return tuple(zlib.crc32(x.encode()) % DIMENSIONS for x in names)


class _Known(dict):
    def __init__(self, of: Callable[[str], tuple]):
        self.of = of

    def __missing__(self, word: str):
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = self.of(word)
        return value


def features(text: str, known: dict) -> set[int]:
    return set().union(*map(known.__getitem__, set(_WORDS(text.lower()))))


@dataclass(frozen=True)
class Link:
    """One category's model: weights of the kept features and of the probabilities of the categories
    before it, and an intercept."""

    name: str
    weights: dict[int, float]
    before: tuple[float, ...]
    intercept: float


@dataclass(frozen=True)
class Chain:
    links: tuple[Link, ...] = field(default=())

    def probabilities(self, found: set[int]) -> list[float]:
        out: list[float] = []
        for link in self.links:
            z = link.intercept + sum(link.weights[f] for f in sorted(found) if f in link.weights)
            out.append(float(_sigmoid(z + sum(a * b for a, b in zip(link.before, out, strict=True)))))
        return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sure(rows: np.ndarray, values: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The features whose odds differ between the classes by most standard errors."""
    n1, n0 = y.sum(), len(y) - y.sum()
    with1 = np.bincount(values, weights=y[rows], minlength=DIMENSIONS)
    with0 = np.bincount(values, minlength=DIMENSIONS) - with1
    a, b, c, d = with1 + 0.5, n1 - with1 + 0.5, with0 + 0.5, n0 - with0 + 0.5
    z = np.abs(np.log(a / b) - np.log(c / d)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    z[with1 + with0 < 2] = 0
    best = np.argsort(-z, kind="stable")[:KEPT_FEATURES]
    return np.sort(best[z[best] > 2])


def fit_linear(rows: np.ndarray, values: np.ndarray, y: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Kept features, their weights with those of the dense columns behind, and the intercept: a
    logistic model with a ridge by accelerated gradient steps; and its log-odds of the rows."""
    if len(y) == 0 or y.min() == y.max():  # nothing to tell apart
        odds = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        return np.zeros(0, dtype=np.int64), np.zeros(dense.shape[1]), odds, np.full(len(y), odds)
    kept = _sure(rows, values, y)
    slot = np.full(DIMENSIONS, -1)
    slot[kept] = np.arange(len(kept))
    r, v = rows[slot[values] >= 0], slot[values[slot[values] >= 0]]
    n, k = len(y), len(kept)

    def forward(w):
        return np.bincount(r, weights=w[v], minlength=n) + dense @ w[k:-1] + w[-1]

    w = np.zeros(k + dense.shape[1] + 1)
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    size = np.bincount(r, minlength=n) + (dense ** 2).sum(axis=1) + 1
    rate = 4 / max(float((size ** 2).mean() ** 0.5), 1.0)
    seen, t = w.copy(), 1.0
    for _ in range(400):
        error = _sigmoid(forward(seen)) - y
        step = np.concatenate([np.bincount(v, weights=error[r], minlength=k), dense.T @ error, [error.sum()]]) / n
        step[:-1] += RIDGE * seen[:-1]
        new = seen - rate * step
        t, t_was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        seen = new + (t_was - 1) / t * (new - w)
        w = new
    return kept, w[:-1], float(w[-1]), forward(w)


def fit_chain(texts: list[np.ndarray], folds: np.ndarray, targets: dict[str, np.ndarray]) -> Chain:
    """``texts`` holds each row's features. A category that one class alone stands for has the
    log-odds of its share."""
    n = len(texts)
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in texts])
    values = np.concatenate([*texts, np.zeros(0, dtype=np.int32)]).astype(np.int32)
    before, links = np.zeros((n, 0)), []
    for name, y in targets.items():
        kept, weights, intercept, _ = fit_linear(rows, values, y, before)
        k = len(kept)
        links.append(Link(name, dict(zip(kept.tolist(), weights[:k].tolist(), strict=True)), tuple(weights[k:].tolist()), intercept))
        out = np.zeros(n)
        for fold in range(FOLDS):
            here = folds == fold
            if not here.any() or here.all():
                continue
            back = np.cumsum(~here) - 1
            use = ~here[rows]
            kept, weights, intercept, _ = fit_linear(back[rows[use]], values[use], y[~here], before[~here])
            full = np.zeros(DIMENSIONS)
            full[kept] = weights[:len(kept)]
            z = np.bincount(rows, weights=full[values], minlength=n) + before @ weights[len(kept):] + intercept
            out[here] = _sigmoid(z[here])
        before = np.column_stack([before, out])
    return Chain(tuple(links))


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, Column], *, id_col: str = "doc_id", text_col: str = "text",
        max_rows: int = MAX_ROWS) -> Chain:
    """The chain of the labelled rows of ``docs``; ``targets`` are conditions on ``labels``.

    A row counts for a category if any of its labels does; a null condition is no. Rows without an
    id are not learned from; of rows that share an id one is, that of the smallest features. No labelled row gives a chain that finds each category as likely as not.
    """
    names = list(targets)
    known = (labels.where(column(id_col).isNotNull()).groupBy(column(id_col).alias("_id"))
             .agg(*(F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(f"_y{k}") for k, c in enumerate(targets.values()))))
    by_hash = F.xxhash64(F.lit("toxicity"), F.col("_id").cast("string"))
    last = F.col(f"_y{len(names) - 1}")
    few = known.where(last == 1).orderBy(by_hash, "_id").limit(max_rows).unionByName(known.where(last == 0).orderBy(by_hash, "_id").limit(max_rows))

    @F.pandas_udf("binary")
    def features_of(text: pd.Series) -> pd.Series:
        words = _Known(word_features)
        return text.map(lambda t: np.array(sorted(features(t, words)), dtype="<i4").tobytes())

    texts = docs.select(column(id_col).alias("_id"), text_of(text_col).alias("_text"))
    classes = [f"_y{k}" for k in range(len(names))]
    sample = (texts.join(F.broadcast(few), "_id")  # ids bounded by max_rows, each with any number of rows
              .select("_id", *classes, F.struct(features_of("_text").alias("f"), (F.crc32(F.col("_text").cast("binary")) % FOLDS).alias("fold")).alias("_row"))
              .groupBy("_id", *classes).agg(F.min("_row").alias("_row")).select("_row.*", *classes).collect())
    sample.sort(key=lambda r: (r["fold"], bytes(r["f"]), [r[f"_y{k}"] for k in range(len(names))]))
    chain = fit_chain([np.frombuffer(r["f"], dtype="<i4") for r in sample], np.array([r["fold"] for r in sample], dtype=int),
                      {name: np.array([r[f"_y{k}"] for r in sample], dtype=float) for k, name in enumerate(names)})
    # the sample may hold fewer rows of the larger class: the last category's odds go back to the table's
    share = {r["y"]: r["n"] for r in known.groupBy(last.alias("y")).agg(F.count("*").alias("n")).collect()}
    taken = {y: sum(r[f"_y{len(names) - 1}"] == y for r in sample) for y in (0, 1)}
    if not (taken[0] and taken[1]):
        return chain
    shift = float(np.log(share[1] / taken[1]) - np.log(share[0] / taken[0]))
    return Chain((*chain.links[:-1], replace(chain.links[-1], intercept=chain.links[-1].intercept + shift)))


def score(docs: DataFrame, chain: Chain, *, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a struct of each category's probability. A null or empty text has no features."""
    kept = frozenset(f for link in chain.links for f in link.weights)

    @F.pandas_udf(", ".join(f"`{link.name}` double" for link in chain.links))
    def probabilities(text: pd.Series) -> pd.DataFrame:
        known = _worker_words(kept)
        return pd.DataFrame([chain.probabilities(features(t, known)) for t in text], columns=[x.name for x in chain.links])

    return docs.withColumn(out_col, probabilities(text_of(text_col)))


def _worker_words(kept: frozenset) -> _Known:
    """The kept features of the words that this worker has met."""
    return worker_table(("kept features", kept), lambda: _Known(lambda word: tuple(f for f in word_features(word) if f in kept)))


def scored(docs: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The row of ``op2``: id, each category's probability and the decision on the last one."""
    rows = score(docs.select(column(id_col), text_of(text_col).alias("_text")), chain, text_col="_text", out_col="_p")
    names = [link.name for link in chain.links]
    return rows.select(column(id_col), *(F.col(f"_p.{n}").alias(f"{n}_probability") for n in names),
                       (F.col(f"_p.{names[-1]}") >= threshold).cast("int").alias("predicted"))
