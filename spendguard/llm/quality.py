"""Quality by compression: two zstandard dictionaries, one of good and one of bad labelled text.

A text is cut into blocks and each block is compressed with either dictionary; the difference of the
two sums over their total says which kind of text it is made of, whatever its length. A logistic
curve fitted on labelled rows that the dictionaries have not seen turns it into a probability.

The model is fitted on a bounded sample of labelled rows: ``max_blocks`` blocks of each class for the
dictionaries and ``max_calibration`` rows of each class for the curve, taken in the order of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, text_of

BLOCK_BYTES, DICT_BYTES, LEVEL = 2_048, 64 << 10, 3
MAX_BLOCKS, MAX_CALIBRATION = 2_000, 1_500
#: Of five parts of the ids one is held out, one calibrates, and the dictionaries learn from the rest.
PARTS, HELD_OUT, CALIBRATES = 5, 0, 4
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """``good`` and ``bad`` are dictionaries (empty: the class had no text), and a text whose
    difference is x has probability 1 / (1 + exp(-(slope * x + intercept)))."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float


def part_of(id_col: str) -> Column:
    return F.crc32(column(id_col).cast("string").cast("binary")) % PARTS


def _blocks(text: str, size: int) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[i:i + size] for i in range(0, len(data), size)]


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary of the samples, of ``size`` bytes at most. Samples too few or too alike to train on
    serve as the dictionary themselves, as many of their bytes as a dictionary holds."""
    import zstandard

    size = min(size, sum(map(len, samples)) // 4)
    if len(samples) >= 16 and size >= 1_024:
        try:
            return zstandard.train_dictionary(size, samples, k=256, d=8, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:DICT_BYTES]


def _compressor(dictionary: bytes):
    import zstandard

    kind = {}
    if dictionary:
        trained = dictionary[:4] == b"\x37\xa4\x30\xec"  # the magic number of a trained dictionary
        kind["dict_data"] = zstandard.ZstdCompressionDict(
            dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
        kind["dict_data"].precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, **kind)


def difference(texts: pd.Series, good: bytes, bad: bytes) -> pd.Series:
    """(bad size - good size) / (bad size + good size) of each whole text; 0 for an empty one."""
    by_good, by_bad = _compressor(good), _compressor(bad)

    def of(text: str) -> float:
        blocks = _blocks(text, BLOCK_BYTES)
        a = sum(len(by_good.compress(b)) for b in blocks)
        b = sum(len(by_bad.compress(b)) for b in blocks)
        return (b - a) / (b + a) if blocks else 0.0

    return texts.map(of).astype(float)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[float, float]:
    """Slope and intercept of a logistic curve by Newton steps; of one class alone its share, smoothed."""
    n, n1 = len(y), float(y.sum())
    if n == 0 or n1 in (0, n):
        return 0.0, float(np.log((n1 + 1) / (n - n1 + 1)))
    scale = float(np.abs(x).mean()) or 1.0
    a = np.stack([x / scale, np.ones(n)], axis=1)
    w = np.zeros(2)
    penalty = np.diag([ridge * n, 1e-9])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_blocks: int = MAX_BLOCKS, max_calibration: int = MAX_CALIBRATION) -> Model:
    """The model of the labelled rows of ``docs``, without those that are held out.

    Rows without an id or a label of 0 or 1 are not learned from; a row with several labels takes
    the smallest, and of the rows that share an id the one of the least difference stands for it. No
    labelled row at all gives a model that scores 0.5; long texts give all their blocks to the draw.
    """
    known = (labels.where(column(id_col).isNotNull() & column(label_col).isin(0, 1)).groupBy(column(id_col).alias("_id"))
             .agg(F.min(column(label_col)).cast("int").alias("_label"))
             .withColumn("_part", part_of("_id")).where(F.col("_part") != HELD_OUT))
    by_hash = F.xxhash64(F.lit("quality"), F.col("_id").cast("string"))
    texts = docs.select(column(id_col).alias("_id"), text_of(text_col).alias("_text"))

    def rows(label: int, calibrates: bool, limit: int) -> DataFrame:
        """Some rows of a class; their number is bounded by the limit, so they can be broadcast."""
        part = (F.col("_part") == CALIBRATES) == F.lit(calibrates)
        few = known.where((F.col("_label") == label) & part).select("_id", "_label").orderBy(by_hash, "_id").limit(limit)
        return texts.join(F.broadcast(few), "_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(key, k, block) for key, text in zip(batch["_key"], batch["_text"], strict=True)
                   for k, block in enumerate(_blocks(text, BLOCK_BYTES))]
            yield pd.DataFrame(out, columns=["_key", "_k", "_block"])

    def dictionary(label: int) -> bytes:
        blocks = (rows(label, False, max_blocks).select(F.col("_id").cast("string").alias("_key"), "_text")
                  .mapInPandas(cut, "_key string, _k int, _block binary")
                  .orderBy(F.xxhash64("_key", "_k"), "_key", "_k", "_block").limit(max_blocks))
        return train_dictionary([bytes(r["_block"]) for r in blocks.select("_block").collect()])

    good, bad = dictionary(1), dictionary(0)

    @F.pandas_udf("double")
    def difference_of(text: pd.Series) -> pd.Series:
        return difference(text, good, bad)

    seen = rows(1, True, max_calibration).unionByName(rows(0, True, max_calibration))
    # of the rows that share an id one, so the limits bound what reaches the driver
    points = seen.select("_id", difference_of("_text").alias("x"), "_label").groupBy("_id").agg(F.min("x").alias("x"), F.min("_label").alias("_label")).collect()
    # the sample holds as many rows of either class at most: weigh the curve back to the classes' shares
    shares = {r["_label"]: r["n"] for r in known.where(F.col("_part") == CALIBRATES).groupBy("_label").agg(F.count("*").alias("n")).collect()}
    x, y = np.array([p["x"] for p in points], dtype=float), np.array([p["_label"] for p in points], dtype=float)
    slope, intercept = fit_curve(x, y)
    if 0 < y.sum() < len(y):
        intercept += np.log(shares[1] / y.sum()) - np.log(shares[0] / (len(y) - y.sum()))
    return Model(good, bad, slope, float(intercept))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality. A null or empty text has no difference, and
    so the probability of a text that is as near to either class. Each row is scored by its own whole
    text, a repeated row alike; an empty table stays empty, and ``out_col`` replaces a column of that name."""
    @F.pandas_udf("double")
    def probability(text: pd.Series) -> pd.Series:
        z = model.slope * difference(text, model.good, model.bad) + model.intercept
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

    return docs.withColumn(out_col, probability(text_of(text_col)))


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The row of ``op6``: id, held_out, score and the decision; a null id is not held out."""
    rows = docs.select(column(id_col), text_of(text_col).alias("_text"))
    return score(rows, model, text_col="_text").select(
        column(id_col),
        F.coalesce(part_of(id_col) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
