"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training takes a bounded, documented sample of labelled texts (PER_CLASS of each class, each of at most
TRAIN_BYTES bytes). In it, document frequencies of character n-grams of each order give the log-count
ratios; the FEATURES n-grams with the largest chi-square statistic are kept, their presence is scaled by
the ratio, and an L2-penalised logistic regression is fitted on the scaled presences. Scoring runs over
whole texts of all documents: the n-grams of a run of texts are hashed in one vectorised pass, looked up
in a bitmap, and confirmed against the full 64-bit hashes.

Defined cases: null and empty texts score the classifier's intercept; repeated rows score alike; texts
shorter than an n-gram have none of that order; without labelled rows of both classes the score is the
share of toxic labels (0 if there are none at all).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import crc_bucket, labelled_sample, release, short_batches, text_slices

ORDERS = (4, 5, 6, 7)
#: The most labelled documents of each class that training reads, and the longest of them.
PER_CLASS, TRAIN_BYTES = 800, 30_000
#: N-grams that the model keeps, and the least number of sample documents that hold one.
FEATURES, LEAST_DOCS = 4096, 4
THRESHOLD = 0.5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_BITMAP_BITS = 22
#: The sample's n-grams are counted in so many parts (as a power of 2), to bound memory.
_PART_BITS = 3


def _lower_table() -> np.ndarray:
    """Code point -> its lower-case code point, or a space for what is no letter or digit; for the basic plane."""
    table = np.full(0x10000, 32, dtype=np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalnum():
            table[c] = ord(low) if len(low := chr(c).lower()) == 1 else c
    return table


_lower: list[np.ndarray] = []


def characters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of UTF-8 bytes, and the rows' offsets in characters."""
    if not _lower:
        _lower.append(_lower_table())
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
    basic = np.minimum(points, 0xFFFF)
    low = np.where(points < 0x10000, _lower[0][basic], points)
    return low, starts[offsets]


def grams(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, 64-bit hash of the n-gram that starts at each character)."""
    wide = points.astype(np.uint64)
    wide *= _SPREAD
    wide ^= wide >> np.uint64(29)
    have = wide
    for n in range(2, max(ORDERS) + 1):
        if len(have) < 2:
            return
        have = have[:-1] * _BASE
        have += wide[n - 1 :]
        if n in ORDERS:
            yield n, have


@dataclass
class Model:
    """Kept n-grams: sorted hashes (the order is part of the hash), weights; the intercept."""

    hashes: np.ndarray
    weights: np.ndarray
    intercept: float

    def __post_init__(self) -> None:
        self.bitmap = np.zeros(1 << _BITMAP_BITS, np.bool_)
        self.bitmap[self._slot(self.hashes)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - _BITMAP_BITS)).astype(np.int32)

    def matches(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature) pairs, as two arrays."""
        rows, features = [], []
        for n, h in grams(points):
            at = np.flatnonzero(self.bitmap[self._slot(h)])
            if not len(at):
                continue
            found = h[at] + np.uint64(n)
            where = np.searchsorted(self.hashes, found)
            where[where == len(self.hashes)] = 0
            real = self.hashes[where] == found
            at, where = at[real], where[real]
            row = np.searchsorted(offsets, at, side="right") - 1
            inside = at + n <= offsets[row + 1]
            rows.append(row[inside])
            features.append(where[inside])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(rows) * len(self.hashes) + np.concatenate(features))
        return pairs // len(self.hashes), pairs % len(self.hashes)

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.intercept)
        if len(self.hashes):
            for lo, hi, raw, offsets in text_slices(column):
                points, at = characters(raw, offsets)
                row, feature = self.matches(points, at)
                out[lo:hi] += np.bincount(row, self.weights[feature], minlength=hi - lo)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -50, 50)))


def _document_grams(texts: list[str]) -> list[np.ndarray]:
    out = []
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        points, _ = characters(raw, np.array([0, len(raw)]))
        found = [h + np.uint64(n) for n, h in grams(points)]
        out.append(np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64))
    return out


def _frequencies(docs: list[np.ndarray], y: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of one part of the hash space that enough documents hold, and in how many of each class."""
    low, high = np.uint64(part << (64 - _PART_BITS)), np.uint64((part + 1 << (64 - _PART_BITS)) - 1)
    cut = [d[np.searchsorted(d, low) : np.searchsorted(d, high, side="right")] for d in docs]
    side = [np.unique(np.concatenate([np.zeros(0, np.uint64), *[d for d, t in zip(cut, y, strict=True) if t == k]]), return_counts=True) for k in (0, 1)]
    every = np.union1d(side[0][0], side[1][0])
    df = np.zeros((2, len(every)))
    for k, (found, n) in enumerate(side):
        df[k, np.searchsorted(every, found)] = n
    often = df.sum(0) >= LEAST_DOCS
    return every[often], df[:, often]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent for balanced, L2-penalised logistic regression."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    # an upper bound of the curvature, by a few power iterations
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):
        v = x.T @ (weight * (x @ v)).astype(np.float32)
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    rate = 1.0 / (0.25 * (norm + 1.0) + penalty)
    seen_w, seen_b = w, b
    for k in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ seen_w + seen_b, -50, 50)))
        g = (weight * (p - y)).astype(np.float32)
        new_w, new_b = seen_w - rate * (x.T @ g + penalty * seen_w), seen_b - rate * float(g.sum())
        pull = k / (k + 3)
        seen_w, seen_b = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b = new_w, new_b
    return w, b


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Train on texts in memory; labels are 0 or 1."""
    y = np.asarray(labels, np.float64)
    none = np.zeros(0, np.uint64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9))
        return Model(none, np.zeros(0), float(np.log(share / (1 - share))))
    docs = _document_grams(texts)
    counted = [_frequencies(docs, y, part) for part in range(1 << _PART_BITS)]
    every, df = np.concatenate([c[0] for c in counted]), np.concatenate([c[1] for c in counted], axis=1)
    if not len(every):
        return Model(none, np.zeros(0), float(np.log(y.mean() / (1 - y.mean()))))
    size = np.array([(y == 0).sum(), (y == 1).sum()], float)
    both = df.sum(0)
    share = size[1] / size.sum()
    chi = (df[1] - both * share) ** 2 / (both * share * (1 - share) * np.maximum(1 - both / size.sum(), 1e-9) + 1e-9)
    keep = np.sort(np.lexsort((every, -chi))[:FEATURES])
    hashes, df = every[keep], df[:, keep]
    ratio = np.log((df[1] + 0.5) / (df[1] + 0.5).sum()) - np.log((df[0] + 0.5) / (df[0] + 0.5).sum())
    x = np.zeros((len(docs), len(hashes)), np.float32)
    for i, d in enumerate(docs):
        where = np.searchsorted(hashes, d)
        where[where == len(hashes)] = 0
        x[i, where[hashes[where] == d]] = 1.0
    w, b = _logistic(x * ratio.astype(np.float32), y, penalty=1e-4)
    return Model(hashes, w.astype(np.float64) * ratio, b)


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, label: str = "toxic") -> Model:
    """Train on labelled rows for which allowed (an expression on labels) holds; runs in one bounded task."""
    sample = labelled_sample(docs, labels, label, F.lit(True) if allowed is None else allowed, PER_CLASS, TRAIN_BYTES)

    def fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "label"])
        model = fit(list(pdf["text"]), pdf["label"].to_numpy())
        release()
        return pd.DataFrame({"hash": np.append(model.hashes.view(np.int64), 0), "weight": np.append(model.weights, model.intercept), "is_intercept": [False] * len(model.hashes) + [True]})

    rows = sample.groupBy(F.lit(1).alias("all")).applyInPandas(fit_group, "hash bigint, weight double, is_intercept boolean").toPandas()
    if not len(rows):
        return fit([], np.zeros(0))
    last = rows["is_intercept"].to_numpy()
    hashes, weights = rows["hash"].to_numpy()[~last].astype(np.int64).view(np.uint64), rows["weight"].to_numpy()[~last]
    order = np.argsort(hashes)
    return Model(hashes[order], weights[order].astype(float), float(rows["weight"].to_numpy()[last][0]))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted; input columns of these names are replaced."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast((model.hashes, model.weights, model.intercept))

    @F.arrow_udf("double")
    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*shared.value)
        for batch in batches:
            yield pa.array(own.scores(batch), pa.float64())
        release()

    out = docs.withColumn("score", toxic(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_held_out(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the held-out rows are never read for training."""
    model = train(docs, labels, crc_bucket(F.col("doc_id"), mod) != rest)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), mod) == rest).alias("held_out"), "score", "predicted")
