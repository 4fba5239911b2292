"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

Statistics are shares and lengths computed from the bytes of a whole text. They are standardised, mapped by
random Fourier features that approximate a Gaussian kernel, and fitted to the labels by ridge regression
whose normal equations are summed over partitions: each task sends one FEATURES x FEATURES matrix at most.
Raw scores are then made monotone in the observed share of good labels (pool adjacent violators), over scores
that rows of the sample get from the equations of the other FOLDS - 1 folds, so calibration sees no row that its
weights were fitted on; rows count so that the classes have the shares of all labels. Training takes a bounded,
documented sample (PER_CLASS of each class, each text of at most TRAIN_BYTES bytes).

Defined cases: null and empty texts have all statistics zero and are scored like any other; repeated rows
score alike; without labelled rows of both classes the score is the share of good labels (1 if none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import crc_bucket, labelled_sample, materialize, release, segment_sums, short_batches, text_slices

PER_CLASS, TRAIN_BYTES = 4000, 60_000
FEATURES, BANDWIDTH, PENALTY, SEED = 192, 3.0, 1e-3, 20240229
FOLDS = 4
THRESHOLD = 0.7

UPPER, LOWER, DIGIT, SPACE, LINE, STOP, COMMA, OTHER, WIDE, TAIL = range(10)
STATISTICS = (
    "upper", "lower", "digit", "space", "line", "stop", "comma", "other", "wide",
    "word_length", "long_word", "repeated_word", "same_byte", "edge_symbol", "log_words", "lone_symbol", "spread",
)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[65:91], out[97:123], out[48:58] = UPPER, LOWER, DIGIT
    out[[32, 9, 11, 12]], out[[10, 13]] = SPACE, LINE
    out[[46, 63]], out[44] = STOP, COMMA
    out[128:192], out[192:] = TAIL, WIDE
    return out


CLASSES = _classes()
_POWERS = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a run."""
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    if not len(raw):
        return out
    kind = CLASSES[raw]
    chars = np.maximum(1, segment_sums(kind != TAIL, offsets))
    for k in range(TAIL):
        out[:, k] = segment_sums(kind == k, offsets) / chars
    # words: runs of bytes that are not white space, cut at the ends of texts
    text_start = np.zeros(len(raw) + 1, np.bool_)
    text_start[offsets] = True
    inside = (kind != SPACE) & (kind != LINE)
    before = np.empty(len(raw), np.bool_)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | text_start[:-1]))
    if not len(starts):
        return out
    after = np.empty(len(raw), np.bool_)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | text_start[1:])) + 1
    length = ends - starts
    row = np.searchsorted(offsets, starts, side="right") - 1
    words = np.maximum(1, np.bincount(row, minlength=n))
    per_word = lambda x: np.bincount(row, x, minlength=n) / words
    first = np.repeat(starts, length)
    at = np.flatnonzero(inside)
    mixed = (raw[at].astype(np.uint64) + np.uint64(1)) * _POWERS[(at - first) & 63]
    mixed ^= mixed >> np.uint64(31)
    word = np.add.reduceat(mixed, np.concatenate(([0], np.cumsum(length)[:-1])))
    same = np.zeros(len(starts), np.bool_)
    same[1:] = (word[1:] == word[:-1]) & (length[1:] == length[:-1]) & (row[1:] == row[:-1])
    symbol = (kind == OTHER) | (kind == DIGIT)
    doubled = np.zeros(len(raw), np.bool_)
    doubled[1:] = (raw[1:] == raw[:-1]) & inside[1:] & ~text_start[1:-1]
    mean = per_word(length)
    out[:, 9] = np.log1p(mean)
    out[:, 10] = per_word(length > 20)
    out[:, 11] = per_word(same)
    out[:, 12] = segment_sums(doubled, offsets) / chars
    out[:, 13] = per_word(symbol[ends - 1])
    out[:, 14] = np.log1p(np.bincount(row, minlength=n))
    out[:, 15] = per_word(symbol[starts] & (length == 1))
    out[:, 16] = np.log1p(np.sqrt(np.maximum(0, per_word(length.astype(float) ** 2) - mean**2)))
    return out


def column_statistics(column: pa.Array) -> np.ndarray:
    out = np.zeros((len(column), len(STATISTICS)))
    for lo, hi, raw, offsets in text_slices(column):
        out[lo:hi] = statistics(raw, offsets)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        r = np.random.default_rng(SEED)
        w = r.normal(size=(x.shape[1], FEATURES)) / BANDWIDTH
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ w + r.uniform(0, 2 * np.pi, FEATURES)
        return np.column_stack([np.sqrt(2.0 / FEATURES) * np.cos(z), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), float(self.levels[0]))
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing levels to interpolate between."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order].astype(float)
    weight = np.ones(len(x)) if weight is None else weight[order]
    blocks: list[list[float]] = []  # mean, weight, least x, greatest x
    for a, b, c in zip(x, y, weight, strict=True):
        blocks.append([b, c, a, a])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            m, n, _, hi = blocks.pop()
            p = blocks[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * n) / (p[1] + n), p[1] + n, hi
    knots = np.array([v for b in blocks for v in (b[2], b[3])])
    return knots, np.repeat([b[0] for b in blocks], 2)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ridge weights of summed normal equations."""
    return np.linalg.solve(a + PENALTY / FEATURES * np.eye(len(b)), b)


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, label: str = "quality") -> Model:
    """Train on labelled rows for which allowed (an expression on labels) holds."""
    spark = docs.sparkSession
    short_batches(spark)
    width = len(STATISTICS)
    sample = labelled_sample(docs, labels, label, F.lit(True) if allowed is None else allowed, PER_CLASS, TRAIN_BYTES)

    @F.arrow_udf("array<double>")
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(list(column_statistics(batch)), pa.list_(pa.float64()))
        release()

    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    rows = materialize(sample.select("label", fold.alias("fold"), stats(F.col("text")).alias("x")), "quality-sample")
    sums = rows.select("label", *[F.col("x")[i].alias(f"x{i}") for i in range(width)]).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("label"), F.lit(0)).alias("good"),
        *[f(f"x{i}").alias(f"{k}{i}") for i in range(width) for k, f in (("m", F.avg), ("s", F.stddev_pop))],
    ).first()
    empty = np.zeros(0)
    if not 0 < sums.good < sums.n:
        share = sums.good / sums.n if sums.n else 1.0
        return Model(empty, empty, empty, empty, np.array([share]))
    mean = np.array([sums[f"m{i}"] for i in range(width)])
    scale = np.maximum([sums[f"s{i}"] for i in range(width)], 1e-6)
    bare = Model(mean, scale, empty, empty, empty)
    weight = {1: 0.5 / sums.good, 0: 0.5 / (sums.n - sums.good)}  # classes count alike

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((FOLDS, FEATURES + 1, FEATURES + 1)), np.zeros((FOLDS, FEATURES + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column("x").to_numpy(zero_copy_only=False))
            y, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "fold"))
            z, w = bare.features(x), np.where(y > 0, weight[1], weight[0])
            for k in range(FOLDS):
                of = own == k
                a[k] += (z[of] * w[of, None]).T @ z[of]
                b[k] += (z[of] * w[of, None]).T @ y[of]
        yield pa.RecordBatch.from_pydict({"fold": pa.array(range(FOLDS), pa.int32()), "a": pa.array(list(a.reshape(FOLDS, -1)), pa.list_(pa.float64())), "b": pa.array(list(b), pa.list_(pa.float64()))})

    # a bounded sample: few partitions
    parts = rows.mapInArrow(equations, "fold int, a array<double>, b array<double>").toLocalIterator()
    a, b = np.zeros((FOLDS, FEATURES + 1, FEATURES + 1)), np.zeros((FOLDS, FEATURES + 1))
    for part in parts:
        a[part.fold] += np.asarray(part.a).reshape(FEATURES + 1, -1)
        b[part.fold] += np.asarray(part.b)
    sample_rows = rows.toPandas()  # at most 2 * PER_CLASS rows
    x, y, own = np.stack(sample_rows["x"]), sample_rows["label"].to_numpy(), sample_rows["fold"].to_numpy()
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        other = Model(mean, scale, solve(a.sum(0) - a[k], b.sum(0) - b[k]), empty, empty)
        raw[own == k] = other.raw(x[own == k])
    named = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (F.lit(True) if allowed is None else allowed))
    total = {r.label: r.n for r in named.groupBy(F.col(label).cast("int").alias("label")).agg(F.countDistinct("doc_id").alias("n")).collect()}
    knots, levels = isotonic(raw, y, np.where(y > 0, total[1] / sums.good, total[0] / (sums.n - sums.good)))
    return Model(mean, scale, solve(a.sum(0), b.sum(0)), knots, levels)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted; input columns of these names are replaced."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(shared.value.scores(column_statistics(batch)), pa.float64())
        release()

    out = docs.withColumn("score", quality(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_held_out(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the held-out rows are never read for training."""
    model = train(docs, labels, crc_bucket(F.col("doc_id"), mod) != rest)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), mod) == rest).alias("held_out"), "score", "predicted")
