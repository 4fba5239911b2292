"""Helpers that the corpus operators share: tables, shared scratch space, labelled samples, batches."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch between the JVM and Python. Whole texts go over, so batches stay short.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch length where the session still has Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one in spark.checkpoint.dir. Only a session without that setting (tests, local mode)
    gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/strandloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the session may be gone already
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str | None:
    """The plain path of a file: or scheme-less location, else None."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def filesystem(path: str):
    """(pyarrow file system, path in it) for a location in the shared folder; runs on executors too."""
    import pyarrow.fs as fs

    plain = local_path(path)
    if plain is not None:
        return fs.LocalFileSystem(), plain
    return fs.FileSystem.from_uri(path)


def crc_bucket(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int, max_bytes: int) -> DataFrame:
    """At most per_class labelled documents of each class, as (doc_id, text, label).

    Rows are taken by the hash of doc_id, so that the choice does not depend on partitioning. Ids with
    contradicting labels, null ids, null texts and texts of more than max_bytes bytes are not used for
    training. The ids are bounded by 2 * per_class, hence the broadcast; rows of a repeated id count once.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & allowed)
        .groupBy("doc_id")
        .agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
        .where("lo = hi")
        .select("doc_id", F.col("lo").cast("int").alias("label"), F.xxhash64("doc_id").alias("h"))
    )
    picked = None
    for value in (0, 1):
        part = ids.where(F.col("label") == value).orderBy("h", "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = [(r.doc_id, r.label) for r in picked.collect()]
    spark = docs.sparkSession
    chosen = spark.createDataFrame(rows, "doc_id bigint, label int")
    return (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
    )


def text_slices(column: pa.Array, most_bytes: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about most_bytes.

    Yields (first row, end row, bytes of the run, offset of each row in it and of its end). Nulls are
    empty. A single longer text is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(ends, ends[at] + most_bytes, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, raw[ends[at] : ends[end]], ends[at : end + 1] - ends[at]
        at = end


_libc: list = []


def release() -> None:
    """Give memory that Python no longer uses back to the system: workers live on between stages."""
    import ctypes

    if not _libc:
        try:
            _libc.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):  # another C library: nothing to do
            _libc.append(lambda _: 0)
    _libc[0](0)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values in each [offsets[i], offsets[i+1])."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


#: Odd multipliers of 64-bit hashes.
MIX_A, MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUES = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * MIX_A
    h ^= h >> np.uint64(29)
    h *= MIX_B
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a run of texts, A-Z taken as a-z, and each text's offset in words.

    is_word: for each byte value, whether it belongs to words.
    """
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    inside = is_word[raw]
    border = np.zeros(len(raw) + 1, np.bool_)
    border[offsets] = True
    before = np.empty(len(raw), np.bool_)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    length = np.diff(np.append(first, len(at)))
    longest = int(length.max())
    if len(_powers[0]) < longest:
        p = np.full(max(64, longest), np.uint64(0x9E3779B97F4A7C15))
        p[0] = 1
        _powers[0] = np.cumprod(p, dtype=np.uint64)
    place = np.arange(len(at)) - np.repeat(first, length)
    values = _BYTE_VALUES[_LOWER[raw[at]]] * _powers[0][place]
    words = mixed(np.add.reduceat(values, first) + length.astype(np.uint64))
    return words, np.searchsorted(starts, offsets)
