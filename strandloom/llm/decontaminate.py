"""Benchmark decontamination by winnowing.

Of the K-gram hashes of words, the smallest in each run of SPAN of them is kept as a fingerprint, so any
WINDOW = K + SPAN - 1 words that a document shares with an item hold a common fingerprint. Document
fingerprints are joined with the items' fingerprints, and each place that meets one is extended: the windows
of WINDOW words around it are held against the items' windows, and those that are equal mark their words as
hit; equal windows side by side give longer runs. A place is extended once, however many places of items have
its fingerprint, so repeated words cost no more than others. An item of fewer words is a window as a whole
and is found by the hash of its whole word sequence.

The items' index is broadcast when the items' texts are within INDEX_BYTES. Beyond, it is cut into parts
of about that size, written to the shared folder, and every task takes the parts one after the other for
each CHUNK_BYTES of its documents, which are neither shuffled nor read again.

Words are compared by 64-bit hashes. Defined cases: a null or wordless text has no words and no hits, and
a wordless item no window; items without an id take no part; rows with the same item_id are one item;
repeated document rows each get their result.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import filesystem, mixed, release, shared_path, short_batches, text_slices, word_hashes

WINDOW, K = 10, 5
SPAN = WINDOW - K + 1
INDEX_BYTES = 24_000_000
#: Text that a task holds while it takes the parts of a large index one after the other.
CHUNK_BYTES = 48_000_000
RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string"
_BITS = 20

WORD_BYTE = np.zeros(256, np.bool_)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


def _gram_at(words: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each start."""
    h = words[start]
    for j in range(1, k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += words[start + j]
    return mixed(h)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += words[j : j + n]
    return mixed(h)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each run of width values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def fingerprints(grams: np.ndarray) -> np.ndarray:
    """Positions of the hashes that are smallest in some run of SPAN; all of them if there are fewer."""
    if len(grams) <= SPAN:
        return np.arange(len(grams))
    least = _sliding(grams, SPAN, np.minimum)
    edge = np.zeros(SPAN - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), SPAN, np.maximum) == grams)


def _grouped(hashes: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, item) pairs -> distinct hashes, each one's first place in the items of all, and these, with an end."""
    pairs = np.unique(np.stack([hashes, items.astype(np.uint64)], axis=1), axis=0) if len(hashes) else np.zeros((0, 2), np.uint64)
    every, first = np.unique(pairs[:, 0], return_index=True)
    return every, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64)


class _Table:
    """Hashes of windows, and for each the number of the set of items that have it."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray):
        self.hashes, first, items = _grouped(hashes, items)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(items.astype(np.uint64) + np.uint64(1)), dtype=np.uint64)])
        _, one, self.sets = np.unique(total[first[1:]] - total[first[:-1]], return_index=True, return_inverse=True)
        self.members = [items[first[i] : first[i + 1]] for i in one]
        self.bitmap = _bitmap(self.hashes)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h of known hashes, and the numbers of their sets of items."""
        near, where = _known(self.bitmap, self.hashes, h)
        return near, self.sets[where]


def _bitmap(h: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _BITS, np.bool_)
    out[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return out


def _known(bitmap: np.ndarray, hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in h of values that the sorted hashes have, and their places there."""
    near = np.flatnonzero(bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
    if not len(hashes):
        return near[:0], near[:0]
    where = np.minimum(np.searchsorted(hashes, h[near]), len(hashes) - 1)
    same = hashes[where] == h[near]
    return near[same], where[same]


class Index:
    """Fingerprints of items, and their windows."""

    def __init__(self, ids: list, texts: list[str]):
        words: list[np.ndarray] = []
        for _, _, raw, offsets in text_slices(pa.array(texts, pa.large_string())):
            h, at = word_hashes(raw, offsets, WORD_BYTE)
            words += np.split(h, at[1:-1])
        self.ids = [str(i) for i in ids]
        size = np.array([len(w) for w in words], np.int64)
        long_ = np.flatnonzero(size >= WINDOW)
        grams = [gram_hashes(words[i], K) for i in long_]
        self.prints = np.unique(np.concatenate([np.zeros(0, np.uint64), *[g[fingerprints(g)] for g in grams]]))
        self.bitmap = _bitmap(self.prints)
        windows = np.concatenate([np.zeros(0, np.uint64), *[gram_hashes(words[i], WINDOW) for i in long_]])
        self.windows = _Table(windows, np.repeat(long_, size[long_] - WINDOW + 1))
        self.short = {}
        for m in sorted({int(s) for s in size if 0 < s < WINDOW}):
            which = np.flatnonzero(size == m)
            self.short[m] = _Table(np.array([gram_hashes(words[i], m)[0] for i in which], np.uint64), which)

    def hits(self, words: np.ndarray, at: np.ndarray, delta: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Mark the hit runs of words in delta (+1 at a start, -1 after an end); (row, places of items) that hit."""
        out = []

        def mark(table: _Table, start: np.ndarray, sets: np.ndarray, m: int) -> None:
            np.add.at(delta, start, 1)
            np.add.at(delta, start + m, -1)
            row = np.searchsorted(at, start, side="right") - 1
            for r, s in np.unique(np.stack([row, sets]), axis=1).T.tolist():
                out.append((r, table.members[s]))

        def inside(start: np.ndarray, m: int) -> np.ndarray:
            return start + m <= at[np.searchsorted(at, start, side="right")]

        if len(self.prints):
            grams = gram_hashes(words, K)
            chosen = fingerprints(grams)
            met = chosen[_known(self.bitmap, self.prints, grams[chosen])[0]]
            start = np.unique(met[:, None] - np.arange(SPAN))
            start = start[(start >= 0) & (start < len(words))]
            start = start[inside(start, WINDOW)]
            where, sets = self.windows.find(_gram_at(words, start, WINDOW))
            mark(self.windows, start[where], sets, WINDOW)
        for m, table in self.short.items():
            start, sets = table.find(gram_hashes(words, m))
            good = inside(start, m)
            mark(table, start[good], sets[good], m)
        return out


class _Stored:
    """Index parts in the shared folder, loaded one at a time."""

    def __init__(self, paths: list[str]):
        self.paths = paths

    def __iter__(self) -> Iterator[Index]:
        import pickle

        for path in self.paths:
            fs, plain = filesystem(path)
            with fs.open_input_stream(plain) as f:
                yield pickle.loads(f.read())


def build_index(items: DataFrame, most_bytes: int = INDEX_BYTES):
    """The items' index: a list to broadcast, or parts in the shared folder if their texts are larger than most_bytes."""
    spark = items.sparkSession
    used = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = used.agg(F.coalesce(F.sum(F.octet_length("text") + 40), F.lit(0)).alias("bytes")).first().bytes
    if size <= most_bytes:
        rows = used.collect()
        return [Index([r.item_id for r in rows], [r.text for r in rows])]
    folder = shared_path(spark, "benchmark-index")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        ids, texts = [], []
        for batch in batches:
            ids += batch.column("item_id").to_pylist()
            texts += batch.column("text").to_pylist()
        if ids:
            path = f"{folder}/part-{TaskContext.get().partitionId()}"
            fs, plain = filesystem(path)
            fs.create_dir(plain.rpartition("/")[0], recursive=True)
            buffer = io.BytesIO()
            pickle.dump(Index(ids, texts), buffer)
            with fs.open_output_stream(plain) as f:  # a task that runs again writes the same part again
                f.write(buffer.getvalue())
            yield pa.RecordBatch.from_pydict({"path": [path]})

    parts = used.repartition(int(size // most_bytes) + 1, F.xxhash64("item_id", "text")).mapInArrow(write, "path string")
    return _Stored(sorted(r.path for r in parts.collect()))


def results(columns: list[pa.Array], parts) -> list[pa.StructArray]:
    """The result of each column of texts; each part of the index is taken once for all of them."""
    runs = []
    for c, column in enumerate(columns):
        for lo, hi, raw, offsets in text_slices(column):
            words, at = word_hashes(raw, offsets, WORD_BYTE)
            runs.append((c, hi - lo, words, at, np.zeros(len(words) + 1, np.int64), {}))
    for part in parts:
        for _, _, words, at, delta, found in runs:
            for row, items in part.hits(words, at, delta):
                found.setdefault(row, set()).update(part.ids[i] for i in items)
    out: list[list] = [[] for _ in columns]
    for c, n, _, at, delta, found in runs:
        hit = np.concatenate([[0], np.cumsum(np.cumsum(delta[:-1]) > 0)])
        ids = [sorted(found.get(row, ())) for row in range(n)]
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]
        out[c].append(pa.StructArray.from_arrays([pa.array(np.diff(at), pa.int64()), pa.array(hit[at[1:]] - hit[at[:-1]], pa.int64()), pa.array(list(map(len, ids)), pa.int64()), pa.array(digests, pa.string())], ["n_words", "n_hit", "n_items", "items_sha256"]))
    empty = pa.array([], pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string())]))
    return [pa.concat_arrays(x) if x else empty for x in out]


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated; input columns of these names are replaced."""
    spark = docs.sparkSession
    short_batches(spark)
    parts = build_index(items, index_bytes)
    shared = spark.sparkContext.broadcast(parts)

    @F.arrow_udf(RESULT)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held: list[pa.Array] = []
        most = 0 if isinstance(shared.value, list) else CHUNK_BYTES
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= most:
                yield from results(held, shared.value)
                held.clear()
        yield from results(held, shared.value)
        release()

    names = [f.split()[0] for f in RESULT.split(", ")]
    out = docs.drop(*names, "contaminated").withColumn("__hit", scan(F.col(text)))
    return out.select("*", *[F.col("__hit")[x].alias(x) for x in names], (F.col("__hit.n_hit") > 0).alias("contaminated")).drop("__hit")
