"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are 64-bit SimHashes of word shingles. Those within a distance (DISTANCE differing bits, unless
given) are linked, and documents are grouped by the connected components of the links.

The index: two fingerprints within three bits agree on at least one of four blocks of bits, so the top
nodes of the hierarchy are the (block, value) groups; for more bits they are those of two of distance + 2
blocks. In a group the remaining bits are sorted by Gray
rank, which puts fingerprints that share long bit patterns side by side; runs of them form nodes that keep
the bits on which all members agree, and nodes of nodes above them. A pair of nodes whose differences on
commonly agreed bits exceed the distance is pruned with everything below it; so is a pair whose members
are known to be in one component already. Only links that join components leave a group: the output is
linear in the input, also in groups of thousands of near copies, and no component is lost.

A top group with more than GROUP_ROWS fingerprints is dealt to finer groups by the same argument on its
remaining bits, again and again until it fits or too few bits are left for as many fingerprints, so no task
needs a whole hot group. Equal fingerprints are one node of everything above, however many documents have them.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; texts of
fewer words than a shingle are one shingle; a null doc_id never is a component's id unless all are null;
repeated rows are rows of one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import materialize, release, short_batches
from strandloom.llm.components import connected_components

DISTANCE = 3
SHINGLE = 3
SEED = 42
GROUP_ROWS = 20_000
_LEAF, _FAN, _STEP, _BATCH_ROWS = 8, 4, 400_000, 200_000

_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)
_COLUMNS = np.arange(8) * 256


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text, as an unsigned number."""
    import xxhash

    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[: n - shingle].tolist()]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)])
    bytes_at = np.frombuffer(hashes, np.uint8).reshape(-1, 8) + _COLUMNS
    counts = np.bincount(bytes_at.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = counts.ravel() * 2 > n - shingle + 1
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed 64-bit column."""
    short_batches(docs.sparkSession)

    @F.arrow_udf("bigint")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [fingerprint(x) for x in batch.cast(pa.binary()).to_pylist()]
            yield pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
        release()

    return docs.withColumn(name, simhash(F.col(text)))


def gray_rank(bits: Column) -> Column:
    """Position of a bit pattern in Gray order, as an unsigned number in a signed column."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, shift))
    return bits


def _blocks(rows: DataFrame, width: int, count: int, pick: int) -> DataFrame:
    """(key, fp, bits) -> a row for each choice of pick of count blocks of the lowest width bits, moved from bits to key."""
    size = -(-width // count)
    cuts = [(max(0, high - size), high) for high in range(width, 0, -size)]
    bits = F.col("bits")
    parts = []
    for chosen in combinations(range(len(cuts)), pick):
        value = [F.shiftrightunsigned(bits, cuts[i][0]).bitwiseAND(F.lit((1 << (cuts[i][1] - cuts[i][0])) - 1).cast("bigint")) for i in chosen]
        rest, at = F.lit(0).cast("bigint"), 0
        for i in reversed([i for i in range(len(cuts)) if i not in chosen]):  # the other blocks close up
            low, high = cuts[i]
            block = F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("bigint"))
            rest = rest.bitwiseOR(F.shiftleft(block, at))
            at += high - low
        parts.append(F.struct(F.xxhash64("key", *[F.lit(i) for i in chosen], *value).alias("key"), "fp", rest.alias("bits")))
    return rows.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def grouped(fps: DataFrame, group_rows: int = GROUP_ROWS, distance: int = DISTANCE) -> DataFrame:
    """(fp) -> (key, fp, bits): the top nodes of the index; those of more than group_rows rows are dealt again.

    Of distance + p blocks, p at least are equal in any two fingerprints within distance. One block is
    long enough a key for three bits; more take two of distance + 2 blocks.
    """
    pick = 1 if distance <= 3 else 2
    width = 64
    rows = _blocks(fps.select(F.lit(0).cast("bigint").alias("key"), "fp", F.col("fp").alias("bits")), width, distance + pick, pick)
    width -= pick * -(-width // (distance + pick))
    done, level = None, 0
    while width >= 2 * (distance + 1) and group_rows < 1 << width:
        level += 1
        hot = materialize(rows.groupBy("key").count().where(F.col("count") > group_rows).select(F.col("key").alias("hot")), "simhash-hot")
        if not hot.take(1):
            break
        rows = materialize(rows.join(hot, F.col("key") == F.col("hot"), "left"), f"simhash-level-{level}")
        calm = rows.where("hot is null").drop("hot")
        done = calm if done is None else done.unionByName(calm)
        rows = _blocks(rows.where("hot is not null").drop("hot"), width, distance + 1, 1)
        width -= -(-width // (distance + 1))
    return rows if done is None else done.unionByName(rows)


def _ragged(first_a, n_a, first_b, n_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (x, y) of the ranges of each pair, and the pair they come from."""
    n = n_a * n_b
    pair = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    return first_a[pair] + k // n_b[pair], first_b[pair] + k % n_b[pair], pair


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give both ends of each edge the smaller label, and all that share theirs."""
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        if not len(i):
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


class _Level:
    """Nodes of one level: the range below, the agreed bits and their values."""

    def __init__(self, first: np.ndarray, size: np.ndarray, all_: np.ndarray, any_: np.ndarray, group: np.ndarray):
        self.first, self.size, self.group = first, size, group
        self.all, self.any = np.bitwise_and.reduceat(all_, first), np.bitwise_or.reduceat(any_, first)
        self.mask = ~(self.all ^ self.any)


def _runs(group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of at most size within each group of a sorted array."""
    new = np.concatenate([[True], group[1:] != group[:-1]])
    start = np.flatnonzero(new)
    place = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
    first = np.flatnonzero(place % size == 0)
    return first, np.diff(np.append(first, len(group)))


def link(key: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For rows sorted by key and Gray rank: the place of a row in the same component of the links within a key."""
    n = len(key)
    label = np.arange(n)
    if n < 2:
        return label
    first, size = _runs(key, _LEAF)
    levels = [_Level(first, size, fp, fp, key[first])]
    while len(levels[-1].first) > len(np.unique(levels[-1].group)):
        below = levels[-1]
        first, size = _runs(below.group, _FAN)
        levels.append(_Level(first, size, below.all, below.any, below.group[first]))
    roots = np.arange(len(levels[-1].first))
    stack = [(len(levels) - 1, roots, roots)]
    same: list[np.ndarray] = []

    def refresh() -> None:
        """For each level's nodes: the label that all members have, or -1."""
        low = high = label
        same.clear()
        for level in levels:
            low, high = np.minimum.reduceat(low, level.first), np.maximum.reduceat(high, level.first)
            same.append(np.where(low == high, low, -1))

    refresh()
    while stack:
        depth, a, b = stack.pop()
        level = levels[depth]
        open_ = (same[depth][a] < 0) | (same[depth][a] != same[depth][b])
        open_ &= np.bitwise_count((level.all[a] ^ level.all[b]) & level.mask[a] & level.mask[b]) <= distance
        a, b = a[open_], b[open_]
        if not len(a):
            continue
        cost = np.cumsum(level.size[a] * level.size[b])
        if cost[-1] > _STEP and len(a) > 1:
            cut = max(1, int(np.searchsorted(cost, _STEP)))
            stack.append((depth, a[cut:], b[cut:]))
            a, b = a[:cut], b[:cut]
        x, y, pair = _ragged(level.first[a], level.size[a], level.first[b], level.size[b])
        keep = (x < y) if depth == 0 else (x <= y)
        keep |= (a != b)[pair]
        x, y = x[keep], y[keep]
        if depth:
            # nearest pairs first, so that components close early
            far = np.argsort(x - y, kind="stable")
            stack.append((depth - 1, x[far[::-1]], y[far[::-1]]))
            continue
        near = np.bitwise_count(fp[x] ^ fp[y]) <= distance
        if near.any():
            _unite(label, x[near], y[near])
            if stack:
                refresh()
    return label


def _link_batches(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    keys: list[np.ndarray] = []
    fps: list[np.ndarray] = []

    def flush(last: bool) -> pa.RecordBatch | None:
        key, fp = np.concatenate(keys), np.concatenate(fps)
        cut = len(key) if last else int(np.searchsorted(key, key[-1]))
        keys[:], fps[:] = [key[cut:]], [fp[cut:]]
        label = link(key[:cut], fp[:cut].view(np.uint64), distance)
        moved = np.flatnonzero(label != np.arange(cut))
        return pa.RecordBatch.from_pydict({"u": fp[moved], "v": fp[label[moved]]})

    held, enough = 0, _BATCH_ROWS
    for batch in batches:
        keys.append(batch.column("key").to_numpy())
        fps.append(batch.column("fp").to_numpy())
        held += batch.num_rows
        if held >= enough:
            yield flush(False)
            held = len(keys[0])
            enough = max(_BATCH_ROWS, 2 * held)  # a group that goes on is put together again only when it has doubled
    if keys:
        yield flush(True)
    release()


def links(fps: DataFrame, group_rows: int = GROUP_ROWS, distance: int = DISTANCE) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) that connect all that can reach one another."""
    rows = grouped(fps, group_rows, distance).select("key", "fp", gray_rank(F.col("bits")).alias("rank"))
    ordered = rows.repartition("key").sortWithinPartitions("key", F.col("rank").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")))
    return ordered.select("key", "fp").mapInArrow(lambda batches: _link_batches(batches, distance), "u bigint, v bigint")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two columns, never null, that tell rows apart by id and text."""
    return [F.coalesce(doc_id.cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("row_id"), F.xxhash64(text.isNull(), text).alias("row_text")]


def _components(docs: DataFrame, text: str, group_rows: int, distance: int) -> DataFrame:
    """(doc_id, row_id, row_text, fp, root, component_id) for every row of docs."""
    tagged = docs.select("doc_id", *row_key(F.col("doc_id"), F.col(text)), F.col(text).alias("text"))
    rows = materialize(with_fingerprint(tagged).drop("text"), "simhash-rows")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    roots = connected_components(links(fps.select("fp"), group_rows, distance), "simhash-edges")
    member = materialize(roots.join(fps, F.col("node") == F.col("fp")).select("fp", "root", "least"), "simhash-members")
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    found = member.join(ids, "root").select(F.col("fp").alias("linked"), "root", "component_id")
    id_ = F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id")
    component = fps.join(found, F.col("fp") == F.col("linked"), "left").select("fp", F.coalesce("root", "fp").alias("root"), id_)
    # written, so that the join below reads both sides straight from a shuffle and a hot fingerprint can be split
    return rows.join(materialize(component, "simhash-components"), "fp")


def near_duplicates(docs: DataFrame, text: str = "text", group_rows: int = GROUP_ROWS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    return _components(docs, text, group_rows, distance).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest doc_id, nulls last.

    If rows with different texts share that id, the one with the smallest hash of its text stays; of rows
    that are repeated whole, one. Documents are shuffled once, by id and text (again, if rows are repeated whole).
    """
    rows = _components(docs, text, GROUP_ROWS, distance).withColumn("no_id", F.col("doc_id").isNull())
    return keep_first(docs, rows, text)


def keep_first(docs: DataFrame, rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that keep_one keeps; rows: (no_id, row_id, row_text, root) of each row."""
    columns = docs.columns
    first = F.struct("no_id", "row_id", "row_text")
    alike = rows.groupBy("root", first.alias("r")).agg(F.count("*").alias("n"))
    kept = alike.groupBy("root").agg(F.min(F.struct("r", "n")).alias("k"))
    kept = materialize(kept.select(F.col("k.r.row_id").alias("__row_id"), F.col("k.r.row_text").alias("__row_text"), F.col("k.n").alias("n")), "simhash-kept")
    keys = dict(zip(("__row_id", "__row_text"), row_key(F.col("doc_id"), F.col(text)), strict=True))
    held = docs.withColumns(keys)

    def matching(chosen: DataFrame) -> DataFrame:
        # texts stream past hashed keys: they are dealt once, neither sorted nor held
        return held.join(chosen.drop("n").hint("shuffle_hash"), list(keys), "left_semi")

    out = matching(kept.where("n = 1"))
    repeated = kept.where("n > 1")
    if repeated.take(1):
        out = out.unionByName(matching(repeated).dropDuplicates(list(keys)))
    return out.select(columns)
