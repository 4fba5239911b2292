"""Near copies: SimHash links, tested on the whole sets of shingles and completed by a prefix-filtered set join.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of at least 4/5; groups
are the connected components of these links. All links count that the rule demands: the candidates are complete,
and each is tested on the whole sets.

First candidates: SimHash fingerprints of the sets within DISTANCE bits, from the Gray-order index of simhash.py.
They join most members of large groups at a cost in proportion to their number. Fingerprints alone cannot give all
pairs of that similarity (at 0.8 they differ by nine bits on average), so the rest of the candidates follows.

Other candidates: with the shingles of a set in one global order, two sets of that similarity share a shingle among
the first n - ceil(4n/5) + 1 of each. The order is by rarity (number of sets with the shingle, then its hash), so a
shingle that no other set has takes up a place and needs no group, and common lines come last. Pairs in a shingle's
group are left out if they are in one component by then, or if their sizes or the places of the shingle in both
exclude the similarity.

Before that, most texts are left out by a part of their sets. The part has the first n - ceil(4n/5) + k shingles by
hash alone, k a fifth of the set; two sets of that similarity share at least the smaller k of these, so a set of whose
part fewer than the least k of a similar set are shared with any other set has no near copy.

Who shares a shingle is found in buckets of shingles, whose number grows with the data, one at a time. Beyond MANY sets
the number of sets only matters as "many": a task that sees so many by itself sends them on without the bucket, dealt
by node, and tells the bucket, which holds no more than that of a common line. All such shingles come last in the order.

Large groups of a shingle: those of more than SMALL sets meet one common member first, then some more, and last all
members that are not in one component by then; pairs within a component need no test. So a group of thousands of near
copies takes a number of tests in proportion to its size, and no link that joins components is lost. A task streams
through such a group and holds only the common members.

Defined cases: words are what white space separates, A-Z taken as a-z; texts of fewer words than a shingle are one
shingle; null, empty and blank texts are one group; equal sets are one node of everything above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import MIX_A, MIX_B, materialize, mixed, release, short_batches, text_slices, word_hashes
from strandloom.llm.components import connected_components
from strandloom.llm.simhash import keep_first, links, row_key

SHINGLE = 5
#: Differing bits of the SimHash fingerprints that make first candidates.
DISTANCE = 6
SMALL = 16
#: Nodes whose ids are broadcast; more are joined by a shuffle.
BROADCAST_NODES = 2_000_000
#: Common members that all of a large group meet in each round; None: all meet all.
ROUNDS = (1, 8, 32, None)
#: Sets of a shingle that count as many, entries of a bucket, and entries that a task deals at a time.
MANY, BUCKET, CHUNK = 64, 400_000, 1_000_000
#: Rows that a task takes at a time when it pairs the members of groups.
_ROWS = 200_000
_WORD = np.ones(256, np.bool_)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a run, ascending, and each text's offset in them."""
    words, at = word_hashes(raw, offsets, _WORD)
    n = len(at) - 1
    have = np.diff(at)
    count = np.where(have > 0, np.maximum(have - SHINGLE + 1, 1), 0)
    own = np.repeat(np.arange(n), count)
    place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    first = at[own] + place
    h = np.zeros(len(own), np.uint64)
    for j in range(SHINGLE):
        inside = first + j < at[own + 1]
        h[inside] = (h[inside] + words[(first + j)[inside]]) * MIX_A + MIX_B
        h[~inside] = h[~inside] * MIX_B
    h = mixed(h)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), np.bool_)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[new], own[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]).astype(np.int64)


def fingerprints(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of each set of shingle hashes: a bit is 1 if set in over half of them; 0 for an empty set."""
    size = np.diff(ends)
    out = np.zeros(len(size), np.uint64)
    have = np.flatnonzero(size)
    if len(have):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts = np.add.reduceat(bits, ends[:-1][have], axis=0, dtype=np.int64)
        out[have] = np.packbits(counts * 2 > size[have, None], axis=1).view(">u8").ravel()
    return out


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offsets in text_slices(batch.column("text").cast(pa.string())):
            h, ends = shingle_sets(raw, offsets)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h), dtype=np.uint64)])
            node = mixed(total[ends[1:]] - total[ends[:-1]] + np.diff(ends).astype(np.uint64))
            sets = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("row_id")[a:b], batch.column("row_text")[a:b], batch.column("no_id")[a:b], pa.array(node.view(np.int64)), sets, pa.array(fingerprints(h, ends).view(np.int64))], ["row_id", "row_text", "no_id", "node", "shingles", "fp"])
    release()


_ENTRY = np.dtype([("h", "<u8"), ("node", "<u8"), ("n", "<u4")])
_SHARED = np.dtype([("h", "<u8"), ("node", "<u8"), ("n", "<u4"), ("sets", "<u4")])


#: What a block holds: entries of a bucket's shingles, entries whose shingle is known to be in many sets, or such shingles.
_ENTRIES, _KNOWN, _COMMON = 0, 1, 2
_BLOCKS = "bucket bigint, kind int, block binary"


def _dealt(rows: np.ndarray, by: str | None, buckets: int, kind: int = _ENTRIES) -> pa.RecordBatch:
    """Rows as one block of bytes for each bucket of a column (of the values themselves without one)."""
    bucket = ((rows[by] if by else rows) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(first, len(rows))[1:]
    blocks = [rows[a:b].tobytes() for a, b in zip(first, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int64()), pa.array(np.full(len(first), kind, np.int32)), pa.array(blocks, pa.binary())], ["bucket", "kind", "block"])


def _distinct(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in order of shingle and node without repeats, and of each the number of nodes with its shingle."""
    entries = entries[np.lexsort((entries["node"], entries["h"]))]
    new = np.ones(len(entries), np.bool_)
    new[1:] = (entries["h"][1:] != entries["h"][:-1]) | (entries["node"][1:] != entries["node"][:-1])
    entries = entries[new]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(entries)), np.bool_), entries["h"][1:] != entries["h"][:-1]]))
    size = np.diff(np.append(first, len(entries)))
    return entries, np.repeat(size, size)


def _with_sets(entries: np.ndarray, sets: np.ndarray | int) -> np.ndarray:
    out = np.empty(len(entries), _SHARED)
    for name in _ENTRY.names:
        out[name] = entries[name]
    out["sets"] = sets
    return out


def _least(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n shares with a similar one at least: ceil(4n/5)."""
    return (4 * n + 4) // 5


def _deal_entries(held: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of entries by shingle; those whose shingle is in many sets already go by node."""
    entries, size = _distinct(np.concatenate(held))
    many = size >= MANY
    if many.any():
        yield _dealt(_with_sets(entries[many], MANY), "node", buckets, _KNOWN)
        yield _dealt(np.unique(entries["h"][many]), None, buckets, _COMMON)
    yield _dealt(entries[~many], "h", buckets)


def _entry_batches(batches: Iterator[pa.RecordBatch], part: bool, buckets: int) -> Iterator[pa.RecordBatch]:
    """(node, shingles) -> blocks of entries of parts or whole sets; about CHUNK entries go out at a time."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        sets = batch.column("shingles")
        n = np.asarray(sets.value_lengths(), np.int64)
        entries = np.empty(int(n.sum()), _ENTRY)
        entries["h"] = sets.flatten().to_numpy().view(np.uint64)
        entries["node"] = np.repeat(batch.column("node").to_numpy().view(np.uint64), n)
        entries["n"] = np.repeat(n, n)
        if part:  # hashes ascend within a set
            place = np.arange(len(entries)) - np.repeat(np.cumsum(n) - n, n)
            entries = entries[place < np.repeat(n - _least(n) + (n + 4) // 5, n)]
        held.append(entries)
        size += len(entries)
        if size >= CHUNK:
            yield from _deal_entries(held, buckets)
            held, size = [], 0
    if size:
        yield from _deal_entries(held, buckets)
    release()


class _Bucket:
    """Entries of a bucket of shingles as they come; what is held is bounded by its shingles of fewer than MANY sets."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size, self.limit = buckets, [], 0, CHUNK
        self.common = np.zeros(0, np.uint64)

    def add(self, kind: int, block: bytes) -> Iterator[pa.RecordBatch]:
        if kind == _COMMON:
            self.common = np.union1d(self.common, np.frombuffer(block, np.uint64))
        elif kind == _KNOWN:
            yield _dealt(np.frombuffer(block, _SHARED), "node", self.buckets)
        else:
            self.held.append(np.frombuffer(block, _ENTRY))
            self.size += len(self.held[-1])
            if self.size > self.limit:
                yield from self._settle(False)

    def _settle(self, last: bool) -> Iterator[pa.RecordBatch]:
        entries, size = _distinct(np.concatenate(self.held))
        self.common = np.union1d(self.common, entries["h"][size >= MANY])
        many = np.isin(entries["h"], self.common)
        if many.any():
            yield _dealt(_with_sets(entries[many], MANY), "node", self.buckets)
        entries, size = entries[~many], size[~many]
        if last:
            if (size > 1).any():
                yield _dealt(_with_sets(entries[size > 1], size[size > 1]), "node", self.buckets)
        else:
            self.held, self.size = [entries], len(entries)
            self.limit = max(CHUNK, 2 * self.size)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield from self._settle(True)


def _shared_batches(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks in order of bucket -> blocks by node of the entries whose shingle several nodes have."""
    bucket, current = None, None
    for batch in batches:
        for number, kind, block in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("block"), strict=True):
            if number != current:
                if bucket is not None:
                    yield from bucket.close()
                bucket, current = _Bucket(buckets), number
            yield from bucket.add(kind, block.as_py())
    if bucket is not None:
        yield from bucket.close()
    release()


def _of_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Blocks in order of bucket -> the shared shingles of each bucket of nodes, by node, sets and shingle, without repeats."""
    held: list[np.ndarray] = []
    current = None

    def ordered() -> np.ndarray:
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows["h"], rows["sets"], rows["node"]))]
        new = np.ones(len(rows), np.bool_)
        new[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["node"][1:] != rows["node"][:-1])
        return rows[new]

    for batch in batches:
        for number, block in zip(batch.column("bucket").to_pylist(), batch.column("block"), strict=True):
            if number != current and held:
                yield ordered()
                held = []
            current = number
            held.append(np.frombuffer(block.as_py(), _SHARED))
    if held:
        yield ordered()


def _prefix_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared shingles of nodes -> (key, node, n, place) of those among the first of their node."""
    for rows in _of_nodes(batches):
        first = np.flatnonzero(np.concatenate([[True], rows["node"][1:] != rows["node"][:-1]]))
        size = np.diff(np.append(first, len(rows)))
        n = rows["n"].astype(np.int64)
        # shingles of this node alone come before all others
        place = np.arange(len(rows)) - np.repeat(first, size) + n - np.repeat(size, size)
        rows, n, place = (x[place < n - _least(n) + 1] for x in (rows, n, place))
        yield pa.RecordBatch.from_pydict({"key": rows["h"].view(np.int64), "node": rows["node"].view(np.int64), "n": n, "place": place})
    release()


def _suspect_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared shingles of parts of nodes -> the nodes that have enough of them."""
    for rows in _of_nodes(batches):
        node, first, count = np.unique(rows["node"], return_index=True, return_counts=True)
        enough = count >= (_least(rows["n"][first].astype(np.int64)) + 4) // 5
        yield pa.RecordBatch.from_pydict({"node": node[enough].view(np.int64)})
    release()


def _shared(rows: DataFrame, part: bool, bucket: int | None = None) -> DataFrame:
    """(node, shingles) -> blocks by node, in order of bucket, of the shingles that several nodes have in their sets, or in parts of them."""
    total = rows.agg(F.sum(F.size("shingles"))).first()[0] or 0
    buckets = max(64, total // (bucket or BUCKET))
    entries = rows.select("node", "shingles").mapInArrow(lambda batches: _entry_batches(batches, part, buckets), _BLOCKS)
    dealt = entries.repartition("bucket").sortWithinPartitions("bucket", F.col("kind").desc())
    return dealt.mapInArrow(lambda batches: _shared_batches(batches, buckets), _BLOCKS).repartition("bucket").sortWithinPartitions("bucket")


def suspects(rows: DataFrame) -> DataFrame:
    """(node, shingles, fp), nodes repeated or not -> the same, once for each node that can have near copies."""
    nodes = materialize(_shared(rows, True).mapInArrow(_suspect_batches, "node bigint"), "copies-suspects")
    if nodes.count() <= BROADCAST_NODES:
        nodes = F.broadcast(nodes)
    return materialize(rows.select("node", "shingles", "fp").join(nodes, "node", "left_semi").dropDuplicates(["node"]), "copies-sets")


def prefixes(sets: DataFrame) -> DataFrame:
    """(node, shingles) -> (key, node, n, place): the keys by which sets meet, n the set's size."""
    return _shared(sets, False).mapInArrow(_prefix_batches, "key bigint, node bigint, n bigint, place bigint")


def _fits(i: np.ndarray, j: np.ndarray, root: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which pairs of rows can be similar and are not in one component."""
    fits = (root[j] != root[i]) & (5 * np.minimum(n[j], n[i]) >= 4 * np.maximum(n[j], n[i]))
    return fits & (9 * np.minimum(n[j] - place[j], n[i] - place[i]) >= 4 * (n[j] + n[i]))


def pairs_of(table: np.ndarray, hubs: int | None) -> np.ndarray:
    """Rows (key, node, root, n, place) sorted by key and node -> pairs of nodes that can be similar, as two rows."""
    key, node, root, n, place = table
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    start, size = np.repeat(first, size), np.repeat(size, size)
    at = np.arange(len(key)) - start
    all_meet = np.ones(len(key), np.bool_) if hubs is None else size <= SMALL
    found = [np.zeros((2, 0), np.int64)]
    step, i = 1, np.flatnonzero(all_meet & (at + 1 < size))
    while len(i):
        good = _fits(i, i + step, root, n, place)
        found.append(node[np.stack([i[good], i[good] + step])])
        step += 1
        i = i[at[i] + step < size[i]]
    for hub in range(hubs or 0):
        j = np.flatnonzero(~all_meet & (at > hub))
        i = start[j] + hub
        good = _fits(i, j, root, n, place)
        found.append(node[np.stack([i[good], j[good]])])
    return np.concatenate(found, axis=1)


def _pair_batches(batches: Iterator[pa.RecordBatch], hubs: int | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and node -> distinct (u, v), as far as they come together."""
    held: list[np.ndarray] = []

    def flush(last: bool) -> pa.RecordBatch:
        table = np.concatenate([np.zeros((5, 0), np.int64), *held], axis=1)
        open_ = 0 if last or not table.shape[1] else table.shape[1] - int(np.argmax(table[0] == table[0][-1]))
        done = table.shape[1] - open_
        if hubs is not None and open_ > max(SMALL, hubs):
            # the last group goes on: of a large one, its common members are all that the rest needs
            done = table.shape[1]
            rest = table[:, done - open_ : done - open_ + hubs]
        else:
            rest = table[:, done:]
        held[:] = [rest]
        u, v = np.unique(pairs_of(table[:, :done], hubs), axis=1) if done else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_pydict({"u": u, "v": v})

    new = 0
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in ("key", "node", "root", "n", "place")]))
        new += batch.num_rows
        if new >= _ROWS:
            yield flush(False)
            new = 0
    yield flush(True)
    release()


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of (u, v) whose sets have a similarity of at least 4/5."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    met = pairs.join(left, "u").join(right, "v")
    return met.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def simhash_links(sets: DataFrame) -> DataFrame:
    """(node, shingles, fp) -> links (u, v) that the SimHash index proposes and the whole sets confirm."""
    fps = materialize(sets.groupBy("fp").agg(F.min("node").alias("first")), "copies-fps")
    near = links(fps.select("fp"), distance=DISTANCE)
    left = fps.select(F.col("fp").alias("u"), F.col("first").alias("a"))
    right = fps.select(F.col("fp").alias("v"), F.col("first").alias("b"))
    proposed = near.join(left, "u").join(right, "v").select("a", "b")
    equal = sets.select("fp", "node").join(fps, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    pairs = proposed.unionByName(equal).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    return _similar(materialize(pairs, "copies-proposed"), sets)


def roots(rows: DataFrame) -> DataFrame:
    """(node, shingles, fp), nodes repeated or not -> (node, root) of all nodes that have a near copy."""
    sets = suspects(rows)
    held = materialize(prefixes(sets), "copies-prefixes")
    found = materialize(simhash_links(sets), "copies-simhash")
    linked = materialize(connected_components(found, "copies-edges"), "copies-roots")
    for round_, hubs in enumerate(ROUNDS):
        asked = held.join(linked.select("node", F.col("root").alias("r")), "node", "left").withColumn("root", F.coalesce("r", "node")).select("key", "node", "root", "n", "place")
        if round_:
            # groups of a few members are done; so are those of a single component
            open_ = asked.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where((F.col("size") > SMALL) & (F.col("lo") < F.col("hi")))
            asked = materialize(asked.join(open_.select("k"), F.col("key") == F.col("k"), "left_semi"), "copies-open")
            if not asked.take(1):
                break
        dealt = asked.repartition("key").sortWithinPartitions("key", "node")
        pairs = dealt.mapInArrow(lambda batches, hubs=hubs: _pair_batches(batches, hubs), "u bigint, v bigint").distinct()
        found = materialize(found.unionByName(_similar(materialize(pairs, "copies-pairs"), sets)), "copies-links")
        linked = materialize(connected_components(found, "copies-edges"), "copies-roots")
    return linked


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one row of each group of near copies, chosen like simhash.keep_one."""
    short_batches(docs.sparkSession)
    tagged = docs.select(*row_key(F.col("doc_id"), F.col(text)), F.col("doc_id").isNull().alias("no_id"), F.col(text).cast("string").alias("text"))
    rows = materialize(tagged.mapInArrow(_set_batches, "row_id bigint, row_text bigint, no_id boolean, node bigint, shingles array<bigint>, fp bigint"), "copies-rows")
    named = roots(rows).select("node", F.col("root").alias("r"))
    rows = rows.drop("shingles", "fp").join(named, "node", "left").withColumn("root", F.coalesce("r", "node"))
    return keep_first(docs, rows, text)
