"""Exact top-k inner-product search over norm-sorted blocks.

Vectors are cut into groups of blocks by descending length. A group is searched for a block of queries in
that order: a vector is passed over when the product of lengths cannot reach the query's k-th best score
so far, or when a partial sum over the first rotated dimensions plus the Cauchy-Schwarz bound of the
residuals cannot; there are two such sums, the longer for what the shorter leaves open. The rotation is that
of the singular vectors (from a Gram matrix, fitted on about ROTATION_ROWS vectors; it has no effect on the
results), so the first dimensions carry most of the sums. What passes is scored exactly, in integers.

Every query first meets the block of the longest vectors, which gives it a threshold, and with it the least
length that a vector needs to reach it. Queries are sorted by that length into blocks of their own, and a
block of vectors is sent to a block of queries only if its longest is long enough. A block of queries is as
large as a task can hold and searched in tiles; numbers travel in the smallest integer type that holds them
all. Each (query block, group) is one unit of work that sends on at most k rows a query; no task or driver
holds all vectors.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take
no part; shorter vectors count as padded with zeros; all rows with the query's id are its own; a query row
that is repeated whole is answered once, rows with one id and different vectors are queries of their own,
each with its ranks; repeated candidate rows each take a rank; scores beyond the long range stay at its ends.
More columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import materialize

K = 20
BLOCK, GROUP_BLOCKS = 2048, 8
#: Queries in a block at most (a block of vectors is sent to each), and those of them that are searched at once.
QUERIES, TILE = 1 << 14, 1024
#: Units of work from which groups grow, up to MOST_GROUP_BLOCKS: fewer groups send on fewer candidates a query.
UNITS, MOST_GROUP_BLOCKS = 4096, 64
#: Numbers in a block at most (but for 64 rows), whatever the dimensions.
BLOCK_CELLS = 1 << 22
#: Vectors that the rotation is fitted on, about; all, if there are fewer.
ROTATION_ROWS = 100_000
#: Cells of all Gram matrices in flight; the partial sums run over one dimension in HEAD.
GRAM_CELLS, HEAD = 1 << 24, 4
#: Relative error allowed in bounds.
SLACK = 1e-6
EXACT = 2.0**52
_LONG = 2**63


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Integer vectors as rows, padded with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy()
    out = np.zeros((len(column), dims), np.int64)
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _values(data: bytes, rows: int, dims: int, number: type) -> np.ndarray:
    """Packed integer vectors as rows of 64-bit integers."""
    return np.frombuffer(data, number).reshape(rows, dims).astype(np.int64)


def rotation(vectors: DataFrame, dims: int, head: int, n: int) -> np.ndarray | None:
    """Leading right singular vectors by falling singular value, fitted on all of n vectors or on about ROTATION_ROWS.

    Any orthogonal directions give right results; those of the sample only decide how early the sums can stop.
    Each of a few tasks sends one Gram matrix.
    """
    if dims < 2:
        return None
    sample = vectors.select("vec_id", "v")
    if n > ROTATION_ROWS:
        sample = sample.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < F.lit(int(ROTATION_ROWS / n * (1 << 40))))

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            m = _matrix(batch.column("v"), dims).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_pydict({"g": pa.array([total.tobytes()], pa.binary())})

    tasks = int(min(8, max(1, GRAM_CELLS // dims**2)))
    total = np.zeros((dims, dims))
    for row in sample.repartition(tasks, "vec_id").mapInArrow(gram, "g binary").toLocalIterator(prefetchPartitions=True):
        total += np.frombuffer(row.g).reshape(dims, dims)
    if not np.isfinite(total).all():
        return None
    _, basis = np.linalg.eigh(total)
    return np.ascontiguousarray(basis[:, ::-1][:, :head])


def smallest_integer(least: int, greatest: int) -> type:
    """The smallest integer type that holds both numbers."""
    return next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and greatest <= np.iinfo(t).max)


def _pack(rows_a_block: int, dims: int, edge: str, scalars: dict[str, type], number: type):
    """Rows in order -> blocks of at most rows_a_block rows: (part, k, lo, hi, values, and the scalars as bytes).

    lo and hi: least and greatest edge of the rows; the values are numbers of the given type.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        held: dict[str, list[np.ndarray]] = {c: [] for c in (edge, *scalars, "v")}

        def block(n: int) -> pa.RecordBatch:
            whole = {c: np.concatenate(x) for c, x in held.items()}
            for c, x in whole.items():
                held[c][:] = [x[n:]]
            edges = whole[edge][:n]
            out = {"part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int32()), "lo": [float(edges.min())], "hi": [float(edges.max())], "values": pa.array([whole["v"][:n].astype(number).tobytes()], pa.binary())}
            return pa.RecordBatch.from_pydict(out | {c: pa.array([whole[c][:n].astype(t).tobytes()], pa.binary()) for c, t in scalars.items()})

        rows = 0
        for batch in batches:
            for c in held:
                held[c].append(_matrix(batch.column("v"), dims).astype(number) if c == "v" else batch.column(c).to_numpy())
            rows += batch.num_rows
            while rows >= rows_a_block:
                yield block(rows_a_block)
                rows -= rows_a_block
                k += 1
        if rows:
            yield block(rows)

    return pack


class _Search:
    """Best scores of one block of queries; threshold: scores that k candidates are known to reach."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, values: np.ndarray, basis: np.ndarray | None, k: int, threshold: np.ndarray | None = None):
        self.ids, self.keys, self.q, self.k, self.basis = ids, keys, values, k, basis
        self.qf = values.astype(float)
        self.norm = np.linalg.norm(self.qf, axis=1)
        self.head = self._turned(self.qf)
        width = self.head.shape[1]
        self.cuts = sorted({max(1, width // 4), width})
        self.rest = [self._rest(self.norm, self.head, c) for c in self.cuts]
        n = len(ids)
        self.threshold = np.full(n, -np.inf) if threshold is None else threshold.copy()
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n

    def _turned(self, x: np.ndarray) -> np.ndarray:
        return x[:, : max(1, x.shape[1] // HEAD)] if self.basis is None else x @ self.basis

    @staticmethod
    def _rest(norm: np.ndarray, head: np.ndarray, cut: int) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, norm**2 - np.einsum("ij,ij->i", head[:, :cut], head[:, :cut])))

    def _exact(self, values: np.ndarray) -> np.ndarray:
        top = self.norm.max(initial=0) * np.linalg.norm(values.astype(float), axis=1).max(initial=0)
        if top < EXACT:
            return (self.qf @ values.astype(float).T).astype(np.int64)
        wide = self.q.astype(object) @ values.astype(object).T
        return np.clip(wide, -_LONG, _LONG - 1).astype(np.int64)

    def add(self, ids: np.ndarray, values: np.ndarray) -> None:
        """Search a block of vectors."""
        vf = values.astype(float)
        norm = np.linalg.norm(vf, axis=1)
        # a product of lengths that no query can use ends the block before any sum
        reach = (1 + SLACK) * np.outer(self.norm, norm) + 1e-6
        open_ = (reach >= self.threshold[:, None]) & (self.ids[:, None] != ids[None, :])
        columns = np.flatnonzero(open_.any(axis=0))
        if not len(columns):
            return
        head = self._turned(vf[columns])
        for cut, rest in zip(self.cuts, self.rest, strict=True):
            sums = self.head[:, :cut] @ head[:, :cut].T + np.outer(rest, self._rest(norm[columns], head, cut))
            open_ = open_[:, columns] if open_.shape[1] != len(columns) else open_
            open_ &= sums + SLACK * np.outer(self.norm, norm[columns]) + 1e-6 >= self.threshold[:, None]
            some = np.flatnonzero(open_.any(axis=0))
            if not len(some):
                return
            columns, head, open_ = columns[some], head[some], open_[:, some]
        scores = self._exact(values[columns])
        ids = ids[columns]
        open_ &= scores >= self.threshold[:, None]
        for i in np.flatnonzero(open_.any(axis=1)):
            at = np.flatnonzero(open_[i])
            s = scores[i, at]
            if len(s) > self.k:
                at = at[s >= np.partition(s, len(s) - self.k)[len(s) - self.k]]
                s = scores[i, at]
            was_ids, was_scores = self.best[i]
            all_ids, all_scores = np.concatenate([was_ids, ids[at]]), np.concatenate([was_scores, s])
            order = np.lexsort((all_ids, ~all_scores))[: self.k]
            self.best[i] = all_ids[order], all_scores[order]
            if len(order) == self.k:
                self.threshold[i] = max(self.threshold[i], float(all_scores[order[-1]]))

    def rows(self) -> pa.RecordBatch:
        n = [len(i) for i, _ in self.best]
        flat = lambda j: np.concatenate([np.zeros(0, np.int64), *[b[j] for b in self.best]])
        return pa.RecordBatch.from_pydict({"query_id": np.repeat(self.ids, n), "query_key": np.repeat(self.keys, n), "vec_id": flat(0), "score": flat(1)})


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row for which is_query holds, against all rows but its own.

    Scores are inner products of floor(scale * x). Ties go to the smaller vec_id.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    used = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(vector)))
    used = used.select(F.col(vec_id).cast("bigint").alias("vec_id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    used = materialize(used.withColumn("length", length), "topk-vectors")
    shape = used.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims"), F.count_if("is_query").alias("q"), F.min(F.array_min("v")).alias("least"), F.max(F.array_max("v")).alias("greatest")).first()
    dims = max(1, shape.dims)
    basis = spark.sparkContext.broadcast(rotation(used, dims, max(1, dims // HEAD), shape.n))
    block_rows, query_rows = (max(64, min(most, BLOCK_CELLS // dims)) for most in (BLOCK, QUERIES))
    number = smallest_integer(min(0, shape.least or 0), max(0, shape.greatest or 0))
    pairs = -(-shape.n // block_rows) * -(-shape.q // query_rows)
    group_blocks = min(MOST_GROUP_BLOCKS, max(GROUP_BLOCKS, pairs // UNITS))

    def blocks(rows: DataFrame, size: int, blocks_a_part: int, n: int, edge: str, scalars: dict[str, type], name: str) -> DataFrame:
        order = [F.col(edge).desc(), F.col("vec_id")]
        ordered = rows.repartitionByRange(max(1, -(-n // (size * blocks_a_part))), *order).sortWithinPartitions(*order)
        schema = "part int, k int, lo double, hi double, values binary, " + ", ".join(f"{c} binary" for c in scalars)
        return materialize(ordered.mapInArrow(_pack(size, dims, edge, scalars, number), schema), name)

    candidates = blocks(used.select("vec_id", "v", "length"), block_rows, group_blocks, shape.n, "length", {"vec_id": np.int64}, "topk-blocks")
    # the block of the longest vectors: one row of at most BLOCK_CELLS numbers
    longest = candidates.orderBy("part", "k").select("vec_id", "values").first()
    seed = spark.sparkContext.broadcast((bytes(longest.vec_id), bytes(longest["values"])) if longest else (b"", b""))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.frombuffer(seed.value[0], np.int64)
        values = _values(seed.value[1], len(ids), dims, number)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                search = _Search(part.column("vec_id").to_numpy(), part.column("key").to_numpy(), _matrix(part.column("v"), dims), basis.value, k)
                search.add(ids, values)
                known = np.maximum(search.threshold, 0.0)
                reach = np.divide(known, search.norm, out=np.zeros(len(known)), where=search.norm > 0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(search.threshold), pa.array(reach)], [*part.schema.names, "known", "reach"])

    asked = used.where("is_query").dropDuplicates(["vec_id", "v"]).select("vec_id", F.xxhash64("v").alias("key"), "v")
    begun = asked.mapInArrow(start, "vec_id bigint, key bigint, v array<bigint>, known double, reach double")
    scalars = {"vec_id": np.int64, "key": np.int64, "known": np.float64}
    queries = blocks(materialize(begun, "topk-begun"), query_rows, 1, shape.q, "reach", scalars, "topk-queries")
    queries = queries.select(F.struct(F.col("part").alias("a"), F.col("k").alias("b")).alias("block"), "lo", "values", *scalars)
    # only vectors as long as the least reach of a block of queries meet it: others are not sent
    tops = candidates.groupBy("part").agg(F.max("hi").alias("top"))
    parts = tops.agg(F.min("part").alias("lo"), F.max("part").alias("hi")).first()
    first, last = (parts.lo, parts.hi) if parts.lo is not None else (0, 0)
    long_enough = lambda top: F.col(top) * (1 + SLACK) + 1e-6 >= F.col("lo")
    units = queries.select("block", "lo", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("part"))
    units = materialize(units.join(tops, "part").where(long_enough("top")).select("block", "lo", "part"), "topk-units")
    rows = units.select("block", "part").join(queries.drop("lo"), "block").select("block", "part", F.lit(-1).alias("k"), "vec_id", "key", "known", "values")
    none = F.lit(None).cast("binary")
    met = units.join(candidates.drop("lo"), "part").where(long_enough("hi"))
    rows = rows.unionByName(met.select("block", "part", "k", "vec_id", none.alias("key"), none.alias("known"), "values"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[_Search] = []
        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                ids = np.frombuffer(value("vec_id"), np.int64)
                values = _values(value("values"), len(ids), dims, number)
                if value("k") < 0:
                    yield from (s.rows() for s in now)
                    keys, known = np.frombuffer(value("key"), np.int64), np.frombuffer(value("known"), np.float64)
                    tiles = [slice(at, at + TILE) for at in range(0, len(ids), TILE)]
                    now = [_Search(ids[t], keys[t], values[t], basis.value, k, known[t]) for t in tiles]
                else:
                    for tile in now:
                        tile.add(ids, values)
        yield from (s.rows() for s in now)

    dealt = rows.repartition("block", "part").sortWithinPartitions("block", "part", "k").select("k", "vec_id", "key", "known", "values")
    found = dealt.mapInArrow(search, "query_id bigint, query_key bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
