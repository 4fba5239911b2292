import math

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import topk


def brute(rows, k=20):
    vs = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in vs if i % 20 == 0}:
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, v)))), i) for i, v in vs if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def run(spark, rows, monkeypatch=None):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    return df, {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()}


def test_matches_brute_force_on_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 2)
    r = np.random.default_rng(1)
    basis = r.normal(size=(4, 24))
    rows = [(i, [float(x) for x in (r.normal(size=4) @ basis * r.exponential() + 0.05 * r.normal(size=24))]) for i in range(700)]
    rows += [(1000 + i, rows[20][1]) for i in range(200)]  # a large group of the same vector: ties
    _, got = run(spark, rows)
    assert got == brute(rows)


def test_defined_cases(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0]), (2, []), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (20, [-3e38, 3e38]), (21, [3e38, 3e38]), (7, [1.0, 2.0]), (7, [1.0, 2.0])]
    df, got = run(spark, rows)
    assert {g for g in got if g[0] == 0} == {g for g in brute(rows) if g[0] == 0 and g[2] < 20} | {g for g in got if g[0] == 0 and g[2] >= 20}
    assert all(-(2**63) <= g[3] < 2**63 for g in got)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_driver_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_wide_vectors_are_rotated(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "ROTATION_ROWS", 60)
    r = np.random.default_rng(4)
    basis = r.normal(size=(3, 1536))
    rows = [(i, [float(x) for x in r.normal(size=3) @ basis * r.exponential()]) for i in range(200)]
    turned = []
    fit = topk.rotation
    monkeypatch.setattr(topk, "rotation", lambda *a: turned.append(fit(*a)) or turned[0])
    _, got = run(spark, rows)
    assert got == brute(rows) and turned[0].shape == (1536, 384)


def test_short_vectors_are_not_sent(spark, monkeypatch):
    """Blocks that no query can use are left out of the shuffle, and a block is left after its first sums."""
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 1)
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.normal(size=8) * (100 if i < 100 else 0.1)]) for i in range(1200)]
    held = {}
    keep = topk.materialize
    monkeypatch.setattr(topk, "materialize", lambda df, name: held.setdefault(name, keep(df, name)))
    _, got = run(spark, rows)
    assert got == brute(rows)
    assert held["topk-units"].count() < held["topk-queries"].count() * held["topk-blocks"].count() / 2


def test_one_id_with_two_vectors_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0], 1, 5), (0, [0.0, 1.0], 1, 5), *[(i, [float(i), float(-i)], 1, 5) for i in range(1, 30)]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int, rank int")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()]
    assert sorted(g[1] for g in got) == sorted([*range(1, 21)] * 2)
    assert {(g[2], g[3]) for g in got} == {(i, 4096 * i) for i in range(10, 30)} | {(i, -4096 * i) for i in range(1, 21)}


def test_large_query_blocks_in_tiles_and_packed_numbers(spark, monkeypatch):
    for name, value in {"BLOCK": 64, "QUERIES": 64, "TILE": 8, "GROUP_BLOCKS": 2, "UNITS": 2, "MOST_GROUP_BLOCKS": 4}.items():
        monkeypatch.setattr(topk, name, value)
    held, keep = {}, topk.materialize
    monkeypatch.setattr(topk, "materialize", lambda df, name: held.setdefault(name, keep(df, name)))
    r = np.random.default_rng(4)
    for scale, size in ((1.0, 1), (40.0, 2), (1e4, 4), (1e9, 8)):
        held.clear()
        rows = [(i, [float(x) for x in scale * r.uniform(-1, 1, 6)]) for i in range(600)] + [(20, [scale] * 6)]
        _, got = run(spark, rows)
        assert got == brute(rows)
        for blocks in ("topk-blocks", "topk-queries"):
            assert all(len(b["values"]) == size * 6 * len(b.vec_id) // 8 for b in held[blocks].collect())
        assert max(len(b.vec_id) for b in held["topk-queries"].collect()) > 8 * topk.TILE // 2


def test_smallest_integer():
    assert [topk.smallest_integer(*x) for x in ((-128, 127), (0, 128), (-32769, 0), (0, 2**31), (0, 0))] == [np.int8, np.int16, np.int32, np.int64, np.int8]
