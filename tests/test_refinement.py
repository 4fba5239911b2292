"""Parts of clusters against all pairs, and a pile-up."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strandloom.operators import refinement

EVENT = "array<struct<start: bigint, end: bigint, len: bigint, query: bigint>>"
SCHEMA = f"k string, c bigint, read_name string, deletions {EVENT}, insertions {EVENT}"


def similarity(a, b):
    near = lambda x, y: abs(x[0] - y[0]) <= 50 and abs(x[1] - y[1]) <= 50 and max(x[2], y[2]) > 0 and min(x[2], y[2]) >= max(x[2], y[2]) * 0.8
    n, m = len(a[0]) + len(a[1]), len(b[0]) + len(b[1])
    if not n or not m:
        return float(n == m)
    hits = sum(any(near(x, y) for y in b[i]) for i in (0, 1) for x in a[i])
    return min(1.0, hits / ((n + m) / 2))


def brute(rows, threshold):
    out, groups = {}, {}
    for k, c, name, d, i in rows:
        groups.setdefault((k, c), {})[name] = (d, i)
    for key, reads in groups.items():
        root = {n: n for n in reads}

        def find(n):
            while root[n] != n:
                n = root[n]
            return n

        for a in sorted(reads):
            for b in sorted(reads):
                if a < b and similarity(reads[a], reads[b]) >= threshold:
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
        out |= {(*key, n): find(n) for n in reads}
    return out


def some_events(r, n):
    return [(s, s + size, size, 0) for s, size in ((r.randrange(0, 900), r.choice([2, 30, 35, 40, 60])) for _ in range(n))]


@pytest.mark.parametrize("seed, rounds", [(1, (2, 16)), (2, (1,)), (3, ())])
def test_parts_equal_all_pairs(spark, monkeypatch, seed, rounds):
    monkeypatch.setattr(refinement, "ROUNDS", rounds)
    r = random.Random(seed)
    rows = [("a", None if g == 3 else g, f"r{r.randrange(10**6)}-{i}", some_events(r, r.randrange(0, 3)), some_events(r, r.randrange(0, 3))) for g in range(4) for i in range(60)]
    rows += [("a", 1, f"twin{i}", rows[i][3], rows[i][4]) for i in range(20)]
    events = spark.createDataFrame(rows, SCHEMA)
    for threshold in (0.6, 0.9):
        got = {(x.k, x.c, x.read_name): x.part for x in refinement.parts_of(events.where("c is not null"), ["k", "c"], threshold).collect()}
        want = {k: p for k, p in brute([x for x in rows if x[1] is not None], threshold).items()}
        assert got == want
        assert 4 < len(set(got.values())) < len(got)


def test_no_events(spark):
    assert refinement.parts_of(spark.createDataFrame([], SCHEMA), ["k", "c"], 0.7).collect() == []


def test_a_pile_up_takes_no_square(spark):
    n = 50_000
    jitter = lambda salt, width: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(width))
    event = lambda at, size: F.struct(at.alias("start"), (at + size).alias("end"), size.alias("len"), F.lit(0).cast("bigint").alias("query"))
    main = event(5000 + F.when(jitter(1, 2) == 0, 0).otherwise(400) + jitter(2, 12), 300 + jitter(3, 20))
    noise = event(4000 + jitter(4, 3000), 5 + jitter(5, 10))
    rows = spark.range(n).select(F.lit("a").alias("k"), F.lit(1).cast("bigint").alias("c"), F.concat(F.lit("r"), F.lpad("id", 6, "0")).alias("read_name"), F.array(main).alias("deletions"), F.when(jitter(6, 10) == 0, F.array(noise)).otherwise(F.array().cast(EVENT)).alias("insertions"))
    began = time.monotonic()
    parts = refinement.parts_of(rows, ["k", "c"], 0.6).groupBy("part").count().collect()
    assert time.monotonic() - began < 90
    assert sum(p["count"] for p in parts) == n and sorted(p["count"] for p in parts)[-2] > 20_000


def test_small_clusters_write_no_blocks(spark, monkeypatch):
    r = random.Random(7)
    rows = [("a", g, f"r{r.randrange(10**6)}-{i}", some_events(r, r.randrange(0, 3)), some_events(r, r.randrange(0, 3))) for g in range(30) for i in range(r.randrange(1, 50))]
    events = spark.createDataFrame(rows, SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(refinement, "settle", lambda df, name: pytest.fail(f"{name} is written"))
        small = {(x.k, x.c, x.read_name): x.part for x in refinement.parts_of(events, ["k", "c"], 0.7).collect()}
    mixed = {(x.k, x.c, x.read_name): x.part for x in refinement.parts_of(events, ["k", "c"], 0.7, 20).collect()}
    large = {(x.k, x.c, x.read_name): x.part for x in refinement.large_parts(events, ["k", "c"], 0.7).collect()}
    assert small == mixed == large == brute(rows, 0.7)
