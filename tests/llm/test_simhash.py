import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import simhash
from strandloom.llm.components import connected_components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=3):
    """Smallest reachable position for each fingerprint."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near_values(n, seed, centres=12, most=6):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        x = r.choice(base)
        for _ in range(r.randint(0, most)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


def test_fingerprint_matches_brute_force():
    for t in ["", None, " \n\x0b", "One", "a b", "a b c", "A  b\tc\nd É é", "x " * 500, "ß ¼ \x1c y z w v", "q" * 3000]:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t), t


@pytest.mark.parametrize(("group_rows", "distance"), [(20_000, 3), (8, 3), (20_000, 6), (8, 6), (8, 5)])
def test_links_lose_no_component(spark, group_rows, distance):
    fps = near_values(400, 4, most=6 if distance == 3 else 11)
    df = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)),) for f in fps], "fp bigint").repartition(3)
    found = {r.node: r.root for r in connected_components(simhash.links(df, group_rows, distance)).collect()}
    signed = [int(np.array(f, np.uint64).view(np.int64)) for f in fps]
    want = brute_components(fps, distance)
    groups = lambda roots: {tuple(sorted(i for i in range(len(fps)) if roots[i] == k)) for k in set(roots)}
    assert groups([found.get(x, x) for x in signed]) == groups(want)


def test_link_in_one_dense_group():
    fps = np.array(near_values(3000, 9, centres=1, most=4), np.uint64)
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    fps = fps[np.argsort(rank)]
    label = simhash.link(np.zeros(len(fps), np.int64), fps)
    want = brute_components([int(x) for x in fps[:600]])
    part = simhash.link(np.zeros(600, np.int64), fps[:600])
    assert [tuple(np.flatnonzero(part == part[i])) for i in range(600)] == [tuple(np.flatnonzero(np.array(want) == want[i])) for i in range(600)]
    assert len(label) == 3000


def test_driver_tables(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    order = sorted(rows, key=lambda r: r.doc_id)
    fps = [brute_fingerprint(r.text) for r in order]
    want = {r.doc_id: (f"{f:016x}", order[c].doc_id) for r, f, c in zip(order, fps, brute_components(fps), strict=True)}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_defined_cases(spark):
    docs = spark.createDataFrame([(5, None, 1), (4, "", 1), (4, " ", 1), (None, "a b c d", 1), (None, "a b c d", 1), (7, "e f g", 1), (7, "e f g", 1), (7, "other words here now", 1)], "doc_id bigint, text string, fp int")
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert len(got) == 8 and {c for d, f, c in got if f == "0" * 16} == {4}
    kept = sorted((r.doc_id or -1, r.text or "", r.fp) for r in simhash.keep_one(docs).collect())
    assert [k[0] for k in kept] == [-1, 4, 7, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 200, 1)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000)]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}}
    assert connected_components(df.where(F.lit(False))).count() == 0
