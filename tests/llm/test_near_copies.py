import random
import re

import corpus_pipeline as cp
import numpy as np
import pyarrow as pa

from strandloom.llm import near_copies

SCHEMA = "doc_id bigint, text string, score int"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(rows):
    """Least id of each component of the links of similarity 4/5 and more."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def kept(spark, rows):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA).repartition(3)
    out = cp.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(r.doc_id for r in out.collect())


def test_documents_below_the_similarity_stay(spark, sf_dir):
    # 106 and 185: fingerprints within five bits, similarity 0.797
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id in (106, 185)").collect()]
    assert kept(spark, rows) == brute_kept(rows) == [106, 185]
    assert kept(spark, [(1, "a b c d e f g h i"), (2, "a b c d e f g h x")]) == [1, 2]
    assert kept(spark, [(1, "a b c d e f g h i"), (2, "a b c d e f g h i j"), (3, "A b c\td e f g h i  j k")]) == [1]


def test_defined_cases(spark):
    rows = [(4, None), (5, ""), (6, " \n"), (7, "one two"), (8, "One  two"), (9, "two one"), (10, "one two"), (10, "one two")]
    assert kept(spark, rows) == [4, 7, 9]
    assert kept(spark, []) == []


def test_all_near_copies_are_found(spark, sf_dir):
    # 6 and 145 are seven bits apart, 1 and 177 eleven
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute_kept(rows)
    assert kept(spark, rows) == want and not {145, 177} & set(want)


def test_large_group_of_copies(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for d in range(90):
        words = list(base)
        for place in r.sample(range(120), r.choice([0, 1, 2, 3, 5])):
            words[place] = f"x{d}"
        rows.append((d, " ".join(words)))
    assert len(rows) > 2 * near_copies.SMALL
    want = brute_kept(rows)
    assert 1 < len(want) < len(rows) / 2
    assert kept(spark, rows) == want


def test_fingerprints_are_majorities_of_bits():
    r = np.random.default_rng(5)
    h, ends = r.integers(0, 2**64, 40, dtype=np.uint64), np.array([0, 1, 1, 8, 40])
    for got, a, b in zip(near_copies.fingerprints(h, ends), ends[:-1], ends[1:]):
        want = sum(1 << k for k in range(64) if 2 * sum(int(x) >> k & 1 for x in h[a:b]) > b - a)
        assert int(got) == want


def test_simhash_links_are_confirmed_links(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    column = pa.array([t for _, t in rows], pa.string())
    sets = [set(h[a:b].tolist()) for _, _, raw, at in near_copies.text_slices(column) for h, ends in [near_copies.shingle_sets(raw, at)] for a, b in zip(ends[:-1], ends[1:])]
    by_node = {i: s for i, s in enumerate(sets) if s}
    h = [np.array(sorted(s), np.uint64) for s in by_node.values()]
    fp = near_copies.fingerprints(np.concatenate(h), np.cumsum([0, *map(len, h)])).view(np.int64)
    table = spark.createDataFrame([(i, x.view(np.int64).tolist(), int(f)) for i, x, f in zip(by_node, h, fp)], "node bigint, shingles array<bigint>, fp bigint")
    found = near_copies.simhash_links(table).collect()
    assert found and all(5 * len(by_node[r.u] & by_node[r.v]) >= 4 * len(by_node[r.u] | by_node[r.v]) for r in found)


def test_streamed_groups_join_the_same(monkeypatch):
    r = np.random.default_rng(2)
    key = np.sort(np.concatenate([r.integers(0, 9, 60), np.full(300, 4)]))
    table = np.stack([key, np.arange(360), np.arange(360), np.full(360, 10), np.zeros(360, int)]).astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in table], ["key", "node", "root", "n", "place"])
    parts = [batch.slice(i, 7) for i in range(0, 360, 7)]

    def joined(batches, hubs):
        label = np.arange(360)
        for b in near_copies._pair_batches(iter(batches), hubs):
            near_copies_unite(label, b.column("u").to_numpy(), b.column("v").to_numpy())
        return label.tolist()

    want = [int(np.flatnonzero(key == k)[0]) for k in key]
    for rows in (1, 20, 10**6):
        monkeypatch.setattr(near_copies, "_ROWS", rows)
        for hubs in (1, 8, None):
            assert joined(parts, hubs) == want


def near_copies_unite(label, u, v):
    for a, b in zip(u, v):
        a, b = label[a], label[b]
        label[label == max(a, b)] = min(a, b)


def test_a_line_in_every_text_is_not_held(spark, monkeypatch):
    """Entries of a bucket that are held at once stay below a bound, whatever the number of texts with one line."""
    monkeypatch.setattr(near_copies, "CHUNK", 3000)
    banner = " ".join(f"b{i}" for i in range(12))
    most = {}
    for n in (400, 1600):
        r = random.Random(n)
        rows = [(i, banner + " " + " ".join(f"{r.random()}" for _ in range(20))) for i in range(n)]
        sets = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id as row_id", "0L as row_text", "false as no_id", "text").mapInArrow(near_copies._set_batches, "row_id bigint, row_text bigint, no_id boolean, node bigint, shingles array<bigint>, fp bigint")
        batches = [b for b in sets.select("node", "shingles").toArrow().to_batches(max_chunksize=50)]
        dealt = pa.Table.from_batches(list(near_copies._entry_batches(iter(batches), False, 8))).sort_by([("bucket", "ascending"), ("kind", "descending")])
        held = []
        add = near_copies._Bucket.add

        def counted(self, kind, block):
            yield from add(self, kind, block)
            held.append(self.size)

        monkeypatch.setattr(near_copies._Bucket, "add", counted)
        out = list(near_copies._shared_batches(iter(dealt.to_batches()), 8))
        monkeypatch.setattr(near_copies._Bucket, "add", add)
        found = np.concatenate([np.frombuffer(x, near_copies._SHARED) for b in out for x in b.column("block").to_pylist()])
        assert len(found) == 8 * n and set(found["sets"].tolist()) == {near_copies.MANY}  # the line's eight shingles, of every text
        most[n] = max(held) / (n * 28 / 8)
    assert most[1600] <= 1.6 and most[400] <= 1.6  # no more than a bucket's share of the other shingles


def test_number_of_sets_does_not_depend_on_chunks(spark, monkeypatch):
    r = random.Random(1)
    lines = [" ".join(f"w{r.randrange(30)}" for _ in range(8)) for _ in range(30)]
    rows = [(i, " ".join(r.choice(lines) for _ in range(6))) for i in range(300)]
    sets = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id as row_id", "0L as row_text", "false as no_id", "text").mapInArrow(near_copies._set_batches, "row_id bigint, row_text bigint, no_id boolean, node bigint, shingles array<bigint>, fp bigint").select("node", "shingles").toArrow()
    shared = []
    for chunk, size in ((10**6, 1000), (500, 40), (5000, 7)):
        monkeypatch.setattr(near_copies, "CHUNK", chunk)
        dealt = pa.Table.from_batches(list(near_copies._entry_batches(iter(sets.to_batches(max_chunksize=size)), False, 16))).sort_by([("bucket", "ascending"), ("kind", "descending")])
        blocks = [x for b in near_copies._shared_batches(iter(dealt.to_batches()), 16) for x in b.column("block").to_pylist()]
        shared.append(sorted({tuple(x) for x in np.concatenate([np.frombuffer(x, near_copies._SHARED) for x in blocks]).tolist()}))
    assert shared[0] == shared[1] == shared[2] and {x[3] for x in shared[0]} >= {2, near_copies.MANY}
