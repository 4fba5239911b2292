import hashlib
import random
import re
import time

import pyarrow as pa
import pytest

from strandloom.llm.decontaminate import WINDOW, Index, find_contamination, results

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w = words(text)
    hit, ids = set(), set()
    for item_id, item_text in items:
        v = words(item_text)
        if not v or item_id is None:
            continue
        m = min(len(v), WINDOW)
        windows = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)}
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in windows:
                hit.update(range(i, i + m))
                ids.add(str(item_id))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def check(spark, docs, items, **more):
    df = spark.createDataFrame(docs, "doc_id bigint, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = [(r.doc_id, r.text, (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in find_contamination(df, bench, **more).collect()]
    assert len(got) == len(docs)
    for _, text, result in got:
        assert result == brute(text, items), text


def cases():
    r = random.Random(2)
    vocab = ["a", "b", "c", "É", "ß9", "Zed"]
    say = lambda n, k=6: " ".join(r.choice(vocab[:k]) for _ in range(n))
    items = [(i, say(r.choice([1, 3, 9, 10, 11, 25, 40]), r.choice([2, 6]))) for i in range(40)] + [(7, say(12)), (99, None), (98, "..."), (None, "a b"), (50, "solo")]
    docs = [(i, say(r.randint(0, 60), r.choice([2, 6])).replace(" ", r.choice([" ", "\n- "])), "x") for i in range(120)]
    docs += [(500, None, "x"), (500, None, "x"), (501, "", "x"), (502, "A " * 5000, "x"), (503, items[6][1] + "!" + items[8][1], "x"), (504, "SOLO", "x")]
    return docs, items


def test_matches_brute_force(spark):
    check(spark, *cases())


def test_index_in_parts(spark):
    check(spark, *cases(), index_bytes=600)


def test_empty_tables(spark):
    docs, items = cases()
    check(spark, docs[:5], [])
    check(spark, [], items)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_driver_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet")
    known = [(r.item_id, r.text) for r in items.collect()]
    rows = find_contamination(docs, items).collect()
    assert any(r.contaminated for r in rows)
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(r.text, known)


def test_repeated_words_take_no_longer():
    docs = pa.array(["same " * 100_000, "x " + "one two " * 40_000])
    index = [Index([1, 2, 3], ["same " * 1000, "one two " * 300, "two one " * 300])]
    start = time.monotonic()
    (got,) = results([docs], index)
    assert time.monotonic() - start < 10
    assert [(r["n_words"], r["n_hit"], r["n_items"]) for r in got.to_pylist()] == [(100_000, 100_000, 1), (80_001, 80_000, 2)]


def test_an_item_set_is_expanded_once():
    """A passage that thousands of items share: each document meets the set once, and names every item."""
    passage = " ".join(f"w{i}" for i in range(60))
    index = [Index(list(range(5000)), [passage] * 5000)]
    start = time.monotonic()
    (got,) = results([pa.array([f"a {passage} b"] * 20)], index)
    assert time.monotonic() - start < 10
    assert {(r["n_hit"], r["n_items"]) for r in got.to_pylist()} == {(60, 5000)}


def test_parts_are_loaded_once_a_chunk():
    docs = pa.array([" ".join(f"w{(i * j) % 97}" for j in range(40)) for i in range(50)])
    items = [" ".join(f"w{(i * j) % 97}" for j in range(5, 25)) for i in range(30)]
    loads = []

    class Parts:
        def __iter__(self):
            for i in range(0, 30, 10):
                loads.append(i)
                yield Index(list(range(i, i + 10)), items[i : i + 10])

    whole = results([docs], [Index(list(range(30)), items)])
    assert pa.concat_arrays(results([docs[:20], docs[20:], docs[:0]], Parts())).equals(whole[0])
    assert len(loads) == 3
