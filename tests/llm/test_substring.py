import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import catalog, substring

SCHEMA = "doc_id bigint, text string, words int, anchor string"


def brute(texts):
    """(n_words, n_removed, kept) of each text by counting every window."""
    split = [(t or "").encode().split() for t in texts]
    windows = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if windows[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def mixed_texts(seed, n=60):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "é", "Foo", "foo", "x" * 30]) + str(r.randrange(40))
    line = [word() for _ in range(18)]
    pool = [[word() for _ in range(r.randrange(20, 120))] for _ in range(6)]
    texts = [None, "", " \t\n", "a " * 34, "a " * 35, "a b " * 40, "a " * 36 + "c " + "a " * 35, "one"]
    for _ in range(n):
        words = []
        for _ in range(r.randrange(1, 6)):
            part = list(r.choice([*pool, [word() for _ in range(r.randrange(60))], line]))
            if r.random() < 0.4:
                part[r.randrange(len(part))] = word() if part else "z"
            words += part
        texts.append(r.choice([" ", "\n", " \x0b "]).join(words) if words else "")
    return texts + texts[8:12]


def run(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA).repartition(3)
    return [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substring.remove_repeats(docs, **options).collect()]


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"block_bytes": 3_000}), (3, {"most": 2, "block_bytes": 500})])
def test_removed_words_are_those_of_brute_force(spark, seed, options):
    texts = mixed_texts(seed)
    rows = [(None if i % 17 == 3 else i % 50, t) for i, t in enumerate(texts)]  # ids are missing or come twice
    want = sorted(((d, *x) for (d, _), x in zip(rows, brute(texts))), key=str)
    assert sorted(run(spark, rows, **options), key=str) == want
    assert any(0 < x[2] < x[1] for x in want)


def test_no_documents_and_no_repeats(spark):
    assert run(spark, []) == []
    text = " ".join(f"w{i}" for i in range(500))
    assert run(spark, [(1, text)]) == [(1, 500, 0, text.encode())]
    assert run(spark, [(1, text), (1, text)]) == [(1, 500, 500, b"")] * 2


def test_query_gives_digests(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = [(d.doc_id, n, gone, hashlib.sha256(kept).hexdigest()) for d, (n, gone, kept) in zip(docs, brute([d.text for d in docs]), strict=True)]
    got = catalog.op11_substring(spark, sf_dir).orderBy("doc_id").select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert [tuple(r) for r in got] == want


def test_factors_are_greedy_and_cover_the_phrases():
    r = np.random.default_rng(5)
    words = r.integers(0, 3, 300).astype(np.uint64)
    at = np.array([0, 80, 90, 91, 200, 300])
    end = np.repeat(at[1:], np.diff(at))
    longest = substring.longest_elsewhere(words, end)
    for i in range(300):  # every other place, word by word; stretches of up to 2 * WINDOW words are told apart
        best = 0
        for j in set(range(300)) - {i}:
            k = 0
            while i + k < end[i] and j + k < end[j] and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        assert longest[i] == best
    start, size = substring.factor(at[:-1], at[1:], longest)
    assert (start[1:] == start[:-1] + size[:-1]).all() and start[0] == 0 and start[-1] + size[-1] == 300
    assert (size == np.maximum(longest[start], 1)).all()


def test_a_common_line_in_ever_new_surroundings_is_no_block(spark, monkeypatch):
    r = random.Random(8)
    line = " ".join(f"banner{i}" for i in range(30))
    texts = [" ".join(str(r.random()) for _ in range(20)) + " " + line + " " + " ".join(str(r.random()) for _ in range(20)) for _ in range(300)]
    texts += [f"p q r {line} s t u v w x y"] * 3
    got = run(spark, list(enumerate(texts)), most=50)
    assert sorted(got) == sorted((i, *x) for i, x in enumerate(brute(texts)))
    places = substring.shared_places(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row_id bigint, row_text bigint, text string"))
    assert places.groupBy("anchor").agg(F.count_distinct("phrase").alias("n")).agg(F.max("n")).first()[0] > 50
