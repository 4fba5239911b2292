import random
import re
import zlib
from collections import Counter

import pytest

from strandloom.llm import spelling

UPPER = {ord(x): x.lower() for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_words(rows):
    seen = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(words):
    out, forms = [], {}
    for w, n in words.items():
        near = [x for x in words if is_near(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None
        out.append((w, n, len(near)))
    full = []
    for w, n, k in out:
        root = w
        while forms[root] is not None:
            root = forms[root]
        full.append((w, forms[w], root, n, k, words[forms[w]] if forms[w] else None))
    return sorted(full, key=str)


def grouped(spark, words, **options):
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    return sorted((tuple(r) for r in spelling.group_variants(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def vocabulary(seed, n=400):
    r = random.Random(seed)
    stems = ["common", "aaaaaaa", "préfixe", "abababab"]
    words = {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababa", "abababab", "bababab", "zzzzzzz"}
    while len(words) < n:
        w = r.choice(stems) + "".join(r.choice("abéÿ") for _ in range(r.randrange(0, 6)))
        if r.random() < 0.5:
            i = r.randrange(len(w))
            w = w[:i] + r.choice(["", "x", w[i] + "b", w[i] * 2]) + w[i + 1 :]
        if len(w) >= 7:
            words.add(w)
    return {w: r.choice([2, 3, 25, 30, 30, 300, 3000]) for w in sorted(words)}


@pytest.mark.parametrize("seed, most", [(1, 48), (2, 4), (3, 1)])
def test_groups_equal_brute_force(spark, seed, most):
    words = vocabulary(seed)
    got = grouped(spark, words, most=most)
    assert got == brute(words)
    assert any(x[1] and x[2] not in (x[0], x[1]) for x in got)  # a chain of forms


def test_each_pair_is_found_once(spark):
    words = vocabulary(4)
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    for most in (1, 7, 1000):
        pairs = [tuple(sorted((r.word, r.other))) for r in spelling.near_words(df, most).collect()]
        assert len(pairs) == len(set(pairs))
        assert set(pairs) == {(a, b) for a in words for b in words if a < b and is_near(a, b)}


def test_words_of_texts(spark):
    r = random.Random(3)
    words = ["Voiture", "VOITURE", "voitures", "ÀÉÎÕÜÿß", "àéîõüÿß", "ñandúes", "straße", "short", "a×b÷cde", "extraordinary"]
    rows = [(None if i % 9 == 0 else i, " ,1 ".join(r.choice(words) for _ in range(60))) for i in range(40)]
    rows += [(1, None), (2, ""), (3, "—…"), (4, "x" * 5000 + " " + "x" * 5000), rows[5], rows[5]]
    docs = spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id bigint, text string, n int, word string").repartition(3)
    got = {r.word: r.n for r in spelling.words_of(docs).collect()}
    assert got == brute_words(rows) and len(got) > 8


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.group_variants(spelling.words_of(docs)).collect() == []
    assert grouped(spark, {"loneword": 5}) == [("loneword", None, "loneword", 5, 0, None)]


def test_chains_are_followed_to_the_end(spark):
    links = spark.createDataFrame([(f"{i}", f"{i + 1}") for i in range(13)], "word string, form string")
    assert {r.root for r in spelling.follow(links, 13).collect()} == {"13"}
