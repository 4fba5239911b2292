import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import quality, toxicity
from strandloom.llm.common import labelled_sample

TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def inputs(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/labels.parquet")


def accuracy(scored, labels, label):
    rows = scored.where("held_out").join(labels.groupBy("doc_id").agg(F.max(label).alias("y")), "doc_id").select("predicted", "y").collect()
    assert rows
    return sum(r.predicted == r.y for r in rows) / len(rows)


def test_toxicity_held_out_accuracy(inputs):
    docs, labels = inputs
    scored = toxicity.score_held_out(docs, labels).cache()
    assert scored.count() == docs.count()
    assert scored.where("score < 0 or score > 1 or score is null").count() == 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored.collect())
    assert accuracy(scored, labels, "toxic") > 0.9


def test_quality_held_out_accuracy(inputs):
    docs, labels = inputs
    scored = quality.score_held_out(docs, labels).cache()
    assert scored.count() == docs.count()
    assert scored.where("score < 0 or score > 1 or score is null").count() == 0
    assert accuracy(scored, labels, "quality") > 0.95


def test_gram_matches_equal_brute_force():
    texts = ["Some TEXT with à", "", "so", "xx with \U0001f600 some text", "some"] * 3
    model = toxicity.fit(texts + ["other words here"] * 15, np.array([1] * 15 + [0] * 15))
    got = model.scores(pa.array(texts))
    want = []
    for t in texts:
        p, _ = toxicity.characters(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        held = {int(h) for n, g in toxicity.grams(p) for h in (g + np.uint64(n))}
        z = model.intercept + sum(w for h, w in zip(model.hashes, model.weights) if int(h) in held)
        want.append(1 / (1 + np.exp(-z)))
    assert np.allclose(got, want)


def test_statistics_do_not_depend_on_neighbours():
    texts = ["a b  b\n", "", "Ünï CODE!! 12", "x" * 70 + " " + "x" * 70, " ", "b"]
    together = quality.column_statistics(pa.array(texts))
    alone = np.vstack([quality.column_statistics(pa.array([t])) for t in texts])
    assert np.allclose(together, alone)


def test_isotonic_is_monotone():
    r = np.random.default_rng(3)
    x, y = r.normal(size=300), (r.random(300) > 0.5).astype(int)
    knots, levels = quality.isotonic(x, y)
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) >= 0).all()


@pytest.mark.parametrize("module", [toxicity, quality])
def test_defined_cases(spark, module):
    docs = spark.createDataFrame([(1, None, 5.0), (1, None, 5.0), (None, "abc", 5.0), (3, "", 5.0)], "doc_id bigint, text string, score double")
    no_labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = module.train(docs, no_labels)
    rows = module.score(docs, model).collect()
    assert len(rows) == 4 and len({round(r.score, 6) for r in rows}) == 1
    assert module.score(docs.limit(0), model).count() == 0


def test_isotonic_equals_the_minimax_formula():
    r = np.random.default_rng(8)
    x, y, w = np.round(r.normal(size=60), 1), (r.random(60) > 0.4).astype(float), r.uniform(0.5, 2, 60)
    knots, levels = quality.isotonic(x, y, w)
    at = np.unique(x)
    weight = np.array([w[x == v].sum() for v in at])
    mean = np.array([(w * y)[x == v].sum() for v in at]) / weight
    share = lambda a, b: (mean * weight)[a : b + 1].sum() / weight[a : b + 1].sum()
    want = [max(min(share(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    assert np.allclose(np.interp(at, knots, levels), want)


def test_random_features_approximate_the_gaussian_kernel():
    r = np.random.default_rng(9)
    x = r.normal(size=(60, len(quality.STATISTICS)))
    none = np.zeros(0)
    z = quality.Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), none, none, none).features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * quality.BANDWIDTH**2))
    assert np.abs(z @ z.T - exact).mean() < 0.08 and np.abs(z @ z.T - exact).max() < 0.35


def test_quality_training_equals_the_closed_form(inputs):
    docs, labels = inputs
    model = quality.train(docs.repartition(5), labels)
    rows = sorted(labelled_sample(docs, labels, "quality", F.lit(True), quality.PER_CLASS, quality.TRAIN_BYTES).collect())
    x = quality.column_statistics(pa.array([r.text for r in rows]))
    y = np.array([r.label for r in rows])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-6))
    z = model.features(x)
    w = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    want = np.linalg.solve((z * w[:, None]).T @ z + quality.PENALTY / quality.FEATURES * np.eye(z.shape[1]), (z * w[:, None]).T @ y)
    assert np.allclose(model.weights, want, atol=1e-6)
    assert (np.diff(model.levels) >= 0).all() and model.levels.min() >= 0 and model.levels.max() <= 1


def test_toxicity_training_equals_a_plain_restatement(monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 40)
    r = np.random.default_rng(11)
    words = ["good", "vile", "house", "slur", "tree", "Rivers"]
    y = np.array([i % 2 for i in range(60)], float)
    texts = [" ".join(r.choice(words, 8, p=[0.1, 0.3, 0.1, 0.3, 0.1, 0.1] if t else [0.3, 0.05, 0.2, 0.05, 0.2, 0.2])) for t in y]
    model = toxicity.fit(texts, y)
    # n-grams as strings, counted in dicts
    held = [{(n, t.lower()[i : i + n]) for n in toxicity.ORDERS for i in range(len(t) - n + 1)} for t in texts]
    grams = sorted(set().union(*held))
    df = np.array([[sum(g in h for h, k in zip(held, y) if k == c) for g in grams] for c in (0, 1)], float)
    often = df.sum(0) >= toxicity.LEAST_DOCS
    grams, df = [g for g, o in zip(grams, often) if o], df[:, often]
    both, share = df.sum(0), y.mean()
    chi = (df[1] - both * share) ** 2 / (both * share * (1 - share) * np.maximum(1 - both / len(y), 1e-9) + 1e-9)

    def hashed(gram):
        p, _ = toxicity.characters(np.frombuffer(gram[1].encode(), np.uint8), np.array([0, len(gram[1])]))
        return next(int(h[0]) + n & (1 << 64) - 1 for n, h in toxicity.grams(p) if n == gram[0])

    kept = sorted(range(len(grams)), key=lambda i: (-round(chi[i], 9), hashed(grams[i])))[:40]
    assert {round(chi[i], 9) for i in kept} >= {round(c, 9) for c in sorted(chi)[-20:]}
    by_hash = {hashed(grams[i]): i for i in range(len(grams))}
    chosen = [by_hash[int(h)] for h in model.hashes]
    assert np.allclose(sorted(chi[chosen]), sorted(chi[kept]))
    d = df[:, chosen]
    ratio = np.log((d[1] + 0.5) / (d[1] + 0.5).sum()) - np.log((d[0] + 0.5) / (d[0] + 0.5).sum())
    x = np.array([[g in h for g in [grams[i] for i in chosen]] for h in held]) * ratio
    # the fitted weights minimise the penalised loss: its gradient is all but zero
    w, b = model.weights / ratio, model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    g = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * (p - y)
    start = np.abs(x.T @ (np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * (0.5 - y))).max()
    assert np.abs(x.T @ g + 1e-4 * w).max() < 0.02 * start and abs(g.sum()) < 0.02


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_defined_cases_of_a_trained_model(spark, monkeypatch, module, label):
    monkeypatch.setattr(module, "PER_CLASS", 12)
    monkeypatch.setattr(module, "TRAIN_BYTES", 2000)
    good, bad = "A calm sentence about rivers, trees and houses. ", "!!! VILE slur slur $$$ 11 "
    rows = [(i, (bad if i % 2 else good) * (1 + i % 5), 5.0, "x") for i in range(60)]
    rows += [(100, None, 5.0, "x"), (100, None, 5.0, "x"), (101, "", 5.0, "x"), (None, good, 5.0, "x"), (102, bad * 20_000, 5.0, "x"), (103, good * 20_000, 5.0, "x"), (104, good, 5.0, "x"), (104, good, 5.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double, lang string")
    named = [(i, i % 2) for i in range(60)] + [(0, 1), (102, 0), (103, 1), (104, 0), (104, 0), (None, 1), (500, 1), (3, None)]
    labels = spark.createDataFrame(named, f"doc_id bigint, {label} int")
    model = module.train(docs, labels)
    again = module.train(docs.repartition(3), labels.repartition(2))
    got = module.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.lang == "x" for r in got)
    of = lambda text: {round(r.score, 9) for r in got if r.text == text}
    assert len(of(None) | of("")) == 1 and len(of(good)) == 1
    assert max(of(good * 20_000)) < min(of(bad * 20_000)) and max(of(good)) < min(of(bad))
    assert np.allclose([r.score for r in module.score(docs, again).collect()], [r.score for r in got], atol=1e-6)
    assert module.score(docs.limit(0), model).count() == 0
