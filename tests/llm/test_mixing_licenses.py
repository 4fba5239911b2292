import math

from pyspark.sql import functions as F

from strandloom.llm import mixing

DOCS = "doc_id bigint, text string, source string, copy int"


def test_cdf_is_poisson(spark):
    for mean in (0.01, 1.0, 5.5, 64.0):
        cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(mean)).alias("c")).first().c
        p, total = math.exp(-mean), 0.0
        for k, got in enumerate(cdf):
            total += p
            assert abs(got - total) < 1e-9
            p *= mean / (k + 1)
        assert abs(cdf[-1] - 1) < 1e-9


def test_rates_and_repeats(spark):
    rows = [(i, "t", "big" if i % 10 else None, 0) for i in range(20_000)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix(docs, {"big": 1.0, None: 3.0}, epochs=2.0)
    assert mixed.columns == ["doc_id", "text", "source", "copy", "mix_order"]
    n = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(n["big"] / 10_000 - 1) < 0.05 and abs(n[None] / 30_000 - 1) < 0.05
    again = mixing.mix(docs.repartition(7), {"big": 1.0, None: 3.0}, epochs=2.0)
    assert mixed.exceptAll(again).count() == 0 and mixed.count() == again.count()


def test_large_means_and_salted_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "t", "a" if i < 4 else "b", 0) for i in range(2000)], DOCS)
    plain = mixing.mix(docs, {"a": 0.5, "b": 0.5})
    assert abs(plain.where("source = 'a'").count() / 1000 - 1) < 0.15
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    salted = mixing.mix(docs, {"a": 0.5, "b": 0.5})
    assert plain.exceptAll(salted).count() == 0 and plain.count() == salted.count()


def test_thousands_of_weights(spark):
    docs = spark.createDataFrame([(i, "t" * (40_000 if i == 7 else 1), f"s{i % 5000}", 0) for i in range(10_000)], DOCS)
    weights = {f"s{i}": 1.0 if i < 2500 else 0.0 for i in range(5000)} | {"absent": 5.0}
    mixed = mixing.mix(docs, weights)
    n, other = mixed.count(), mixed.where("cast(substring(source, 2) as int) >= 2500").count()
    assert other == 0 and abs(n / 10_000 - 1) < 0.05
    table = spark.createDataFrame([(k, v / 2) for k, v in weights.items()] * 2, "source string, weight double")
    assert sorted(mixing.mix(docs, table).select("doc_id", "copy").collect()) == sorted(mixed.select("doc_id", "copy").collect())


def test_rows_come_in_the_order_of_mix_order(spark):
    docs = spark.createDataFrame([(i, "t", "s", 0) for i in range(3000)], DOCS)
    mixed = mixing.mix(docs)
    assert mixed.rdd.getNumPartitions() > 1
    got = [r.mix_order for r in mixed.collect()]
    assert got == sorted(got) and len(got) > 2000


def test_mixing_defined_cases(spark):
    docs = spark.createDataFrame([(None, None, None, 1), (None, "x", None, 1), (3, "", "s", 1), (3, "", "s", 1)] * 50, DOCS)
    per_row = mixing.mix(docs, epochs=3.0).groupBy("doc_id", "text").count().collect()
    assert all(r["count"] % 50 == 0 for r in per_row)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs, {"other": 1.0}).count() == 0
