import corpus_pipeline as cp

from strandloom.llm import mixing
from tests.llm.test_decontaminate import brute
from tests.llm.test_near_copies import brute_kept


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = {}
    for name, stage in cp.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
        seen[name] = before, docs.collect()
        if name != "mixing":
            assert docs.columns == columns
            assert {r.doc_id for r in seen[name][1]} <= {r.doc_id for r in before}
    for name, label, good in (("quality", "quality", 1), ("toxicity", "toxic", 0)):
        before, after = seen[name]
        kept = {r.doc_id for r in after}
        right = [(r.doc_id in kept) == (labels[r.doc_id][label] == good) for r in before if r.doc_id in labels]
        assert sum(right) / len(right) > 0.95
    before, after = seen["near_duplicates"]
    assert sorted(r.doc_id for r in after) == brute_kept(sorted((r.doc_id, r.text) for r in before))
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not brute(r.text, items)[4]}
    before, after = seen["mixing"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and after
    assert sorted((r.doc_id, r.copy) for r in mixing.mix(spark.createDataFrame(before, columns)).collect()) == sorted((r.doc_id, r.copy) for r in after)


def test_run_and_odd_documents(spark, tmp_path):
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 0
    odd = spark.createDataFrame([(1, None, None, None, 0, "x"), (1, None, None, None, 0, "x"), (None, "", "en", "s", 0, "x"), (2, "word " * 30_000, "en", "s", 5, "x")], "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    for docs in (odd, odd.limit(0)):
        for _, stage in cp.STAGES:
            assert stage(spark, docs, "/root/testdata/sf0.001").count() <= 40
