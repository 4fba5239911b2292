"""Coverage as runs of depth: sums of parts without a row for each bin."""

import random

from strandloom.operators import coverage
from strandloom.plans import catalog

READS = "sample string, contig string, haplotype int, start bigint, end bigint"


def some_reads(spark, seed, n=400):
    r = random.Random(seed)
    rows = [(r.choice("tn"), r.choice("ab"), r.choice([None, 1, 2, 3]), s, s + r.randrange(0, 90)) for s in (r.randrange(0, 2000) for _ in range(n))]
    return spark.createDataFrame(rows, READS)


def test_merged_runs_equal_merged_bins(spark):
    parts = [some_reads(spark, seed) for seed in (1, 2, 3)]
    want = {(r.sample, r.contig, r.haplotype, r.bin, r.depth) for r in coverage.merge_coverage(*[coverage.binned_coverage(p, 10) for p in parts]).collect()}
    for chunk in (7, 10**6):
        runs = [coverage.coverage_by_deltas(p, 10, chunk) for p in parts]
        rows = coverage.run_bins(coverage.merge_runs(*runs, chunk_bins=chunk, partitions=5)).collect()
        assert {(r.sample, r.contig, r.haplotype, r.bin, r.depth) for r in rows} == want and len(rows) == len(want)


def test_bins_are_not_shuffled(spark, sf_dir):
    lines = catalog.coverage_merge(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = lambda word: [i for i, x in enumerate(lines) if word in x]
    # the bins of the result are made behind the last window, and no aggregate follows
    assert at("sequence(")[0] < at("Window")[0] and not any(x < at("sequence(")[0] for x in at("Aggregate"))
    assert len(at("sequence(")) == 1
