"""Calls made by segments of contigs, and depth from reads in chunks, against the operators that number and bin first."""

import random
from dataclasses import replace

import pytest

from strandloom.config import DEFAULT
from strandloom.operators import calling, clustering, coverage, depth, ordered, stages
from strandloom.plans import catalog
from tests.test_local_calls import ROWS, some_rows


def order(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("chunk", [1, 150, 3000, 1_000_000])
def test_segmented_calls_equal_numbered_calls(spark, chunk):
    rows, config = some_rows(spark, chunk).localCheckpoint(), replace(DEFAULT, chunk=chunk)
    want = order(calling.call_breakpoints(clustering.numbered_starts(rows, config), config))
    assert clustering.segmented_starts(rows, config) is not None
    assert order(calling.segmented_calls(rows, config)) == want
    assert len(want) > 20


def test_segments_with_large_clusters_are_numbered_first(spark, monkeypatch):
    rows = some_rows(spark, 7).localCheckpoint()
    want = order(calling.call_breakpoints(clustering.numbered_starts(rows)))
    assert clustering.segmented_starts(rows, most=100) is None
    monkeypatch.setattr(calling, "LARGE", 36)
    assert order(calling.segmented_calls(rows)) == want


def test_one_cluster_over_all_chunks_and_empty_input(spark):
    chain = [(f"r{i}", "tumor", "a", 100 * i, "a", 100 * i + 400, "+-", 0, None, 30, "CIGAR", False, i) for i in range(200)]
    config = replace(DEFAULT, chunk=700)
    calls = calling.segmented_calls(spark.createDataFrame(chain, ROWS), config).collect()
    assert [(r.cluster, r.n_rows, r.tumor_reads, r.clustered_tumor, r.clustered_normal) for r in calls] == [(1, 200, 200, 200, 0)]
    assert calling.segmented_calls(spark.createDataFrame([], ROWS), config).collect() == []


def test_calls_are_written_once_and_rows_not(spark, sf_dir, monkeypatch):
    written = []
    for module in (ordered, calling, clustering, catalog):
        monkeypatch.setattr(module, "settle", lambda df, name: written.append(name) or stages.settle(df, name))
    catalog.filter_legacy(spark, sf_dir)
    # a row a chunk, a row a segment, the calls
    assert written == ["chunks", "segments", "raw-calls"]


@pytest.mark.parametrize("bounded", [False, True])
@pytest.mark.parametrize("bins", [3, 40, 100_000])
def test_depth_of_reads_equals_depth_of_runs(spark, monkeypatch, bounded, bins):
    monkeypatch.setattr(depth, "CHUNK_BINS", bins)
    r = random.Random(bins)
    reads = [(r.choice(["tumor", "normal", "other"]), r.choice("ab"), s, s + r.choice([0, 9, 50, -30, 900]), r.choice([None, 1, 2, 3])) for s in (r.randrange(0, 1500) for _ in range(300))]
    reads = spark.createDataFrame([*reads, ("tumor", "a", None, 5, 1)], "sample string, contig string, start bigint, end bigint, haplotype int")
    places = lambda: r.choice([0, 3, 10, 29, 30, 399, 400, r.randrange(2600)])
    calls = spark.createDataFrame([(i, r.choice("ab"), places(), r.choice("abc"), places(), i % 9, i % 4) for i in range(120)], "call_id bigint, start_chr string, start_loc bigint, end_chr string, end_loc bigint, tumor_alignments bigint, normal_alignments bigint")
    contigs = spark.createDataFrame([("a", 1400), ("b", 400)], "contig string, length bigint") if bounded else None
    want = order(depth.annotate_depth(calls, coverage.coverage_by_deltas(reads, DEFAULT.coverage_bin), contigs))
    assert order(depth.annotate_read_depth(calls, reads, contigs)) == want
