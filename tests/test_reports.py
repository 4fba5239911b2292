"""Reports of calls from one shuffle of the rows, against the operators that number and write the clusters first."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strandloom.config import DEFAULT
from strandloom.operators import calling, clustering, depth, ordered, stages
from strandloom.plans import catalog
from tests.test_local_calls import some_rows

KEYED = ["start_chr", "cluster", "end_chr", "part", "breakpoint_notation"]
COUNTS = ["tumor_reads", "normal_reads", "clustered_tumor", "clustered_normal"]


def order(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def phased_rows(spark, seed):
    part = lambda n: F.when(F.col("ord") % n > 0, F.col("ord") % n)
    rows = some_rows(spark, seed).withColumns({"haplotype_start": part(3).cast("int"), "haplotype_end": part(4).cast("int"), "phase_set_start": part(5), "phase_set_end": part(7)})
    # places without a quality, samples of neither name
    return rows.withColumns({"mapq": F.when(F.col("ord") % 11 > 0, F.col("mapq")), "sample": F.when(F.col("ord") % 13 == 0, "other").otherwise(F.col("sample"))}).localCheckpoint()


@pytest.mark.parametrize("chunk", [1, 150, 3000, 1_000_000])
def test_wide_statistics_equal_those_of_numbered_clusters(spark, chunk):
    rows, config = phased_rows(spark, chunk), replace(DEFAULT, chunk=chunk)
    clustered = clustering.numbered_starts(rows, config)
    calls = calling.call_breakpoints(clustered, config)
    want = calling.with_cluster_statistics(calls, clustered, config)
    want = want.select(*KEYED, *[x for x in want.columns if x not in calls.columns])
    out = calling.reported_calls(rows, KEYED, config, wide=True)
    assert (out.columns, [t for _, t in out.dtypes]) == (want.columns, [t for _, t in want.dtypes])
    assert order(out) == order(want)
    assert out.count() > 20


def test_large_clusters_are_numbered_first(spark, monkeypatch):
    rows = phased_rows(spark, 5)
    want = order(calling.reported_calls(rows, KEYED, wide=True))
    monkeypatch.setattr(calling, "LARGE", 36)
    assert order(calling.reported_calls(rows, KEYED, wide=True)) == want
    assert order(calling.reported_calls(rows.limit(0), KEYED, wide=True)) == []


def written_names(monkeypatch):
    written = []
    for module in (ordered, calling, clustering, catalog):
        monkeypatch.setattr(module, "settle", lambda df, name: written.append((name, len(df.columns))) or stages.settle(df, name))
    return written


def test_statistics_shuffle_rows_once_and_write_none(spark, sf_dir, monkeypatch):
    written = written_names(monkeypatch)
    catalog.call_cluster_statistics(spark, sf_dir)
    # a row a chunk, a row a segment, the statistics of calls
    assert [n for n, _ in written] == ["chunks", "segments", "islands"]


def test_tasks_of_segments_grow_with_the_rows(spark, monkeypatch):
    rows, config = phased_rows(spark, 6), replace(DEFAULT, chunk=150)
    monkeypatch.setattr(clustering, "TASK_ROWS", 100)
    held = clustering.segmented_starts(rows, config)
    assert held.rdd.getNumPartitions() == 9
    want = order(calling.call_breakpoints(clustering.numbered_starts(rows, config), config))
    assert order(calling.segmented_calls(rows, config)) == want


def test_count_report_writes_the_counts_of_calls_alone(spark, sf_dir, monkeypatch):
    written = written_names(monkeypatch)
    catalog.read_count_report(spark, sf_dir)
    assert [n for n, _ in written] == ["chunks", "segments", "islands"]
    # the segment, the kind, the key of a call and four counts
    assert written[-1][1] == 2 + len(KEYED) + 4


def test_count_report_from_calls_equals_that_from_rows(spark):
    rows = phased_rows(spark, 7)
    clustered = clustering.numbered_starts(rows)
    keyed = lambda df: df.withColumn("call_id", F.concat_ws(":", *[F.col(x).cast("string") for x in KEYED]))
    want = order(depth.read_count_report(keyed(calling.call_breakpoints(clustered)), clustered))
    assert order(depth.read_count_report(keyed(calling.reported_calls(rows, [*KEYED, *COUNTS])))) == want
    assert len(want) > 40
