"""Calls of small clusters from one shuffle against the operators for clusters of any size."""

import random

import pytest

from strandloom.config import DEFAULT
from strandloom.operators import calling, clustering, ordered

ROWS = "read_name string, sample string, start_chr string, start_loc bigint, end_chr string, end_loc bigint, breakpoint_notation string, insert_length bigint, inserted_sequence string, mapq int, source string, is_nearby_event boolean, ord bigint"


def some_rows(spark, seed, n=900):
    r, rows = random.Random(seed), []
    for i in range(n):
        start, kind = r.randrange(0, 12) * 2000 + r.randrange(0, 100), r.choice(["<INS>", "<INS>", "+", "-", "+-", "-+", "--"])
        single = kind in ("<INS>", "+", "-")
        end = start if single else start + r.choice([0, 20, 70, 400])
        rows.append((f"r{r.randrange(0, n // 3)}", r.choice(["tumor", "normal"]), r.choice("ab"), start, r.choice("ab") if not single and i % 5 == 0 else "a", end, kind, r.choice([None, 50, 60, 61, 90, 300]) if kind == "<INS>" else 0, r.choice([None, "ACG"]), r.randrange(60), r.choice(["CIGAR", "SUPPLEMENTARY"]), not single and end - start <= 150, i))
    return spark.createDataFrame(rows, ROWS)


@pytest.mark.parametrize("seed", [1, 2])
def test_local_calls_equal_spread_calls(spark, monkeypatch, seed):
    clustered = clustering.start_clusters(some_rows(spark, seed)).localCheckpoint()
    order = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    local = order(calling.call_breakpoints(clustered))
    with monkeypatch.context() as m:  # every cluster is large
        m.setattr(calling, "has_large", lambda *a: True)
        m.setattr(calling, "LARGE", 1)
        assert order(calling.call_breakpoints(clustered)) == local
    with monkeypatch.context() as m:  # some are
        m.setattr(calling, "has_large", lambda *a: True)
        m.setattr(calling, "LARGE", 36)
        assert order(calling.call_breakpoints(clustered)) == local
    # rows of clusters without calls change nothing
    assert order(calling.call_breakpoints(clustering.numbered_starts(some_rows(spark, seed)))) == local
    assert len(local) > 20


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(x.lstrip(" :+-*()0123456789").startswith("Exchange") for x in plan.split("== Initial Plan ==")[0].split("\n"))


def test_calls_shuffle_each_row_once(spark):
    clustered = clustering.numbered_starts(some_rows(spark, 3))
    calls = calling.local_calls(clustered)
    # insertions by their cluster, ends by theirs
    assert _exchanges(calls) - 2 * sum(_exchanges(x) for x in [clustered]) <= 2


def test_islands_write_rows_once(spark, monkeypatch):
    written, real = [], ordered.settle
    monkeypatch.setattr(ordered, "settle", lambda df, name: written.append(_exchanges(df)) or real(df, name))
    out = clustering.numbered_starts(some_rows(spark, 4))
    # the rows once; the ends of chunks, what runs along them and back to the chunks
    assert len(written) == 1 and written[0] <= 4
    # behind the written rows: one row a chunk, by chunk and along them
    assert _exchanges(out) <= 2 and "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_defaults_imply_the_groups_support():
    assert DEFAULT.min_support >= DEFAULT.min_reads


def test_reports_number_clusters_once(spark, sf_dir, monkeypatch):
    from strandloom.plans import catalog

    written, real = [], ordered.settle
    monkeypatch.setattr(ordered, "settle", lambda df, name: written.append(name) or real(df, name))
    catalog.read_count_report(spark, sf_dir)
    assert written == ["islands"]
    catalog.call_cluster_statistics(spark, sf_dir)
    assert written == ["islands"] * 2
