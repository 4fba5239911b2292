"""Every fast query against its SQL, and operators whose rules SQL does not cover, on small inputs."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import cigar, kmers
from strandloom.functions import columns as x
from strandloom.functions.tests import two_sided
from strandloom.operators import breakpoints, calling, clustering, components, germline, ordered, panel, shortreads, somatic
from strandloom.plans import catalog
from strandloom.sources import text, variants
from strandloom.streaming.sessions import event_sessions

SF = "/root/testdata/sf0.001"
SLOW = {"cluster_stats_full", "allele_fraction", "features", "filter_strict_high", "filter_bed_lenient", "filter_legacy", "confidence", "reference_stats", "mean_somatic_af", "af_distribution", "depth_threshold", "bed_lookup", "depth_annotation", "vcf_alt", "germline_router", "kmer_match_dup", "coverage_merge", "coverage_dense"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.partition('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", [n for n in catalog.ORACLES if n not in SLOW])
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.execute(catalog.ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert len(at) == len(found.description)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_islands_do_not_depend_on_chunks(spark):
    r = np.random.default_rng(1)
    rows = [(int(k), int(p), int(p + e), i) for i, (k, p, e) in enumerate(zip(r.integers(0, 3, 600), r.integers(0, 9000, 600), r.integers(0, 60, 600)))]
    df = spark.createDataFrame(rows, "k int, p bigint, e bigint, i int")
    out = [{r.i: r.island for r in ordered.islands(df, ["k"], F.col("p"), F.col("e"), F.lit(7), [F.col("p"), F.col("i")], chunk).collect()} for chunk in (10, 100, 10**9)]
    assert out[0] == out[1] == out[2]
    for k in range(3):  # the fold, row by row
        n, reach = 0, -math.inf
        for _, p, e, i in sorted((t for t in rows if t[0] == k), key=lambda t: (t[1], t[3])):
            n, reach = n + (p - reach > 7), max(reach, e)
            assert out[0][i] == n


def test_p_values():
    # known quantiles of Student's t: 95 % two-sided
    for freedom, t in ((1, 12.7062), (5, 2.57058), (30, 2.04227), (1000, 1.96234)):
        assert abs(two_sided(np.array([t]), np.array([freedom]))[0] - 0.05) < 1e-5
    assert two_sided(np.array([0.0, np.inf]), np.array([4, 4])).tolist() == [1.0, 0.0]


def test_cigar_rules(spark):
    rows = spark.createDataFrame([("5S10M40I20M35D10M3S", "A" * 5 + "C" * 10 + "G" * 40 + "T" * 20 + "A" * 10 + "C" * 3)], "cigar string, seq string")
    ops = cigar.operations(F.col("cigar"))
    s = rows.select(cigar.summary(F.col("cigar"), F.lit(100)).alias("s"), cigar.summary(F.col("cigar"), F.lit(100), F.lit(True)).alias("r")).first()
    assert (s.s.softclip_left, s.s.softclip_right, s.s.ref_end, s.s.query_start, s.s.query_end) == (5, 3, 175, 5, 85)
    assert (s.r.softclip_left, s.r.softclip_right) == (3, 5)
    e = rows.select(cigar.insert_sequence(F.col("seq"), cigar.events(ops, F.lit(100), "I", 30)).alias("i"), cigar.events(ops, F.lit(100), "D", 30).alias("d"), cigar.events(ops, F.lit(100), "I", 30, clips_move=False).alias("q")).first()
    assert (e.i[0].start, e.i[0].seq) == (110, "G" * 40) and (e.d[0].start, e.d[0].end) == (130, 165) and e.q[0].query == 10
    flank = rows.select(*[f.alias(n) for f, n in zip(cigar.flanks(ops, F.lit(2)), "ab")]).first()
    assert (flank.a, flank.b) == (10, 20)
    one = F.array(F.struct(F.lit(10).alias("start"), F.lit(60).alias("end"), F.lit(50).alias("len")))
    two = F.array(F.struct(F.lit(30).alias("start"), F.lit(75).alias("end"), F.lit(45).alias("len")))
    none = F.filter(one, lambda _: F.lit(False))
    got = rows.select(cigar.similarity(one, none, two, none).alias("a"), cigar.similarity(none, none, none, none).alias("b"), cigar.similarity(one, none, none, none).alias("c")).first()
    assert (got.a, got.b, got.c) == (1.0, 1.0, 0.0)


def test_single_ends_and_insert_chains(spark):
    rows = [("c", 1, "c", "<INS>", n, i) for i, n in enumerate([100, 120, 151, 400])] + [("c", 1, "c", "+", 0, 9), ("c", 2, "c", "-", 0, 10)]
    df = spark.createDataFrame(rows, "start_chr string, cluster bigint, end_chr string, breakpoint_notation string, insert_length bigint, ord bigint")
    got = {r.ord: r.length_island for r in clustering.insert_length_islands(df, calling.GROUP).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3, 9: 3, 10: 1}


def test_components_and_similarity_clusters(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9)], "u bigint, v bigint")
    assert {r.node: r.root for r in components.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9}
    pairs = spark.createDataFrame([("k", 1, 2, 0.9), ("k", 2, 3, 0.2), ("j", 1, 2, 0.1)], "g string, a bigint, b bigint, similarity double")
    got = {(r.g, r.member): r.part for r in components.similarity_clusters(pairs, ["g"], 0.6).collect()}
    assert got == {("k", 1): 1, ("k", 2): 1, ("k", 3): 3, ("j", 1): 1, ("j", 2): 2}


def test_panel_reciprocal_matches(spark):
    calls = spark.createDataFrame([(1, "c", 1000, "c", 5000), (2, "c", 5400, "c", 1300), (3, "c", 1000, "d", 5000), (4, "c", 1600, "c", 5000)], "k bigint, start_chr string, start_loc bigint, end_chr string, end_loc bigint")
    known = spark.createDataFrame([("c", 1000, "c", 5000)], "chr1 string, start bigint, chr2 string, end bigint")
    assert sorted(r.k for r in panel.subtract(calls, known, "k").collect()) == [3, 4]


def test_edges_and_qualities(spark):
    row = spark.range(1).select(
        shortreads.edge_mismatch(F.lit("TTTACGTACG"), F.lit("GGGACGTACG")).alias("a"),
        shortreads.edge_mismatch(F.lit("TT"), F.lit("GG")).alias("b"),
        shortreads.good_share(F.lit("IIII####"), F.lit(4)).alias("c"),
        shortreads.good_share(F.lit("####IIII"), F.lit(4)).alias("d"),
        x.scale(F.lit(25), 10.0, 40.0).alias("e"),
        kmers.shares_kmer(F.lit("acgtacgt"), F.array(F.lit("GTAC")), 4).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (3, -1, True, False, 0.5, True)


def test_golden_variant_text(spark):
    # two published records: AF 10/64 and 10/83, ALT of '--'
    af = spark.createDataFrame([(10, 64), (10, 83)], "n bigint, d bigint").select(__import__("strandloom.operators.depth", fromlist=["d"]).allele_fraction(F.col("n"), F.col("d")).alias("af"))
    assert [r.af for r in af.collect()] == [0.156, 0.12]
    calls = spark.createDataFrame([("--", "chr20", 10, "chr20", 1373)], "breakpoint_notation string, start_chr string, start_loc bigint, end_chr string, end_loc bigint")
    first, second = variants.alt_alleles(F.lit("A"), F.lit("C"))
    assert tuple(calls.select(first.alias("a"), second.alias("b")).first()) == ("[chr20:1373[A", "[chr20:10[C")
    head = variants.header([("chr1", 5)], "/x/ref.fa", somatic=True)
    assert "##contig=<ID=chr1,length=5,assembly=ref.fa>" in head and "CONFIDENCE_SCORE" in head and head.endswith("FORMAT\tsample_name\n")
    m = spark.range(1).select(text.info_map(F.lit("A=1;FLAG;B=x=y;A=2")).alias("m"), text.info_map(F.lit(".")).alias("e")).first()
    assert m.m == {"FLAG": "true", "B": "x=y", "A": "2"} and m.e == {}


def test_depth_evidence_of_a_deletion(spark):
    calls = spark.createDataFrame([(1, "chr1", 5000, "chr1", 6000)], "call_id bigint, start_chr string, start_loc bigint, end_chr string, end_loc bigint")
    flags = ["is_unmapped", "is_secondary", "is_duplicate", "is_qcfail"]
    rows = [("chr1", s, s + 100, "100M", "ACGTACGTAC" * 10, None, False, False, False, False) for s in range(2800, 8300, 5) if not 4900 < s < 6000]
    reads = spark.createDataFrame(rows, "contig string, start bigint, end bigint, cigar string, seq string, qual string, " + ", ".join(f"{f} boolean" for f in flags))
    got = germline.depth_evidence(calls, reads, "call_id", 20.0).first()
    assert got.is_deletion and not got.is_duplication and got.deletion_level == "high" and got.p_global < 0.01


def test_sessions_in_batch_and_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    batch = event_sessions(events)
    assert batch.agg(F.sum("n_events")).first()[0] == events.count()
    events.write.parquet(str(tmp_path / "in"))
    stream = event_sessions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < spark.table("sessions").count() <= batch.count()


def test_breakpoint_schema(spark):
    assert set(breakpoints.COLUMNS) >= {"start_chr", "breakpoint_notation", "phase_set_end"} and somatic.too_short(50) is not None


def test_summary_of_odd_cigars(spark):
    rows = [("5S3S10M4S2N1X6S", False), ("5S3S10M4S2N1X6S", True), ("7S", False), ("7S", True), ("10M", None), ("3H10M3H", False), ("*", False), ("", False), (None, False), (None, True)]
    df = spark.createDataFrame(rows, "cigar string, is_reverse boolean")
    one = lambda **k: cigar.summary(F.col("cigar"), F.lit(100), F.col("is_reverse"), **k)
    got = df.select(one().alias("s"), one(skips=True, last_clip_only=True).alias("t")).collect()
    clips = [(r.s.softclip_left, r.s.softclip_right, r.t.softclip_left, r.t.softclip_right) for r in got]
    assert clips == [(5, 6, 5, 6), (6, 5, 6, 5), (7, 0, 7, 0), (7, 0, 7, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    ends = [(r.s.ref_start, r.s.ref_end, r.t.ref_end, r.s.query_start, r.s.query_end, r.s.match_length, r.s.mismatch_length) for r in got]
    assert ends[0] == (100, 111, 113, 5, 23, 10, 1) and ends[1] == (100, 111, 113, 6, 24, 10, 1)
    assert ends[2] == (100, 100, 100, 7, 7, 0, 0) and ends[6] == ends[7] == (100, 100, 100, 0, 0, 0, 0)
    assert ends[8] == ends[9] == (100, None, None, 0, None, None, None)
