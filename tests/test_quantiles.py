"""Quantiles by counts over ranges, chains of insert lengths, and variant files in parts, against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import calling, clustering, somatic
from strandloom.operators.quantiles import quantiles, wide_quantiles
from strandloom.operators.stages import settle
from strandloom.plans import catalog
from strandloom.sources import variants

SHARES = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p75": 0.75, "p100": 1.0}


@pytest.mark.parametrize("width", [0.5, 7, 10**6])
def test_equal_to_percentile(spark, width):
    rng = random.Random(3)
    rows = [(g, h, rng.choice([None, rng.randint(-50, 50), float(rng.randint(0, 3)), rng.random() * 1000])) for g in range(6) for h in "ab" for _ in range(rng.choice([1, 2, 3, 40, 301]))]
    rows = [(g, h, None if x is None else float(x)) for g, h, x in rows] + [(9, "a", None), (10, "a", 4.0), (11, "b", -2.0), (11, "b", -2.0)]
    df = spark.createDataFrame(rows, "g int, h string, x double").repartition(3)
    want = {(r.g, r.h): r for r in df.groupBy("g", "h").agg(*[F.percentile("x", F.lit(s)).alias(n) for n, s in SHARES.items()], F.percentile(F.col("x") * -3, F.lit(0.5)).alias("m")).collect()}
    got = {(r.g, r.h): r for r in wide_quantiles(df, ["g", "h"], [(F.col("x"), width, SHARES), (F.col("x") * -3, width, {"m": 0.5})]).collect()}
    assert (9, "a") not in got and set(got) == {k for k, r in want.items() if r.p0 is not None}
    for k, r in got.items():
        assert [r[n] for n in (*SHARES, "m")] == [want[k][n] for n in (*SHARES, "m")], k


def test_one_large_group_has_no_large_buffer(spark):
    df = spark.range(300_000).select(F.lit(1).alias("g"), (F.xxhash64("id") % 100_000).alias("x"))
    out = quantiles(df, ["g"], [(F.col("x"), 1 << 10, SHARES)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "percentile" not in plan
    want = df.agg(*[F.percentile("x", F.lit(s)).alias(n) for n, s in SHARES.items()]).first()
    assert {r.name: r.value for r in out.collect()} == want.asDict()


def test_no_keys_no_rows(spark):
    empty = spark.createDataFrame([], "tumor_af double, tumor_reads bigint, min_mapq double")
    assert quantiles(empty, [], [(F.col("tumor_af"), 0.1, SHARES)]).collect() == []
    assert set(somatic.reference_statistics(empty).first().asDict().items()) == {*[(f"af_p{n}", 0.0) for n in (10, 25, 50, 75, 90)], ("support_median", 0.0), ("mapq_median", 0.0), ("total_variants", 0)}
    some = spark.createDataFrame([(0.125, 4, 60.0), (None, 7, None), (1.5, 9, 20.5)], empty.schema)
    got = somatic.reference_statistics(some).first()
    assert (got.af_p50, got.support_median, got.mapq_median, got.total_variants) == (0.8125, 7.0, 40.25, 3)


def test_insert_chains_of_large_groups(spark):
    rng = random.Random(5)
    rows = [("c", k, e, "<INS>", rng.choice([50, 60, 61, 75, 76, 77, 300, 376, 5000, None]), i) for i, (k, e) in enumerate((k, e) for k in (1, 2) for e in ("c", "d") for _ in range(30))]
    rows += [("c", 3, "c", "<INS>", 80, 1000 + i) for i in range(5000)] + [("c", 3, "c", "<INS>", 101, 7000)]
    rows += [("c", 3, "c", "+", 0, 8000)]
    df = spark.createDataFrame(rows, "start_chr string, cluster bigint, end_chr string, breakpoint_notation string, insert_length bigint, ord bigint")
    out = clustering.insert_length_islands(df, calling.GROUP)
    got = {r.ord: r.length_island for r in out.collect()}
    want, groups = {}, {}
    for r in rows[:-1]:
        groups.setdefault(r[:3], []).append(r)
    for members in groups.values():
        island, before = 0, None
        for n, (*_, length, ord_) in enumerate(sorted(members, key=lambda r: (r[4] is not None, r[4] or 0, r[5]))):
            same = before == length and n > 0
            if not same and (before is None or length > math.ceil(before * 1.25)):
                island += 1
            want[ord_], before = island, length
    assert got == want | {8000: 2} and len(got) == len(rows)
    # what the window orders are distinct lengths
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("Aggregate" in plan[at : at + 2500] for at in [plan.index("Window")]) and "ord#" not in plan[plan.index("Window") :].split("\n")[0]
    with pytest.raises(ValueError):
        clustering.insert_length_islands(df, calling.GROUP, 1.5)


def test_variant_files_are_written_in_parts(spark, tmp_path):
    text = {(i, n): f"chr1\t{i}\té{'x' * (i % 50)}\t{n}" for i in range(3000) for n in (1, 2)}
    df = spark.createDataFrame([(i, n, t) for (i, n), t in text.items()], "count bigint, n int, line string").repartition(5)
    path = f"{tmp_path}/out/calls.vcf"
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert variants.write_variants(spark, df, path, "#head\n")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert open(path, "rb").read() == ("#head\n" + "".join(text[k] + "\n" for k in sorted(text))).encode()
    assert variants.write_variants(spark, df.where("count = 7"), path, "#head\n")
    assert open(path).read() == f"#head\n{text[7, 1]}\n{text[7, 2]}\n"
    assert not variants.write_variants(spark, df.limit(0), f"{tmp_path}/none.vcf", "#head\n", skip_empty=True)
    assert variants.write_variants(spark, df.limit(0), path, "#head\n") and open(path).read() == "#head\n"


def test_large_groups_have_the_same_statistics(spark, sf_dir):
    rows = settle(catalog._clustered(spark, sf_dir), "clustered")
    keys = [*calling.GROUP, "breakpoint_notation"]
    two = rows.where("end_loc is not null")
    forms = [
        lambda large: clustering.cluster_statistics(rows, large=large),
        lambda large: clustering.comprehensive_statistics(rows, large=large).drop("phase_sets_count"),
        lambda large: calling.supported_calls(two, keys, large=large),
    ]
    for form in forms:
        some, none, every = ([sorted(map(str, form(large).collect()))] for large in (250, 1 << 40, 1))
        assert len(none[0]) > 10 and some == none == every


def _breakpoints(spark, rows):
    base = {"start_chr": "c", "end_chr": "c", "source": "CIGAR", "mapq": 60, "is_nearby_event": True, "haplotype_start": None, "haplotype_end": None, "phase_set_start": None, "phase_set_end": None}
    full = [base | {"ord": i, "end_loc": r["start_loc"], "inserted_sequence": "ACGT" if r["breakpoint_notation"] == "<INS>" else None} | r for i, r in enumerate(rows)]
    schema = (
        "start_chr string, cluster bigint, end_chr string, start_loc bigint, end_loc bigint, breakpoint_notation string, insert_length bigint, inserted_sequence string, source string, sample string, "
        "read_name string, mapq int, is_nearby_event boolean, ord bigint, haplotype_start int, haplotype_end int, phase_set_start bigint, phase_set_end bigint"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], schema)


def test_single_ends_are_calls_of_their_own_unless_insertions_join_them(spark):
    rng = random.Random(9)
    row = lambda cluster, notation, length, sample, name: {"cluster": cluster, "breakpoint_notation": notation, "insert_length": length, "sample": sample, "read_name": name, "start_loc": 1000 * cluster + rng.randint(0, 30)}
    rows = [row(1, "<INS>", 100, "tumor", f"r{i}") for i in range(3)] + [row(1, "+", 0, "tumor", "s0"), row(1, "-", 0, "normal", "s1")]  # one island, one call
    rows += [row(2, "<INS>", 100, "tumor", "r0")] + [row(2, "+", 0, "tumor", f"s{i}") for i in range(4)] + [row(2, "-", 0, "normal", f"t{i}") for i in range(2)]  # "+" alone has support
    rows += [row(3, "+", 0, "tumor", "same") for _ in range(5)]  # one read
    rows += [row(4, "+", 0, "tumor", None) for _ in range(4)] + [row(4, "-", 0, "tumor", f"u{i % 3}") for i in range(6)]  # reads without a name count as none
    df = _breakpoints(spark, rows)
    for large in (calling.LARGE, 3, None):
        got = {(r.cluster, r.breakpoint_notation): r for r in calling.insertion_calls(df, large=large).collect()}
        assert set(got) == {(1, "<INS>"), (2, "+"), (4, "-")}
        assert (got[1, "<INS>"].tumor_reads, got[1, "<INS>"].normal_reads, got[1, "<INS>"].n_rows, got[1, "<INS>"].n_insertions, got[1, "<INS>"].sv_length) == (4, 1, 5, 3, 100)
        assert (got[2, "+"].tumor_reads, got[2, "+"].normal_reads, got[2, "+"].n_rows, got[2, "+"].n_sequences, got[2, "+"].sv_length) == (4, 0, 4, 0, 0)
        assert (got[4, "-"].tumor_reads, got[4, "-"].tumor_alignments) == (3, 6)
        for (cluster, notation), r in got.items():
            places = sorted(x["start_loc"] for x in rows if x["cluster"] == cluster and (cluster == 1 or x["breakpoint_notation"] == notation))
            middle = (places[(len(places) - 1) // 2] + places[len(places) // 2]) // 2
            assert (r.start_loc, r.end_loc) == (middle, middle)


def test_reads_of_each_sample(spark):
    rows = [("c", 1, "tumor", "a"), ("c", 1, "tumor", "a"), ("c", 1, "normal", "a"), ("c", 1, "tumor", None), ("c", 2, None, "b"), ("c", 3, "other", "d")]
    df = spark.createDataFrame(rows, "start_chr string, cluster bigint, sample string, read_name string")
    got = {r.cluster: (r.tumor_reads, r.normal_reads) for r in clustering.sample_reads(df, clustering.CLUSTER).collect()}
    assert got == {1: (1, 1), 2: (0, 0), 3: (0, 0)}
