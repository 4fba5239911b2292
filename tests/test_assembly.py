"""Contigs of planted reads, chains and cycles, placement on the reference, and the option of the command line."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import assembly
from strandloom.sources import bgzf


def letters(seed, n):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def tiled(sequence, size=100, step=4, copies=1):
    return [sequence[i : i + size] for i in [*range(0, len(sequence) - size + 1, step), len(sequence) - size] for _ in range(copies)]


def contigs_of(spark, groups, **options):
    rows = [(g, "start", s) for g, reads in groups.items() for s in reads]
    out = assembly.assemble(spark.createDataFrame(rows, "count bigint, side string, seq string").repartition(3), ["count", "side"], **options).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r["count"], r.number)):
        found.setdefault(r["count"], []).append((r.sequence, r.k))
    return found


def test_contigs_equal_planted_sequences(spark):
    r = random.Random(2)
    one, two = letters(1, 2000), letters(2, 700)
    noisy = [s[: (i := r.randrange(100))] + r.choice("ACGT") + s[i + 1 :] if r.random() < 0.3 else s for s in tiled(one, copies=3)]
    got = contigs_of(spark, {1: noisy, 2: tiled(two, copies=2) + [None, "", "ACGT"], 3: ["A" * 30], 4: tiled(letters(9, 100))})
    assert got[1][0] == (one, 75) and got[2] == [(two, 75)] and 3 not in got
    assert got[4] == [(letters(9, 100), 75)]  # the one read comes twice: at its step and as the last


def test_short_overlaps_take_short_kmers(spark):
    s = letters(4, 600)
    reads = [x for x in tiled(s, 80, 40, copies=2)]  # neighbours share 40 letters
    assert contigs_of(spark, {1: reads})[1][0] == (s, 35)


def test_the_frequent_side_of_a_bubble_is_taken(spark):
    s = letters(5, 400)
    other = s[:200] + ("A" if s[200] != "A" else "C") + s[201:]
    got = contigs_of(spark, {1: tiled(s, copies=4) + tiled(other, copies=2)})
    assert got[1][0][0] == s
    assert len(contigs_of(spark, {1: tiled(s, copies=2) + tiled(letters(6, 300), copies=2) + tiled(letters(7, 200), copies=2)}, most=2)[1]) == 2


def test_a_cycle_is_cut_at_its_least_kmer(spark):
    ring = letters(8, 150)
    reads = tiled(ring + ring[:120], copies=2)
    (sequence, k), *_ = contigs_of(spark, {1: reads}, ks=(35,))[1]
    assert len(sequence) == 150 + k - 1 and sequence in ring * 4
    assert sequence[:k] == min((ring * 2)[i : i + k] for i in range(150))


def test_no_reads(spark):
    empty = spark.createDataFrame([], "count bigint, side string, seq string")
    assert assembly.assemble(empty, ["count", "side"]).collect() == []


def test_breakpoints_of_contigs(spark):
    a, b = letters(11, 4000), letters(12, 4000)
    turn = str.maketrans("ACGT", "TGCA")
    contigs = [
        (1, "contig_1_span_0", a[500:1000] + a[1500:2000]),  # a deletion
        (2, "contig_2_start_0", a[1700:2000] + b[2500:2800]),  # two contigs
        (3, "contig_3_span_0", a[700:1000] + a[1500:1800].translate(turn)[::-1]),  # an inversion
        (4, "contig_4_span_0", a[600:1700]),  # the reference
        (5, "contig_5_span_0", "ACGT"),
    ]
    calls = spark.createDataFrame([(1, "chr1", 1000, "chr1", 1500), (2, "chr1", 2000, "chr2", 2500), (3, "chr1", 1000, "chr1", 1800), (4, "chr1", 1000, "chr1", 1500), (5, "chr1", 1000, "chr1", 1400)], "count bigint, start_chr string, start_loc bigint, end_chr string, end_loc bigint")
    windows = assembly.call_windows(calls, "count").collect()
    text = {"chr1": a, "chr2": b}
    reference = spark.createDataFrame([(w["count"], w.contig, w.low, text[w.contig][w.low : w.high]) for w in windows], "count bigint, contig string, offset bigint, sequence string")
    found = assembly.contig_breakpoints(spark.createDataFrame(contigs, "count bigint, contig_name string, sequence string"), reference, "count")
    got = {(r.read_name, r.start_chr, r.start_loc, r.end_chr, r.end_loc) for r in found.collect()}
    near = lambda name, *want: any(g[0] == name and g[1] == want[0] and g[3] == want[2] and abs(g[2] - want[1]) <= 2 and abs(g[4] - want[3]) <= 2 for g in got)
    assert near("contig_1_span_0", "chr1", 1000, "chr1", 1500) and near("contig_2_start_0", "chr1", 2000, "chr2", 2500) and near("contig_2_start_0", "chr2", 2500, "chr1", 2000)
    assert near("contig_3_span_0", "chr1", 1000, "chr1", 1800)
    assert {g[0] for g in got} == {"contig_1_span_0", "contig_2_start_0", "contig_3_span_0"}
    assert sorted(r["count"] for r in assembly.drop_explained(calls, found).collect()) == [4, 5]


def test_calls_that_normal_reads_explain_fall_away(spark, tmp_path):
    from strandloom.plans import pipeline
    from strandloom.sources import text

    a = letters(21, 60_000)
    with open(tmp_path / "ref.fa", "w") as f:
        f.write(">chr1\n" + "\n".join(a[i : i + 60] for i in range(0, len(a), 60)) + "\n")
    (tmp_path / "ref.fa.fai").write_text(f"chr1\t{len(a)}\t6\t60\t61\n")
    read = lambda name, start, cigar, seq: {"read_name": name, "flag": 0, "contig": "chr1", "start": start, "mapq": 60, "cigar": cigar, "seq": seq}
    rows = [read(f"n{i}", s, "100M", a[s : s + 100]) for i, s in enumerate(range(0, 59_900, 20))]
    junction = a[19_000:20_000] + a[20_600:21_600]  # 600 bases are gone from the normal sample as well
    for i, at in enumerate(range(905, 995, 3)):
        left = 1000 - at
        rows.append(read(f"j{i}", 19_000 + at, f"{left}M{100 - left}S" if left >= 50 else f"{left}S{100 - left}M", junction[at : at + 100]))
        if left < 50:
            rows[-1]["start"] = 20_600
    rows.sort(key=lambda x: x["start"])
    path = str(tmp_path / "short.bam")
    bgzf.write_alignments(path, [("chr1", len(a))], rows)
    bgzf.write_index(path)
    calls = spark.createDataFrame([(0, "chr1", 20_000, "chr1", 20_600, "+-"), (1, "chr1", 40_000, "chr1", 40_500, "+-")], "count bigint, start_chr string, start_loc bigint, end_chr string, end_loc bigint, breakpoint_notation string")
    inputs = pipeline.Inputs("t", "n", str(tmp_path / "ref.fa"), str(tmp_path / "out"), short_reads=path, assemble=True)
    chunks = text.indexed_chunks(spark, inputs.reference, ["chr1"])
    assert [r["count"] for r in pipeline.assembled(spark, calls, inputs, chunks).collect()] == [1]
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out/contigs.fastq").collect()]
    assert any(x.startswith("@contig_0_span_") for x in lines)


def test_the_option_needs_short_reads(tmp_path):
    from strandloom.plans import pipeline

    with pytest.raises(SystemExit):
        pipeline.parse(["--tumor", "t", "--normal", "n", "--reference", "r", "--output", "o", "--assemble"])


def test_reads_of_calls_come_with_their_mates(spark, sf_dir):
    from strandloom.plans import catalog, views

    calls = catalog._some_calls(spark, sf_dir).withColumn("breakpoint_notation", F.lit("+-"))
    reads = views.short_reads(spark, sf_dir)
    got = assembly.assembly_reads(calls, reads, "call_id")
    asked = []
    limited = assembly.assembly_reads(calls, reads, "call_id", mates=lambda spans: asked.append(spans.count()) or reads)
    assert got.count() == limited.count() > 0 and asked[0] > 0
    assert got.columns == ["call_id", "side", "seq"]
