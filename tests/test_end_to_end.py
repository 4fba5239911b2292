"""Extraction to files on small made alignments, with known events."""

import pytest
from pyspark.sql import functions as F

from strandloom.config import DEFAULT
from strandloom.operators import breakpoints
from strandloom.plans import pipeline
from strandloom.sources import bgzf, text

CONTIGS = [("chr1", 40_000), ("chr2", 30_000)]


def base(i):
    return "ACGT"[(i * 7 + i // 5) % 4]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("genome")
    with open(d / "ref.fa", "w") as f, open(d / "ref.fa.fai", "w") as g:
        for name, size in CONTIGS:
            f.write(f">{name}\n")
            place = f.tell()
            for at in range(0, size, 60):
                f.write("".join(base(i) for i in range(at, min(size, at + 60))) + "\n")
            g.write(f"{name}\t{size}\t{place}\t60\t61\n")

    def read(name, start, cigar, contig="chr1", flag=0, mapq=60, tags=None):
        n = sum(int(x[:-1]) for x in __import__("re").findall(r"\d+[MIS]", cigar))
        return {"read_name": name, "flag": flag, "contig": contig, "start": start, "mapq": mapq, "cigar": cigar, "seq": "".join(base(i) for i in range(n)), "tags": tags}

    plain = [read(f"p{i}", 5_000 + i * 250, "4000M") for i in range(60)]
    deleted = [read(f"d{i}", 8_000 + i, f"{2000 - i}M500D2000M", tags={"HP": 1, "PS": 7}) for i in range(8)]
    split = [read(f"t{i}", 20_000, f"{1500}M1500S", tags={"SA": f"chr2,10001,+,1500S1500M,60,0;"}) for i in range(6)]
    shared = [read(f"g{i}", 25_000 + i, "1000M300I1000M") for i in range(6)]
    order = lambda rows: sorted(rows, key=lambda r: (r["contig"], r["start"]))
    bgzf.write_alignments(str(d / "tumor.bam"), CONTIGS, order(plain + deleted + split + shared + [read("x", 100, "100M", flag=0x100)]), block=20_000)
    bgzf.write_alignments(str(d / "normal.bam"), CONTIGS, order([{**r, "read_name": "n" + r["read_name"]} for r in plain + shared] + [read(f"m{i}", 9_000 + i * 10, "3000M", contig="chr2") for i in range(30)]), block=20_000)
    return d


def test_reader_splits_and_filters(spark, files):
    bgzf.register(spark)
    whole = spark.read.format("alignments").load(str(files / "tumor.bam"))
    parts = spark.read.format("alignments").option("splitbytes", 4000).load(str(files / "tumor.bam"))
    assert parts.rdd.getNumPartitions() > 1
    assert whole.count() == parts.count() == 81
    assert whole.exceptAll(parts).count() == 0
    near = parts.where("contig = 'chr1' and start >= 8000 and start < 8008")
    assert near.count() == 9 and whole.where("read_name like 'd%'").count() == 8  # one plain read starts there too
    row = whole.where("read_name = 'd3'").first()
    assert (row.start, row.end, row.cigar, row.hp, row.ps, row.mapq) == (8003, 12_500, "1997M500D2000M", 1, 7, 60)
    assert bgzf.contig_lengths(str(files / "tumor.bam")) == CONTIGS


def test_extraction_and_files(spark, files, tmp_path):
    inputs = pipeline.Inputs(str(files / "tumor.bam"), str(files / "normal.bam"), str(files / "ref.fa"), str(tmp_path), sample="s1")
    reads = pipeline.read_samples(spark, inputs)
    found = breakpoints.extract_breakpoints(reads)
    kinds = {(r.breakpoint_notation, r.sample): r["count"] for r in found.groupBy("breakpoint_notation", "sample").count().collect()}
    assert kinds[("+-", "tumor")] == 8 + 6 and kinds[("<INS>", "tumor")] == 6 and kinds[("<INS>", "normal")] == 6
    junction = found.where("source = 'SUPPLEMENTARY'").first()
    assert (junction.start_chr, junction.start_loc, junction.end_chr, junction.end_loc) == ("chr1", 21_500, "chr2", 10_001)
    final = pipeline.run(spark, inputs, DEFAULT)
    rows = {(r.breakpoint_notation, r.start_chr, r.end_chr): r for r in text_calls(spark, tmp_path).collect()}
    assert final.count() <= len(rows)
    lines = (tmp_path / "all_sv_breakpoints.vcf").read_text().splitlines()
    assert lines[0] == "##fileformat=VCFv4.2" and sum(x.startswith("##contig") for x in lines) == 2
    body = [x.split("\t") for x in lines if not x.startswith("#")]
    assert len(body) == 5  # two records for each of two junctions, one for the insertion
    parsed = text.read_single_sample(spark, str(tmp_path / "all_sv_breakpoints.vcf"))
    deletion = parsed.where("alt like '%[%' and svtype = 'BND' and svlen = 500 and id like '%_1'").first()
    assert deletion.pos == 10_000 and deletion.INFO_TUMOR_READ_SUPPORT == "8" and deletion.sample == "0/1"
    shaped = text.shape_features(parsed)
    assert shaped.where("SVTYPE_NUM = 1").count() == 1 and "TUMOR_AF_0" in shaped.columns
    assert (tmp_path / "all_sv_breakpoints_normal.vcf").read_text().count("\n") == sum(x.startswith("#") for x in lines)


def text_calls(spark, path):
    rows = text.read_vcf(spark, str(path / "all_sv_breakpoints.vcf"))
    get = lambda k: F.try_element_at("info", F.lit(k))
    return rows.select(get("BP_NOTATION").alias("breakpoint_notation"), F.col("chrom").alias("start_chr"), F.col("alt").alias("end_chr"))


def test_arguments(files, tmp_path):
    for name in ("tumor.bam", "normal.bam"):
        (files / f"{name}.bai").touch()
    given = ["--tumor", str(files / "tumor.bam"), "--normal", str(files / "normal.bam"), "--reference", str(files / "ref.fa"), "--output", "o"]
    inputs, config = pipeline.parse([*given, "--min-support", "5", "--platform", "ont", "--refine"])
    assert inputs.tumor == given[1] and config.min_support == 5 and config.platform == "ONT" and config.refine and config.sample_length("normal") == 30
    assert pipeline.parse([*given, "--mode", "long-read-only", "--short-reads", "absent"])[0].short_reads is None
    for more in (["--tumor", "absent"], ["--mode", "hybrid"], ["--short-reads", "absent"], ["--panel", "absent"], ["--min-length", "0"], ["--reference", str(files / "tumor.bam")]):
        with pytest.raises(SystemExit):
            pipeline.parse([*given, *more])
    with pytest.raises(SystemExit):
        pipeline.parse(["--tumor", "t"])
    for name in ("tumor.bam", "normal.bam"):
        (files / f"{name}.bai").unlink()


def test_refinement_by_alignments(spark):
    from strandloom.operators import refinement

    rows = [("chr1", 1, "chr1", 1, r, "tumor" if r[0] == "t" else "normal", 1000, 1400) for r in ("t1", "t2", "t3", "t4", "t5", "n1")]
    ends = spark.createDataFrame(rows, "start_chr string, cluster bigint, end_chr string, end_cluster bigint, read_name string, sample string, start_loc bigint, end_loc bigint")
    cigars = {"t1": "500M200D500M", "t2": "510M200D500M", "t3": "900M60I300M", "t4": "905M60I300M"}
    reads = spark.createDataFrame([(r, "chr1", 500, 1700, x) for r, x in cigars.items()] + [("t1", "chr1", 900, 1700, "800M")], "read_name string, contig string, start bigint, end bigint, cigar string")
    keys = ["start_chr", "cluster", "end_chr", "end_cluster"]
    got = refinement.refine(ends, reads, keys).collect()
    part = {}
    for r in got:
        part.setdefault(r.read_name, set()).add(r.part)
    assert part["t1"] == part["t2"] != part["t3"] == part["t4"] and part["t5"] == {0}
    assert part["n1"] == part["t1"] | part["t3"] and len(got) == 7
    near = ends.withColumn("end_loc", F.col("start_loc") + 50)
    assert {r.part for r in refinement.refine(near, reads, keys).collect()} == {0}


def test_indexed_sequences_equal_whole_records(spark, files, monkeypatch):
    monkeypatch.setattr(text, "RANGE", 15_000)
    path = str(files / "ref.fa")
    key = lambda df: sorted((r.contig, r.chunk, r.sequence) for r in df.collect())
    whole = key(text.sequence_chunks(spark, path, 7000))
    assert key(text.indexed_chunks(spark, path, size=7000)) == whole and len(whole) == 6 + 5
    assert key(text.indexed_chunks(spark, path, ["chr2"], 7000)) == [r for r in whole if r[0] == "chr2"]
    assert "".join(s for c, _, s in whole if c == "chr1") == "".join(base(i) for i in range(40_000))


def test_a_large_record_takes_linear_time(spark, tmp_path):
    import time

    line = ("ACGTN" * 12 + "\n").encode()
    with open(tmp_path / "big.fa", "wb") as f:
        f.write(b">chr1 long\r\n" + line * 333_333)
    with open(tmp_path / "big.fa.fai", "w") as f:
        f.write(f"chr1\t{60 * 333_333}\t12\t60\t61\n")
    start = time.monotonic()
    got = text.indexed_chunks(spark, str(tmp_path / "big.fa")).agg(F.sum(F.length("sequence")).alias("n"), F.count("*").alias("rows")).first()
    assert tuple(got) == (19_999_980, 2000) and time.monotonic() - start < 20


def test_supported_groups(spark):
    from strandloom.operators import clustering

    rows = spark.createDataFrame([("a", "r1"), ("a", "r1"), ("b", "r1"), ("b", "r2"), ("c", None), ("c", None), ("d", None), ("d", "r")], "g string, read_name string")
    for least, want in ((1, {"a", "b", "d"}), (2, {"b"}), (3, set())):
        assert {r.g for r in clustering.supported(rows, ["g"], least).collect()} == want


def linear_index(path):
    """A .bai file without bins, from a walk over the records."""
    import struct

    with bgzf.open_input(path) as file:
        blocks = bgzf.Blocks(file)
        _, contigs = bgzf.read_header(blocks)
        first = [{} for _ in contigs]
        spans = [[] for _ in contigs]
        while True:
            block, place = blocks.tell()
            head = blocks.read(4)
            if len(head) < 4:
                break
            row = bgzf.decode(blocks.read(struct.unpack("<i", head)[0]), contigs)
            i = [n for n, _ in contigs].index(row["contig"])
            for w in range(row["start"] >> 14, (row["end"] - 1 >> 14) + 1):
                first[i].setdefault(w, block << 16 | place)
            after = blocks.tell()
            spans[i].append((block << 16 | place, after[0] << 16 | after[1]))
    out = b"BAI\x01" + struct.pack("<i", len(contigs))
    for i in range(len(contigs)):
        out += struct.pack("<iIi", 1, 0, 1) + struct.pack("<QQ", spans[i][0][0], spans[i][-1][1]) if spans[i] else struct.pack("<i", 0)
        n = max(first[i], default=-1) + 1
        out += struct.pack(f"<i{n}Q", n, *[first[i].get(w, 0) for w in range(n)])
    with open(path + ".bai", "wb") as f:
        f.write(out)


def test_predicates_read_only_their_blocks(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    import random

    r = random.Random(5)
    rows = [{"read_name": f"r{i}", "flag": 0, "contig": c, "start": s, "mapq": 60, "cigar": "100M", "seq": "".join(r.choices("ACGT", k=100))} for c in ("chr1", "chr2") for i, s in enumerate(range(0, 400_000, 100))]
    path = str(tmp_path / "many.bam")
    bgzf.write_alignments(path, [("chr1", 500_000), ("chr2", 500_000)], rows, block=4000)
    linear_index(path)

    def read(*filters):
        reader = bgzf.AlignmentReader({"path": path, "splitbytes": "20000"})
        assert list(reader.pushFilters(list(filters))) == []
        bytes_read = []

        class Counted(bgzf.Blocks):
            def _load(self):
                ok = super()._load()
                bytes_read.append(self.next - self.block_at)
                return ok

        plain, bgzf.Blocks = bgzf.Blocks, Counted
        try:
            parts = reader.partitions()
            found = [(n, s) for p in parts for b in reader.read(p) for n, s in zip(b.column("contig").to_pylist(), b.column("start").to_pylist())]
        finally:
            bgzf.Blocks = plain
        return found, sum(bytes_read), len(parts)

    whole, size, n = read()
    assert len(whole) == 8000 and n > 4
    one, of_one, _ = read(EqualTo(("contig",), "chr2"))
    assert one == [x for x in whole if x[0] == "chr2"] and of_one < 0.75 * size
    near, of_near, _ = read(EqualTo(("contig",), "chr2"), GreaterThanOrEqual(("start",), 150_000), LessThan(("start",), 160_000))
    assert near == [x for x in whole if x[0] == "chr2" and 150_000 <= x[1] < 160_000] and of_near < 0.25 * size
    assert read(EqualTo(("contig",), "chr2"), GreaterThanOrEqual(("start",), 450_000))[0] == []
    assert read(EqualTo(("contig",), "chr9"))[0] == []
    bgzf.register(spark)
    many = spark.read.format("alignments").load(path)
    assert many.where("contig = 'chr9'").count() == 0 and many.where("contig = 'chr1' and start < 1000").count() == 10


def test_numbers_in_order(spark):
    from strandloom.operators import ordered

    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.lit("x").alias("o")).repartition(7)
    got = ordered.numbered(rows, [F.col("k")], "at").collect()
    assert {(r.k, r["at"]) for r in got} == {(i, i) for i in range(500)}
    assert ordered.numbered(rows.limit(0), [F.col("k")], "at").count() == 0


def test_regions_read_only_their_blocks(spark, tmp_path):
    import random

    r = random.Random(9)
    rows = [{"read_name": f"{c}-{i}", "flag": 0, "contig": c, "start": s, "mapq": 60, "cigar": r.choice(["100M", "50M3000D50M", "20S80M"]), "seq": "".join(r.choices("ACGT", k=100))} for c in ("chr1", "chr2", "chr3") for i, s in enumerate(range(0, 400_000, 100))]
    rows += [{"read_name": "far", "flag": 0, "contig": "chr2", "start": 100, "mapq": 60, "cigar": "50M390000D50M", "seq": "A" * 100}]
    rows.sort(key=lambda x: (x["contig"], x["start"]))
    path = str(tmp_path / "many.bam")
    bgzf.write_alignments(path, [(f"chr{i}", 500_000) for i in (1, 2, 3)], rows, block=4000)
    bgzf.write_index(path)
    bgzf.register(spark)
    whole = spark.read.format("alignments").load(path).collect()
    read = []

    class Counted(bgzf.Blocks):
        def _load(self):
            ok = super()._load()
            read.append(self.block_at)
            return ok

    def of(regions, split=30_000):
        import json

        reader = bgzf.AlignmentReader({"path": path, "splitbytes": str(split), "regions": json.dumps(regions)})
        plain, bgzf.Blocks = bgzf.Blocks, Counted
        try:
            parts, taken = reader.partitions(), []
            read.clear()
            for p in parts:
                taken += [row for b in reader.read(p) for row in zip(b.column("read_name").to_pylist(), b.column("start").to_pylist())]
        finally:
            bgzf.Blocks = plain
        return sorted(taken), [x for x in read if x], len(parts)  # the first block is the header's

    for regions in ({"chr2": [[150_000, 151_000]]}, {"chr1": [[0, 50]], "chr3": [[399_950, 500_000]]}, {"chr2": [[i, i + 10] for i in range(0, 400_000, 9000)]}, {"chrX": [[5, 9]]}, {"chr1": [[499_000, 500_000]]}, {}):
        want = sorted((x.read_name, x.start) for x in whole if any(x.start < high and x.end > low for low, high in regions.get(x.contig, [])))
        got, blocks, parts = of(regions)
        assert got == want
        assert len(blocks) <= 1.2 * len(set(blocks)) + parts  # a block that several regions need is read once
    assert of({"chr2": [[150_000, 151_000]]})[1].__len__() < 0.1 * len(of({f"chr{i}": [[0, 500_000]] for i in (1, 2, 3)})[1])
    assert of({f"chr{i}": [[0, 500_000]] for i in (1, 2, 3)})[2] > 3
    spans = spark.createDataFrame([("chr2", 150_000, 150_400), ("chr2", 150_900, 151_000), ("chr9", 1, 5), (None, 1, 2), ("chr1", 7, None), ("chr1", 9, 9)], "contig string, low bigint, high bigint")
    want = sorted(x.read_name for x in whole if x.contig == "chr2" and x.start < 151_000 and x.end > 150_000)
    assert sorted(x.read_name for x in bgzf.near_regions(spark, path, spans).collect()) == want
    near = bgzf.near_regions(spark, path, spans, most=0)  # too many: the whole file
    assert near.count() == len(whole)
    assert bgzf.near_regions(spark, path, spans.limit(0)).count() == 0


def test_germline_filter_reads_once_and_only_near_calls(spark, tmp_path):
    import random

    from strandloom.operators import germline

    r = random.Random(4)
    genome = "".join(r.choices("ACGT", k=300_000))
    lost = lambda s: 60_000 <= s < 61_000  # a deletion in the normal sample too
    rows = [{"read_name": f"p{i}", "flag": 0x21, "contig": "chr1", "start": s, "mapq": 60, "cigar": "100M", "seq": genome[s : s + 100], "mate_contig": "chr1", "mate_start": s + 300, "template_length": 400} for i, s in enumerate(range(0, 290_000, 10)) if not lost(s) and not lost(s + 99)]
    rows += [{"read_name": f"d{i}", "flag": 0, "contig": "chr1", "start": 59_950 + i, "mapq": 60, "cigar": f"{50 - i}M1000D{50 + i}M", "seq": genome[59_950 + i : 60_000] + genome[61_000 : 61_050 + i]} for i in range(0, 40, 2)]
    rows += [{"read_name": f"j{i}", "flag": 0x1, "contig": "chr1", "start": 200_000 + i, "mapq": 60, "cigar": "100M", "seq": genome[200_000 + i : 200_100 + i], "mate_contig": "chr2", "mate_start": 5_000 + i, "template_length": 0} for i in range(8)]
    rows.sort(key=lambda x: x["start"])
    path = str(tmp_path / "short.bam")
    bgzf.write_alignments(path, [("chr1", 300_000), ("chr2", 300_000)], rows, block=8000)
    bgzf.write_index(path)
    bgzf.register(spark)
    schema = "count bigint, start_chr string, start_loc bigint, end_chr string, end_loc bigint, breakpoint_notation string, n_sequences bigint"
    calls = spark.createDataFrame([(1, "chr1", 60_000, "chr1", 61_000, "+-", 1), (2, "chr1", 120_000, "chr1", 120_800, "+-", 1), (3, "chr1", 200_000, "chr2", 5_000, "+-", 1), (4, "chr1", 240_000, "chr2", 9_000, "+-", 1), (5, "chr1", 250_000, "chr1", 250_400, "++", 1), (6, "chr1", -1, "chr1", 5, "+-", 1), (7, "chr1", 260_000, "chr1", 260_000, "<INS>", 30), (8, "chr1", 1, "chr1", 90_000, "-+", 1)], schema)
    reference = spark.createDataFrame([(1, genome[60_000:61_000]), (2, genome[120_000:120_800])], "count bigint, sequence string")
    whole = spark.read.format("alignments").load(path)
    near = bgzf.near_regions(spark, path, germline.test_spans(calls, "count"))
    assert near.count() < 0.2 * whole.count()
    kept = [sorted(x["count"] for x in germline.filter_germline(calls, reads, reference, "count", 12.5).collect()) for reads in (whole, near)]
    assert kept == [[2, 4, 5, 6, 7, 8]] * 2
    plan = germline.evidence_rows(calls, near, "count")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan alignments") == 1


def test_splits_without_an_index(spark, tmp_path):
    import random

    r = random.Random(3)
    size = lambda: r.choice([30, 100, 100, 5000])
    rows = []
    for i, s in enumerate(range(0, 300_000, 60)):
        n = size()
        rows.append({"read_name": f"read{i}", "flag": 0, "contig": "chr1", "start": s, "mapq": 60, "cigar": f"{n}M", "seq": "".join(r.choices("ACGT", k=n)), "tags": {"HP": i % 3, "SA": "chr2,5,+,3M,60,0;"}})
    rows.insert(2000, {**rows[2000], "read_name": "long", "cigar": "400000M", "seq": "ACGT" * 100_000})
    path = str(tmp_path / "plain.bam")
    bgzf.write_alignments(path, [("chr1", 900_000), ("chr2", 10)], rows, block=9000)
    bgzf.register(spark)
    for split in (3_000, 50_000, 10**9):
        reader = bgzf.AlignmentReader({"path": path, "splitbytes": str(split)})
        parts = reader.partitions()
        assert len(parts) > 10 or split > 3_000
        assert [n for p in parts for b in reader.read(p) for n in b.column("read_name").to_pylist()] == [x["read_name"] for x in rows]
    whole = spark.read.format("alignments").option("splitbytes", 40_000).load(path)
    assert whole.rdd.getNumPartitions() > 4 and whole.count() == len(rows)


def test_wide_index(tmp_path):
    import json
    import struct

    rows = [{"read_name": f"r{i}", "flag": 0, "contig": "chr1", "start": s, "mapq": 60, "cigar": "100M", "seq": "ACGTTGCAAC" * 10} for i, s in enumerate([*range(0, 40_000, 100), *range(700_000_000, 700_040_000, 100)])]
    path = str(tmp_path / "wide.bam")
    bgzf.write_alignments(path, [("chr1", 900_000_000)], rows, block=3000)
    shift, depth = 14, 6
    levels = [(((1 << 3 * k) - 1) // 7, shift + 3 * (depth - k)) for k in range(depth + 1)]
    bins = {}
    with bgzf.open_input(path) as file:
        blocks = bgzf.Blocks(file)
        bgzf.read_header(blocks)
        for row in rows:
            begin, end = blocks.tell(), None
            blocks.read(struct.unpack("<i", blocks.read(4))[0])
            end = blocks.tell()
            low, high = row["start"], row["start"] + 99
            number = next(first + (low >> bits) for first, bits in reversed(levels) if low >> bits == high >> bits)
            bins.setdefault(number, []).append((begin[0] << 16 | begin[1], end[0] << 16 | end[1]))
    out = b"CSI\x01" + struct.pack("<iiii", shift, depth, 0, 1) + struct.pack("<i", len(bins))
    for number, chunks in sorted(bins.items()):
        out += struct.pack("<IQi", number, chunks[0][0], 1) + struct.pack("<QQ", chunks[0][0], chunks[-1][1])
    with open(path + ".csi", "wb") as f:
        f.write(bgzf._block(out) + bgzf._block(b""))
    reader = bgzf.AlignmentReader({"path": path, "splitbytes": "5000", "regions": json.dumps({"chr1": [[700_010_000, 700_010_050]]})})
    got = [s for p in reader.partitions() for b in reader.read(p) for s in b.column("start").to_pylist()]
    assert got == [x["start"] for x in rows if x["start"] < 700_010_050 and x["start"] + 100 > 700_010_000]
    assert sum((b >> 16) - (a >> 16) for p in reader.partitions() for a, b in p.spans) < 0.6 * (tmp_path / "wide.bam").stat().st_size
    plain = bgzf.AlignmentReader({"path": path, "splitbytes": "5000"})
    assert len(plain.partitions()) > 1 and sum(b.num_rows for p in plain.partitions() for b in plain.read(p)) == len(rows)
