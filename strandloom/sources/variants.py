"""Variant files: ALT strings, INFO text, lines, headers, and writers for files and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.columns import INSERTION
from strandloom.operators.stages import stored

c = F.col
STATISTICS = ("starts_std_dev", "mapq_mean", "event_size_std_dev", "event_size_median", "event_size_mean")

# Declarations of the output format, (ID, Number, Type, Description).
INFO = [
    ("SVTYPE", "1", "String", "Type of structural variant"),
    ("MATEID", "1", "String", "ID of mate breakends"),
    ("NORMAL_READ_SUPPORT", "1", "Integer", "Number of SV supporting normal reads"),
    ("TUMOR_READ_SUPPORT", "1", "Integer", "Number of SV supporting tumor reads"),
    ("NORMAL_ALN_SUPPORT", "1", "Integer", "Number of SV supporting normal alignments"),
    ("TUMOR_ALN_SUPPORT", "1", "Integer", "Number of SV supporting tumor alignments"),
    ("SVLEN", "1", "Integer", "Length of the SV"),
    ("TUMOR_DP_BEFORE", "2", "Integer", "Local tumor depth in bin before the breakpoint(s) of an SV"),
    ("TUMOR_DP_AT", "2", "Integer", "Local tumor depth in bin at the breakpoint(s) of an SV"),
    ("TUMOR_DP_AFTER", "2", "Integer", "Local tumor depth in bin after the breakpoint(s) of an SV"),
    ("NORMAL_DP_BEFORE", "2", "Integer", "Local normal depth in bin before the breakpoint(s) of an SV"),
    ("NORMAL_DP_AT", "2", "Integer", "Local normal depth in bin at the breakpoint(s) of an SV"),
    ("NORMAL_DP_AFTER", "2", "Integer", "Local normal depth in bin after the breakpoint(s) of an SV"),
    ("TUMOR_AF", "2", "Float", "Allele-fraction (AF) of tumor variant-supporting reads to tumor read depth (DP) at breakpoint"),
    ("NORMAL_AF", "2", "Float", "Allele-fraction (AF) of normal variant-supporting reads to normal read depth (DP) at breakpoint"),
    ("BP_NOTATION", "1", "String", "+- notation format of variant (same for paired breakpoints)"),
    ("SOURCE", "1", "String", "Source of evidence for a breakpoint - CIGAR (INS, DEL, SOFTCLIP), SUPPLEMENTARY or mixture"),
    ("CLUSTERED_READS_TUMOR", "1", "Integer", "Total number of tumor reads clustered at this location of any SV type"),
    ("CLUSTERED_READS_NORMAL", "1", "Integer", "Total number of normal reads clustered at this location of any SV type"),
    ("TUMOR_ALT_HP", "3", "Integer", "Counts of SV-supporting reads belonging to each haplotype in the tumor sample (1/2/NA)"),
    ("TUMOR_PS", ".", "String", "List of unique phase sets from the tumor supporting reads"),
    ("NORMAL_ALT_HP", "3", "Integer", "Counts of reads belonging to each haplotype in the normal sample (1/2/NA)"),
    ("NORMAL_PS", ".", "String", "List of unique phase sets from the normal supporting reads"),
    ("TUMOR_TOTAL_HP_AT", "3", "Integer", "Counts of all reads at SV location belonging to each haplotype in the tumor sample (1/2/NA)"),
    ("NORMAL_TOTAL_HP_AT", "3", "Integer", "Counts of all reads at SV location belonging to each haplotype in the normal sample (1/2/NA)"),
    ("END", "1", "Integer", "End position of the structural variant"),
]
SOMATIC_INFO = [
    ("CLASS", "1", "String", "Variant class prediction from legacy strict/lenient filters"),
    ("CONFIDENCE_SCORE", "1", "Float", "Confidence score based on multiple evidence sources"),
]


def alt_alleles(start_base: Column, end_base: Column) -> tuple[Column, Column]:
    """ALT of the first and the second record; the second is null for insertions and single ends."""
    n = c("breakpoint_notation")
    partner, own = F.concat(c("end_chr"), F.lit(":"), c("end_loc").cast("string")), F.concat(c("start_chr"), F.lit(":"), c("start_loc").cast("string"))
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    first = (
        F.when(n == INSERTION, F.lit(INSERTION))
        .when(n.isin("+", "-"), join(".", end_base))
        .when(n == "++", join(start_base, "]", partner, "]"))
        .when(n == "+-", join(start_base, "[", partner, "["))
        .when(n == "-+", join("]", partner, "]", start_base))
        .when(n == "--", join("[", partner, "[", start_base))
    )
    second = (
        F.when(n == "++", join(end_base, "]", own, "]"))
        .when(n == "+-", join("]", own, "]", end_base))
        .when(n == "-+", join(end_base, "[", own, "["))
        .when(n == "--", join("[", own, "[", end_base))
    )
    return first, second


def variant_type() -> Column:
    n = c("breakpoint_notation")
    return F.when(n == INSERTION, "INS").when(n.isin("+", "-"), "SBND").otherwise("BND")


def statistics_info() -> Column:
    """The five statistics of both clusters as INFO items."""
    items = [F.concat(F.lit(f"{end.upper()}_{s.upper()}="), c(f"{end}_{s}").cast("string")) for end in ("origin", "end") for s in STATISTICS]
    return F.concat_ws(";", *items)


def info_text() -> Column:
    """INFO of an annotated call, in the fixed order."""
    item = lambda name, value: F.concat(F.lit(f"{name}="), value.cast("string"))
    both = lambda name, a, b: F.concat(F.lit(f"{name}="), c(a).cast("string"), F.lit(","), c(b).cast("string"))
    items = [item("SVTYPE", variant_type())]
    items += [item(f"{s.upper()}_{n}_SUPPORT", c(f"{s}_{f}")) for n, f in (("READ", "reads"), ("ALN", "alignments")) for s in ("normal", "tumor")]
    items.append(item("SVLEN", c("sv_length")))
    items += [both(f"{s.upper()}_DP_{p.upper()}", f"dp_{s}_{p}_start", f"dp_{s}_{p}_end") for s in ("tumor", "normal") for p in ("before", "at", "after")]
    items += [both(f"{s.upper()}_AF", f"af_{s}_start", f"af_{s}_end") for s in ("tumor", "normal")]
    items += [item("BP_NOTATION", c("breakpoint_notation")), item("SOURCE", c("source"))]
    items += [item(f"CLUSTERED_READS_{s.upper()}", c(f"clustered_{s}")) for s in ("tumor", "normal")]
    items += [F.concat(F.lit(f"{s.upper()}_ALT_HP=0,0,"), c(f"{s}_alignments").cast("string")) for s in ("tumor", "normal")]
    items += [item(f"{s.upper()}_TOTAL_HP_AT", c(f"hp_{s}_end")) for s in ("tumor", "normal")]
    return F.concat_ws(";", *items, statistics_info())


def variant_records(calls: DataFrame) -> DataFrame:
    """Calls with count, start_base and end_base -> one or two records each: the fields of a line."""
    first, second = alt_alleles(c("start_base"), c("end_base"))
    genotype = F.when(c("normal_reads") >= 1, "0/0").otherwise("0/1")
    record = lambda n, chrom, pos, base, alt: F.struct(F.lit(n).alias("n"), c(chrom).alias("chrom"), c(pos).alias("pos"), F.concat(F.lit("ID_"), c("count").cast("string"), F.lit(f"_{n}")).alias("id"), c(base).alias("ref"), alt.alias("alt"))
    pair = F.when(second.isNotNull(), F.array(record(1, "start_chr", "start_loc", "start_base", first), record(2, "end_chr", "end_loc", "end_base", second))).otherwise(F.array(record(1, "start_chr", "start_loc", "start_base", first)))
    rows = calls.select("count", F.explode(pair).alias("r"), info_text().alias("info"), genotype.alias("gt"))
    return rows.select("count", c("r.n").alias("n"), "r.chrom", "r.pos", "r.id", "r.ref", "r.alt", F.lit(".").alias("qual"), F.lit("PASS").alias("filter"), "info", F.lit("GT").alias("format"), "gt")


def variant_lines(records: DataFrame) -> DataFrame:
    fields = [c(x).cast("string") for x in ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "gt")]
    return records.select("count", "n", F.concat_ws("\t", *fields).alias("line"))


def header(contigs: list[tuple[str, int]], reference: str, sample: str = "sample_name", somatic: bool = False, source: str = "strandloom") -> str:
    """Header text of a variant file."""
    declare = lambda d: f'##INFO=<ID={d[0]},Number={d[1]},Type={d[2]},Description="{d[3]}">'
    lines = ["##fileformat=VCFv4.2", f"##source={source}"]
    lines += [f"##contig=<ID={n},length={size},assembly={reference.rpartition('/')[2]}>" for n, size in contigs]
    lines += [f'##{source}_args=""', f"##reference={{{reference}}}", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">']
    lines += [declare(d) for d in INFO]
    for end, name in (("ORIGIN", "Originating"), ("END", "End")):
        lines += [declare((f"{end}_{s.upper()}", "1", "Float", f"{name} cluster value for {s}")) for s in STATISTICS]
    lines += [declare(d) for d in SOMATIC_INFO] if somatic else []
    lines.append("#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample]))
    return "\n".join(lines) + "\n"


def _write(spark: SparkSession, path: str, head: str, parts: str | None = None) -> None:
    """Write a text file through the session's file systems: head, and then the files of the folder parts, in order."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    place = lambda x: (hadoop.fs.Path(x), hadoop.fs.Path(x).getFileSystem(conf))
    target, system = place(path)
    stream = system.create(target, True)
    try:
        stream.write(bytearray(head.encode()))
        if parts:
            folder, source = place(parts)
            found = [s.getPath() for s in source.listStatus(folder) if s.getPath().getName().startswith("part-")]
            for part in sorted(found, key=lambda p: (int(p.getName().split("-")[1]), p.getName())):
                piece = source.open(part)
                try:
                    hadoop.io.IOUtils.copyBytes(piece, stream, 1 << 16, False)
                finally:
                    piece.close()
    finally:
        stream.close()


def write_variants(spark: SparkSession, lines: DataFrame, path: str, head: str, skip_empty: bool = False) -> bool:
    """Write one variant file. Tasks sort and write ranges of the lines as text files; the driver's JVM only copies
    their bytes behind the header, one buffer at a time. With skip_empty nothing is written without lines."""
    if skip_empty and not lines.take(1):
        return False
    _write(spark, path, head, stored(lines.orderBy("count", "n").select("line"), "variant-lines"))
    return True


def write_statistics(spark: SparkSession, path: str, values: dict, mean_af: float) -> None:
    lines = ["=== Global Statistics ==="] + [f"{k}: {v}" for k, v in values.items()] + ["", "=== Additional Metrics ===", f"mean_af: {mean_af:.5f}", ""]
    _write(spark, path, "\n".join(lines))


def filter_summary(passed: DataFrame) -> DataFrame:
    """Mean and median of four confidence factors over passed calls."""
    names = ("af_confidence", "support_confidence", "quality_confidence", "noise_confidence")
    return passed.agg(F.count("*").alias("passed"), *[f(n).alias(f"{k}_{n}") for n in names for k, f in (("mean", F.avg), ("median", F.median))])


def write_filter_summary(spark: SparkSession, path: str, reference: dict, summary: dict) -> None:
    lines = ["=== Somatic Filtering Statistics ===", f"Reference AF percentiles: {[reference[f'af_p{p}'] for p in (10, 25, 50, 75, 90)]}"]
    lines += [f"Reference support median: {reference['support_median']}", f"Reference MAPQ median: {reference['mapq_median']}", f"Total variants processed: {reference['total_variants']}", f"Variants passed: {summary['passed']}"]
    if summary["passed"]:
        lines += ["", "=== Confidence Factor Distribution ==="]
        lines += [f"{n}: mean={summary[f'mean_{n}']:.3f}, median={summary[f'median_{n}']:.3f}" for n in ("af_confidence", "support_confidence", "quality_confidence", "noise_confidence")]
    _write(spark, path, "\n".join(lines) + "\n")
