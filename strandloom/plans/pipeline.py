"""The whole analysis: alignments of a tumor and a normal sample -> somatic variant files."""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import __version__
from strandloom.config import CONTIGS, DEFAULT, Config
from strandloom.operators import assembly, breakpoints, calling, clustering, coverage, depth, germline, ordered, panel, somatic
from strandloom.operators.stages import settle
from strandloom.sources import bgzf, text, variants


@dataclass(frozen=True)
class Inputs:
    tumor: str
    normal: str
    reference: str
    output: str
    regions: str | None = None
    panel: str | None = None
    short_reads: str | None = None
    short_coverage: float | None = None
    sample: str = "sample_name"
    assemble: bool = False


def read_samples(spark: SparkSession, inputs: Inputs) -> DataFrame:
    """Long reads of both samples with a sample column."""
    bgzf.register(spark)
    load = lambda path, name: spark.read.format("alignments").load(path).withColumn("sample", F.lit(name))
    rows = load(inputs.tumor, "tumor").unionByName(load(inputs.normal, "normal"))
    return rows.where(F.col("contig").isin(CONTIGS) & ~F.col("is_unmapped"))


def call(reads: DataFrame, contigs: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Reads -> (calls with local depths and allele fractions, coverage of each sample's genome)."""
    # alignment files are decoded once: every later branch reads only the columns that it needs
    reads = settle(reads, "reads")
    found = breakpoints.extract_breakpoints(reads, config)
    # a total order of the breakpoints at one place, whatever the partitions
    ord_ = F.xxhash64("sample", "read_name", "end_chr", "end_loc", "breakpoint_notation", "insert_length")
    rows = settle(found.withColumn("ord", ord_), "breakpoints")
    clustered = settle(clustering.start_clusters(rows, config), "clusters")
    calls = calling.call_breakpoints(clustered, config, reads).drop("group_end_chr")
    order = [F.col("__contig"), *map(F.col, ("start_chr", "cluster", "start_loc", "end_chr", "part", "breakpoint_notation"))]
    calls = calls.withColumn("__contig", breakpoints.contig_ordinal(F.col("start_chr")))
    calls = settle(ordered.numbered(calls, order, "count").drop("__contig"), "calls")
    used = breakpoints.phasing(reads)
    if config.platform == "HIFI":
        used = used.where(~F.col("is_secondary"))
    covered = coverage.coverage_by_deltas(used, config.coverage_bin)
    genome = contigs.agg(F.sum("length").alias("n")).first().n or 1
    return settle(depth.annotate_depth(calls, covered, contigs, config, key="count"), "annotated"), coverage.genome_coverage(used, genome)


def run(spark: SparkSession, inputs: Inputs, config: Config = DEFAULT) -> DataFrame:
    """Write the files of the analysis under inputs.output and return the final calls."""
    contigs = text.known_contigs(text.contig_index(spark, inputs.reference + ".fai"))
    chunks = settle(text.indexed_chunks(spark, inputs.reference, CONTIGS), "reference")
    calls, genome = call(read_samples(spark, inputs), contigs, config)
    based = text.bases_at(text.bases_at(calls, chunks, "start_chr", "start_loc", "start_base"), chunks, "end_chr", "end_loc", "end_base")
    based = settle(based, "based")
    lengths = [(r.contig, r.length) for r in contigs.collect()]
    head = lambda somatic_: variants.header(lengths, inputs.reference, inputs.sample, somatic_)
    lines = lambda rows: variants.variant_lines(variants.variant_records(rows))
    variants.write_variants(spark, lines(based), f"{inputs.output}/all_sv_breakpoints.vcf", head(False))
    variants.write_variants(spark, lines(based.limit(0)), f"{inputs.output}/all_sv_breakpoints_normal.vcf", head(False))

    covered = {r["sample"]: r["coverage"] for r in genome.collect()}
    tumor, normal = (covered.get(s, config.default_coverage) for s in ("tumor", "normal"))
    mean_af = somatic.mean_somatic_af(based).first().mean_af
    regions = text.read_regions(spark, inputs.regions) if inputs.regions else None
    judged = somatic.filter_somatic(based.withColumn("call_id", F.col("count")), tumor, normal, mean_af, regions, config)
    passed = settle(judged.where("passed"), "passed")
    statistics = somatic.reference_statistics(somatic.features(based, config.platform)).first().asDict()
    variants.write_statistics(spark, f"{inputs.output}/{inputs.sample}.global_stats.txt", {f"{s}_global_coverage": x for s, x in covered.items()}, mean_af)
    variants.write_filter_summary(spark, f"{inputs.output}/{inputs.sample}.filtering_stats_data.txt", statistics, variants.filter_summary(passed).first().asDict())
    variants.write_variants(spark, lines(passed), f"{inputs.output}/{inputs.sample}.only_long.somatic.vcf", head(True), skip_empty=True)

    final = passed
    if inputs.panel:
        final = panel.subtract(final, panel.common_variants(text.read_vcf(spark, inputs.panel), config), "count", config)
    if inputs.short_reads:
        final = settle(final, "before-germline")
        # only blocks with reads near calls are read, once for all tests
        short = bgzf.near_regions(spark, inputs.short_reads, germline.test_spans(final, "count", config))
        spans = text.spans(final.where("start_chr = end_chr"), chunks, "count", "start_chr", "start_loc", "end_loc")
        final = germline.filter_germline(final, short, spans, "count", inputs.short_coverage or config.default_coverage, config)
        if inputs.assemble:
            final = assembled(spark, settle(final, "before-assembly"), inputs, chunks)
    final = settle(final, "final")
    variants.write_variants(spark, lines(final), f"{inputs.output}/final_somatic_variants.vcf", head(True), skip_empty=True)
    return final


def assembled(spark: SparkSession, calls: DataFrame, inputs: Inputs, chunks: DataFrame, margin: int = 1000) -> DataFrame:
    """calls without those that contigs of the normal sample's reads explain; the contigs go to contigs.fastq, in parts."""
    load = lambda spans: bgzf.near_regions(spark, inputs.short_reads, spans)
    reads = assembly.assembly_reads(calls, load(assembly.read_spans(calls, "count")), "count", mates=load)
    contigs = settle(assembly.named(assembly.assemble(reads, ["count", "side"]), "count"), "contigs")
    assembly.fastq_lines(contigs).write.mode("overwrite").text(f"{inputs.output}/contigs.fastq")
    windows = assembly.call_windows(calls, "count", margin)
    surroundings = text.spans(windows.withColumn("window", F.struct("count", "contig", F.col("low").alias("offset"))), chunks, "window", "contig", "low", "high").select("window.*", "sequence")
    return assembly.drop_explained(calls, settle(assembly.contig_breakpoints(contigs, surroundings, "count"), "contig-breakpoints"))


def missing_files(a: argparse.Namespace) -> list[str]:
    """What the analysis needs and does not find; only places of the local file system are looked at."""
    alignments = [x for x in (a.tumor, a.normal, a.short_reads) if x]
    needed = [*alignments, a.reference, *[x for x in (a.regions, a.panel) if x]]
    indexes = [*[f"{x}.bai" for x in alignments], f"{a.reference}.fai"]
    absent = lambda x: "://" not in x and not os.path.exists(x)
    return [f"no such file: {x}" for x in needed if absent(x)] + [f"no index: {x}" for x in indexes if absent(x)]


def parse(args: list[str] | None = None) -> tuple[Inputs, Config]:
    p = argparse.ArgumentParser(prog="strandloom", description="Somatic structural variants from long reads of a tumor and its normal sample")
    p.add_argument("--tumor", required=True)
    p.add_argument("--normal", required=True)
    p.add_argument("--reference", required=True, help="FASTA with an index beside it (.fai)")
    p.add_argument("--output", required=True)
    p.add_argument("--sample", default="sample_name")
    p.add_argument("--platform", choices=["HIFI", "ONT"], default="HIFI", type=str.upper)
    p.add_argument("--mode", choices=["long-read-only", "hybrid"], help="hybrid needs --short-reads; by default their presence decides")
    p.add_argument("--refine", action="store_true", help="take end clusters apart by the similarity of alignments")
    p.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    p.add_argument("--regions", help="known regions, tab-separated")
    p.add_argument("--panel", help="VCF of common variants")
    p.add_argument("--short-reads", help="alignments of the normal sample's short reads")
    p.add_argument("--short-coverage", type=float)
    p.add_argument("--assemble", action="store_true", help="leave out calls that contigs of the short reads explain; needs --short-reads")
    for name in ("min_length", "min_mapq", "coverage_bin", "min_support", "start_extension", "insert_extension", "end_extension"):
        p.add_argument(f"--{name.replace('_', '-')}", type=int, default=getattr(DEFAULT, name))
    a = p.parse_args(args)
    if a.min_length < 1 or a.min_mapq < 0 or a.coverage_bin < 1 or a.min_support < 1:
        p.error("--min-length, --coverage-bin and --min-support must be at least 1, --min-mapq at least 0")
    if a.mode == "hybrid" and not a.short_reads:
        p.error("--mode hybrid needs --short-reads")
    if a.mode == "long-read-only":
        a.short_reads = None
    if a.assemble and not a.short_reads:
        p.error("--assemble needs --short-reads")
    for problem in missing_files(a):
        p.error(problem)
    fixed = {n: getattr(a, n) for n in ("min_length", "min_mapq", "coverage_bin", "min_support", "start_extension", "insert_extension", "end_extension", "platform", "refine")}
    return Inputs(a.tumor, a.normal, a.reference, a.output, a.regions, a.panel, a.short_reads, a.short_coverage, a.sample, a.assemble), replace(DEFAULT, **fixed)


def main(args: list[str] | None = None) -> None:
    inputs, config = parse(args)
    print(f"strandloom {__version__}: {'hybrid' if inputs.short_reads else 'long-read-only'} mode")
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    final = run(spark, inputs, config)
    print(f"{final.count()} somatic variants in {inputs.output}")
