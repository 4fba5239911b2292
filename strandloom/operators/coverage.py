"""Binned read coverage by sample and haplotype, and coverage of the whole genome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def haplotype_known() -> Column:
    """Coverage counts reads of haplotype 1, 2 or none; others are left out."""
    return F.col("haplotype").isNull() | F.col("haplotype").isin(1, 2)


def binned_coverage(reads: DataFrame, bin_size: int, contigs: DataFrame | None = None) -> DataFrame:
    """(sample, contig, haplotype, bin, depth): reads that touch each bin; bins without reads have no row.

    A read touches every bin from its start to its (exclusive) end, both included. contigs (contig, length)
    bounds the bins. The bins come from runs of equal depth, so only two rows a read are shuffled; a run without a
    read's start or end inside is no longer than a read.
    """
    runs = coverage_by_deltas(reads, bin_size)
    depth = run_bins(runs)
    if contigs is None:
        return depth
    bound = contigs.select("contig", F.floor(F.col("length") / bin_size).alias("__last"))
    return depth.join(bound, "contig").where(F.col("bin").between(F.lit(0), F.col("__last"))).drop("__last")


def coverage_by_deltas(reads: DataFrame, bin_size: int, chunk_bins: int = 100_000, partitions: int | None = None) -> DataFrame:
    """The same depths from +1 at a read's first bin and -1 after its last, as a running sum.

    For long reads, where a row for each touched bin would be many: two rows a read are shuffled, once. Returns runs
    (bin to next_bin, exclusive) of equal depth; partitions are the shuffle's, if the session's number is too small.
    """
    low, high = F.least("start", "end"), F.greatest("start", "end")
    first, after = F.floor(low / bin_size).cast("bigint"), (F.floor(high / bin_size) + 1).cast("bigint")
    return _runs(_steps(reads.where(haplotype_known()), first, after, F.lit(1).cast("bigint")), chunk_bins, partitions)


def _steps(rows: DataFrame, first: Column, after: Column, depth: Column) -> DataFrame:
    """Depth that begins at a bin and ends before another, as a rise and a fall."""
    return rows.select("sample", "contig", "haplotype", F.explode(F.array(F.struct(first.alias("bin"), depth.alias("d")), F.struct(after.alias("bin"), (-depth).alias("d")))).alias("s")).select("sample", "contig", "haplotype", "s.bin", "s.d")


def _runs(steps: DataFrame, chunk_bins: int, partitions: int | None = None) -> DataFrame:
    """Steps of depth -> runs of equal depth: a running sum in each chunk of bins, to which a row a chunk carries the sum so far."""
    by = ["sample", "contig", "__hp"]
    # of the known haplotypes none is 0: keys without nulls let the join take the shuffle of the sums
    steps = steps.withColumn("__hp", F.coalesce("haplotype", F.lit(0))).withColumn("chunk", F.floor(F.col("bin") / chunk_bins)).drop("haplotype")
    sums = steps.groupBy(*by, "chunk").agg(F.sum("d").alias("total"), F.min("bin").alias("first_bin"))
    earlier = Window.partitionBy(*by).orderBy("chunk")
    sums = sums.withColumns({"carried": F.coalesce(F.sum("total").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "next_first": F.lead("first_bin").over(earlier)}).drop("total", "first_bin")
    inside = Window.partitionBy(*by, "chunk").orderBy("bin")
    dealt = steps if partitions is None else steps.repartition(partitions, *by, "chunk")
    # of steps at one bin the last has the sum of all, and only its run has a length
    run = dealt.withColumns({"run": F.sum("d").over(inside), "within_next": F.lead("bin").over(inside)})
    joined = run.where("within_next is null or within_next > bin").join(sums, [*by, "chunk"])
    out = joined.select("sample", "contig", F.nullif("__hp", F.lit(0)).alias("haplotype"), "bin", F.coalesce("within_next", "next_first").alias("next_bin"), (F.col("run") + F.col("carried")).alias("depth"))
    return out.where("depth > 0 and next_bin > bin")


def merge_runs(*parts: DataFrame, chunk_bins: int = 100_000, partitions: int | None = None) -> DataFrame:
    """Sum of partial coverages given as runs, as runs: two rows a run are shuffled, not one for each bin."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return _runs(_steps(out, F.col("bin"), F.col("next_bin"), F.col("depth")), chunk_bins, partitions)


def run_bins(runs: DataFrame) -> DataFrame:
    """(sample, contig, haplotype, bin, depth): a row for each bin of runs."""
    return runs.select("sample", "contig", "haplotype", F.explode(F.sequence("bin", F.col("next_bin") - 1)).alias("bin"), "depth")


def merge_coverage(*parts: DataFrame) -> DataFrame:
    """Sum of partial coverages of the same bins."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("sample", "contig", "haplotype", "bin").agg(F.sum("depth").alias("depth"))


def dense_coverage(coverage: DataFrame, contigs: DataFrame, bin_size: int) -> DataFrame:
    """All bins of the contigs that coverage names, with 0 where no read is."""
    tracks = coverage.select("sample", "contig", "haplotype").distinct().join(contigs.select("contig", "length"), "contig")
    every = tracks.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("length") / bin_size).cast("bigint")))).drop("length")
    depth = coverage.withColumn("__hp", F.coalesce("haplotype", F.lit(0))).drop("haplotype")
    return every.withColumn("__hp", F.coalesce("haplotype", F.lit(0))).join(depth, ["sample", "contig", "__hp", "bin"], "left").withColumn("depth", F.coalesce("depth", F.lit(0))).drop("__hp")


def genome_coverage(reads: DataFrame, genome_length: Column | int) -> DataFrame:
    """(sample, read_length, coverage): summed query lengths over the genome's length."""
    length = F.lit(genome_length) if isinstance(genome_length, int) else genome_length
    out = reads.groupBy("sample").agg(F.sum("query_length").cast("bigint").alias("read_length"))
    return out.withColumn("coverage", F.col("read_length") / length)
