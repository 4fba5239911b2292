"""Subtraction of known germline variants: a range anti-join on both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.config import DEFAULT, Config


def common_variants(records: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """VCF records (chrom, pos, info map) -> (chr1, start, chr2, end, svtype, af) of common variants.

    The frequency is the first of AF, else CN_NONREF_FREQ for copy-number variants.
    """
    info = lambda k: F.try_element_at("info", F.lit(k))
    first = F.split(info("AF"), ",")[0].try_cast("double")
    af = F.when(info("AF").isNotNull(), first).when(info("SVTYPE") == "CNV", F.split(info("CN_NONREF_FREQ"), ",")[0].try_cast("double"))
    out = records.select(F.col("chrom").alias("chr1"), F.col("pos").alias("start"), F.coalesce(info("CHR2"), F.col("chrom")).alias("chr2"), F.coalesce(info("END").try_cast("bigint"), F.col("pos")).alias("end"), info("SVTYPE").alias("svtype"), af.alias("af"))
    return out.where(F.col("af") >= config.pon_min_af)


def common_copy_numbers(records: DataFrame) -> DataFrame:
    """Copy-number records with their widest bounds (POSMIN, ENDMAX), of any frequency."""
    info = lambda k: F.try_element_at("info", F.lit(k))
    return records.select(F.col("chrom").alias("chr1"), info("POSMIN").try_cast("bigint").alias("start"), F.col("chrom").alias("chr2"), info("ENDMAX").try_cast("bigint").alias("end"), info("SVTYPE").alias("svtype"))


def subtract(calls: DataFrame, known: DataFrame, key: str, config: Config = DEFAULT) -> DataFrame:
    """calls without those that a known variant matches at both ends, forward or reciprocally.

    Candidates share the call's start contig as chr1 and lie within the tolerance of it at one end: the call's
    start meets known starts (forward) or known ends (reciprocal) in bins of the tolerance, three for each call.
    """
    t = config.pon_tolerance
    a = calls.select(F.col(key).alias("k"), F.col("start_chr").alias("sc"), F.col("start_loc").alias("sl"), F.col("end_chr").alias("ec"), F.col("end_loc").alias("el"))
    a = a.withColumn("bin", F.explode(F.array(*[F.floor(F.col("sl") / t) + d for d in (-1, 0, 1)])))
    distinct = known.select("chr1", "start", "chr2", "end").distinct()
    forward = distinct.select("chr1", F.floor(F.col("start") / t).alias("bin"), F.col("start").alias("p1"), F.col("chr2").alias("c2"), F.col("end").alias("p2"))
    back = distinct.where("chr1 = chr2").select("chr1", F.floor(F.col("end") / t).alias("bin"), F.col("end").alias("p1"), F.col("chr1").alias("c2"), F.col("start").alias("p2"))
    b = forward.unionByName(back).distinct()
    near = (a["sc"] == b["chr1"]) & (a["bin"] == b["bin"]) & (a["ec"] == b["c2"]) & (F.abs(a["sl"] - b["p1"]) <= t) & (F.abs(a["el"] - b["p2"]) <= t)
    matched = a.join(b, near, "left_semi").select("k").distinct()
    return calls.join(matched, calls[key] == matched["k"], "left_anti")
