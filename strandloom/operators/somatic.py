"""Somatic filters: ordered rejections with reasons, features, confidence, global statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.config import DEFAULT, Config
from strandloom.functions.columns import INSERTION, first_reason
from strandloom.operators.ordered import interval_join
from strandloom.operators.quantiles import quantiles

c = F.col


def features(calls: DataFrame, platform: str = "HIFI") -> DataFrame:
    """Annotated calls with the values that filters and confidence use."""
    out = calls.withColumns(
        {
            "tumor_af": F.greatest("af_tumor_start", "af_tumor_end"),
            "normal_af": F.greatest("af_normal_start", "af_normal_end"),
            "support_ratio": c("tumor_reads") / (c("normal_reads") + 1),
            "min_mapq": F.least("origin_mapq_mean", "end_mapq_mean"),
            "mapq_diff": F.abs(c("origin_mapq_mean") - c("end_mapq_mean")),
            "tumor_coverage": F.least("dp_tumor_at_start", "dp_tumor_at_end"),
            "normal_coverage": F.least("dp_normal_at_start", "dp_normal_at_end"),
        }
    )
    expected = F.greatest(F.lit(2.0), c("tumor_coverage") * 0.06)
    spread = F.greatest(c("origin_starts_std_dev"), c("end_starts_std_dev")) / (c("end_event_size_mean") + 1)
    return out.withColumns(
        {
            "support_density": c("tumor_reads") / (c("tumor_coverage") + 1),
            "support_ratio_expected": c("tumor_reads") / expected,
            "af_support_consistency": c("tumor_af") * c("tumor_coverage") / (c("tumor_reads") + 1),
            "normal_noise_ratio": c("clustered_normal") / (c("clustered_tumor") + 1),
            "std_dev_ratio": spread if platform == "ONT" else F.lit(None).cast("double"),
        }
    )


def confidence_factors() -> dict[str, Column]:
    return {
        "af_confidence": F.least(F.lit(1.0), c("tumor_af") / 0.05),
        "support_confidence": F.least(F.lit(1.0), c("support_ratio_expected")),
        "quality_confidence": F.least(F.lit(1.0), c("min_mapq") / 60.0),
        "noise_confidence": F.lit(1.0) / (F.lit(1.0) + c("normal_noise_ratio") * 10),
        "normal_af_confidence": F.greatest(F.lit(0.1), F.lit(1.0) - F.greatest(F.lit(0.0), c("normal_af") - 0.01) * 20),
    }


def confidence(featured: DataFrame) -> DataFrame:
    """The five factors and their sum over six."""
    out = featured.withColumns(confidence_factors())
    return out.withColumn("confidence_score", sum((c(x) for x in list(confidence_factors())[1:]), c("af_confidence")) / 6.0)


def too_short(least: int) -> Column:
    return F.abs("sv_length").between(1, least - 1)


def _least_support() -> Column:
    return F.when(c("tumor_coverage") > 0, F.ceil(c("tumor_coverage") * 0.1) + 1).otherwise(F.lit(3))


def _spread() -> Column:
    size = c("end_event_size_mean") + 1
    return (c("origin_starts_std_dev") / size > 10) | (c("end_starts_std_dev") / size > 40)


def _noisy() -> Column:
    return (c("clustered_normal") > 1) & (c("clustered_normal") / (c("clustered_tumor") + F.lit(1e-8)) > 0.1)


def strict_high(tumor_coverage: Column, normal_coverage: Column) -> Column:
    """Reason of rejection in the strict mode for clear samples; coverages are those of the whole genome."""
    ratio = F.try_divide(c("normal_coverage").cast("double"), normal_coverage)
    most_normal = F.when(c("normal_coverage") > 0, F.floor(c("normal_coverage") * 0.1)).otherwise(F.lit(1))
    return first_reason(
        (F.coalesce((ratio < 0.3) | (ratio > 3.0), F.lit(True)), "abnormal_coverage_ratio"),
        (c("normal_coverage") < 2, "low_normal_coverage"),
        (c("normal_af") > 0.05, "high_normal_af"),
        (c("tumor_af") < 0.05, "low_tumor_af"),
        (c("min_mapq") < 55.0, "low_mapq"),
        (c("mapq_diff") > 5, "mapq_diff_too_large"),
        (c("normal_reads") > most_normal, "high_normal_support"),
        (c("tumor_reads") < _least_support(), "low_tumor_support"),
        (_spread(), "high_std_dev"),
        (_noisy(), "high_clustered_normal_ratio"),
        (c("support_ratio") < tumor_coverage * 0.15, "low_support_ratio"),
        ((c("breakpoint_notation") == INSERTION) & (c("origin_starts_std_dev") > 30), "insertion_high_std_dev"),
    )


def strict_low() -> Column:
    """Reason of rejection in the strict mode for samples of low purity."""
    return first_reason(
        (c("tumor_af") < 0.05, "low_tumor_af"),
        (c("normal_af") > 0.05, "high_normal_af"),
        (c("min_mapq") < 55.0, "low_mapq"),
        (c("normal_coverage") < 2, "low_normal_coverage"),
        (c("mapq_diff") > 5, "mapq_diff_too_large"),
        (_spread(), "high_std_dev"),
        (_noisy(), "high_clustered_normal_ratio"),
    )


def bed_lenient() -> Column:
    """Reason of rejection in known regions; strong tumor evidence rescues a call from each test."""
    least, af, reads, normal = _least_support(), c("tumor_af"), c("tumor_reads"), c("normal_reads")
    strong, clean = reads >= least * 3, normal == 0
    return first_reason(
        ((c("normal_af") > 0.05) & ~((c("normal_af") <= 0.07) & (af >= 0.2) & strong & (c("support_ratio") >= 10)), "bed_high_normal_af"),
        ((af < 0.1) & ~((af >= 0.08) & strong & clean), "bed_low_tumor_af"),
        ((c("min_mapq") < 40.0) & ~((c("min_mapq") >= 35.0) & strong & (af >= 0.2) & clean), "bed_low_mapq"),
        ((normal > 0) & ~((normal <= 1) & strong & (af >= 0.2) & (c("support_ratio") >= least)), "bed_high_normal_support"),
        ((reads < least) & ~((reads >= least * 0.8) & (af >= 0.3) & clean), "bed_low_tumor_support"),
        ((c("clustered_normal") > 3) & ~((c("clustered_normal") <= 4) & strong & (af >= 0.3) & clean), "bed_high_clustered_normal"),
    )


def legacy(coverage: float) -> Column:
    """The older filter: whether a call passes."""
    return ~(
        too_short(50)
        | (c("normal_af") > 0.1)
        | (c("tumor_af") < 0.1)
        | (c("min_mapq") < 40.0)
        | (c("normal_reads") > 1)
        | (c("tumor_reads") < F.ceil(F.lit(coverage * 0.1)) + 1)
        | (c("clustered_normal") > 1)
    )


def mean_somatic_af(calls: DataFrame) -> DataFrame:
    """(mean_af): mean tumor allele fraction of calls that look somatic; 0 if there are none."""
    tumor = (c("af_tumor_start") + c("af_tumor_end")) / 2
    normal = (c("af_normal_start") + c("af_normal_end")) / 2
    return calls.agg(F.coalesce(F.avg(F.when((tumor >= 0.1) & (normal <= 0.01), tumor)), F.lit(0.0)).alias("mean_af"))


def af_distribution(calls: DataFrame) -> DataFrame:
    """(tumor_mean_af, normal_mean_af): mean of the larger fraction where it is from 0.1 to 0.6."""
    top = {s: F.greatest(f"af_{s}_start", f"af_{s}_end") for s in ("tumor", "normal")}
    return calls.agg(*[F.avg(F.when(x.between(0.1, 0.6), x)).alias(f"{s}_mean_af") for s, x in top.items()])


def reference_statistics(featured: DataFrame) -> DataFrame:
    """Percentiles of allele fractions, medians of support and mapping quality, number of calls."""
    shares = {"af_p10": 0.1, "af_p25": 0.25, "af_p50": 0.5, "af_p75": 0.75, "af_p90": 0.9}
    # fractions and qualities have three decimals
    measures = [(c("tumor_af"), 0.1, shares), (c("tumor_reads"), 64, {"support_median": 0.5}), (c("min_mapq"), 1, {"mapq_median": 0.5})]
    found = quantiles(featured, [], measures).unionByName(featured.agg(F.count("*").cast("double").alias("value")).withColumn("name", F.lit("total_variants")))
    value = lambda n: F.coalesce(F.max(F.when(c("name") == n, c("value"))), F.lit(0.0))
    return found.agg(*[value(n).alias(n) for n in (*shares, "support_median", "mapq_median")], value("total_variants").cast("bigint").alias("total_variants"))


def depth_threshold(calls: DataFrame) -> DataFrame:
    """A tenth of the mean of the lower tumor depth."""
    return calls.agg((F.avg(F.least("dp_tumor_at_start", "dp_tumor_at_end")) * 0.1).alias("depth_threshold"))


def strict_by_statistics(statistics: DataFrame, tumor_coverage: float) -> DataFrame:
    """The older choice of the strict mode: much coverage, many calls, good mapping."""
    return statistics.withColumn("strict", F.lit(tumor_coverage > 30) & (c("total_variants") > 100) & (c("mapq_median") > 50))


def lookup_regions(calls: DataFrame, regions: DataFrame, key: str = "call_id", width: int = 1000) -> DataFrame:
    """calls with region_start, region_end and in_region of a region that holds the start (the first by start and end).

    Regions are closed: a region that begins at start and ends at end is met by positions from start to end + 1.
    """
    points = calls.select(c(key).alias("__key"), c("start_chr").alias("__chr"), c("start_loc").alias("__loc"))
    held = regions.select("contig", c("start").alias("region_start"), c("end").alias("region_end"))
    met = interval_join(points, held, [("__chr", "contig")], c("__loc"), c("region_start"), c("region_end") + 1, width)
    one = met.groupBy("__key").agg(F.min(F.struct("region_start", "region_end")).alias("r")).select("__key", "r.*")
    return calls.join(one, c(key) == c("__key"), "left").drop("__key").withColumn("in_region", c("region_start").isNotNull())


def filter_somatic(calls: DataFrame, tumor_coverage: float, normal_coverage: float, mean_af: float, regions: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """Annotated calls with features, reason, confidence and passed.

    reason is that of the rejection, or passed_<mode>; a call must also reach config.min_confidence.
    """
    rows = confidence(features(calls, config.platform))
    rows = lookup_regions(rows, regions) if regions is not None else rows.withColumn("in_region", F.lit(False))
    strict = mean_af > config.strict_mean_af
    why = strict_high(F.lit(tumor_coverage), F.lit(normal_coverage)) if strict else strict_low()
    passed = F.when(c("in_region"), F.lit("passed_bed_lenient")).otherwise(F.lit("passed_strict_high" if strict else "passed_strict_low"))
    rejected = F.when(too_short(config.min_length), F.lit("failed_basic_prefilter")).when(c("in_region"), bed_lenient()).otherwise(why)
    out = rows.withColumn("__rejected", rejected).withColumn("reason", F.coalesce("__rejected", passed))
    return out.withColumn("passed", c("__rejected").isNull() & (c("confidence_score") >= config.min_confidence)).drop("__rejected")
