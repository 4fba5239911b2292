"""Germline evidence from the normal sample's short reads: depth, k-mers, pairs, clips, split reads.

Every test is an aggregate over (call, read) rows, which one interval join finds: each call has a window at each
place that its test looks at, as wide as the widest part of the test, and the parts are conditions on these rows.
Calls that a test finds germline are removed by an anti-join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import DEFAULT, Config
from strandloom.functions import cigar, kmers
from strandloom.functions.columns import INSERTION, points
from strandloom.functions.tests import p_value
from strandloom.operators.ordered import overlap_join
from strandloom.operators.stages import settle

c = F.col


# --- the reads of each call --------------------------------------------------------------------------------

#: Columns of reads that the tests look at.
READ_COLUMNS = [
    "contig", "start", "end", "mapq", "cigar", "seq", "qual", "sa", "mate_contig", "mate_start", "template_length", "is_paired", "is_unmapped",
    "mate_unmapped", "is_secondary", "is_supplementary", "is_duplicate", "is_qcfail", "is_reverse", "mate_reverse",
]


def windows(calls: DataFrame, key: str, route: Column, config: Config = DEFAULT) -> DataFrame:
    """(call_key, route, place, the call's ends, window_contig, window_low, window_high) of each place that the test of a call looks at.

    route: deletion, duplication, inversion, translocation or insertion. Windows are half-open and 0-based.
    """
    rows = calls.select(c(key).alias("call_key"), route.alias("route"), c("start_chr").alias("c1"), c("start_loc").cast("bigint").alias("p1"), c("end_chr").alias("c2"), c("end_loc").cast("bigint").alias("p2"))
    rows = rows.withColumns({"low": F.least("p1", "p2"), "high": F.greatest("p1", "p2")})
    at = lambda place, contig, low, high: F.struct(F.lit(place).alias("place"), contig.alias("window_contig"), F.greatest(F.lit(0), low).cast("bigint").alias("window_low"), high.cast("bigint").alias("window_high"))
    depth, far = max(config.flank, config.read_margin), config.translocation_window
    places = (
        F.when(c("route").isin("deletion", "duplication"), F.array(at("span", c("c1"), c("low") - depth - 1, c("high") + depth + 1)))
        .when(c("route") == "inversion", F.array(at("span", c("c1"), c("low") - 1000, c("high") + 1000)))
        .when(c("route") == "translocation", F.array(at("first", c("c1"), c("p1") - far, c("p1") + far), at("second", c("c2"), c("p2") - far, c("p2") + far)))
        .when(c("route") == "insertion", F.array(at("first", c("c1"), c("p1") - config.insert_window, c("p1") + config.insert_window)))
    )
    return rows.withColumn("w", F.explode(places)).select("*", "w.*").drop("w")


def meet(windows_: DataFrame, reads: DataFrame, width: int = 2000) -> DataFrame:
    """A row for each window and read that overlap: the window's columns and the read's."""
    return overlap_join(reads, windows_, [("contig", "window_contig")], (c("start"), c("end") - 1), (c("window_low"), c("window_high") - 1), width)


def within(low: Column, high: Column) -> Column:
    """Whether a read overlaps the half-open [low, high)."""
    return (c("start") < high) & (c("end") > F.greatest(F.lit(0), low))


# --- depth -----------------------------------------------------------------------------------------------


def bin_layout(calls: DataFrame, key: str, config: Config = DEFAULT) -> DataFrame:
    """(key, bin, bin_start, bin_end, mid, region): bins over a call and its flanks.

    Positions are 1-based and bins half-open; region is up, target or down by the bin's middle.
    """
    low, high = F.least("start_loc", "end_loc"), F.greatest("start_loc", "end_loc")
    rows = calls.select(key, c("start_chr").alias("contig"), low.alias("low"), high.alias("high"))
    rows = rows.withColumns({"from": F.greatest(F.lit(1), c("low") - config.flank), "to": c("high") + config.flank + 1})
    n = F.ceil((c("to") - c("from")) / config.bin).cast("int")
    rows = rows.withColumn("bin", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.withColumn("bin_start", c("from") + c("bin") * config.bin).withColumn("bin_end", F.least(c("bin_start") + config.bin, c("to")))
    rows = rows.withColumn("mid", c("bin_start") + F.floor((c("bin_end") - c("bin_start")) / 2))
    region = F.when(c("mid").between(c("low"), c("high")), "target").when(c("mid") < c("low"), "up").otherwise("down")
    return rows.select(key, "contig", "bin", "bin_start", "bin_end", "mid", region.alias("region"))


def _letter_table(letters: str) -> np.ndarray:
    out = np.zeros(256, np.bool_)
    out[np.frombuffer(letters.encode(), np.uint8)] = True
    return out


def _runs(batches: Iterator[pa.RecordBatch], least_quality: int, carried: list[str]) -> Iterator[pa.RecordBatch]:
    known = _letter_table("ACGT")
    steps = re.compile(cigar.PATTERN)
    for batch in batches:
        rows, lows, highs = [], [], []
        columns = [batch.column(x).to_pylist() for x in ("start", "cigar", "seq", "qual")]
        for row, (start, text, seq, qual) in enumerate(zip(*columns, strict=True)):
            if start is None or not text or not seq:
                continue
            good = known[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
            if qual is not None:
                far = np.frombuffer(qual.encode("latin-1", "replace"), np.uint8)[: len(good)].astype(int) - 33 >= least_quality
                good = np.concatenate([good[: len(far)] & far, np.zeros(len(good) - len(far), np.bool_)])
            ref, query = start, 0
            for n, op in steps.findall(text):
                n = int(n)
                if op in cigar.MATCH:
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], good[query : query + n], [False]])))
                    lows.append(ref + 1 + edges[::2])
                    highs.append(ref + edges[1::2])
                    rows.append(np.full(len(edges) // 2, row))
                ref += n if op in (*cigar.ON_REFERENCE, "N") else 0
                query += n if op in cigar.ON_QUERY else 0
        if rows:
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([*[batch.column(x).take(at) for x in carried], pa.array(np.concatenate(lows).astype(np.int64)), pa.array(np.concatenate(highs).astype(np.int64))], [*carried, "run_low", "run_high"])


def aligned_runs(reads: DataFrame, carried: list[str], least_quality: int = 15) -> DataFrame:
    """(carried columns, run_low, run_high): closed, 1-based stretches of known bases of enough quality in aligned blocks of usable reads."""
    used = reads.where("not (is_unmapped or is_secondary or is_duplicate or is_qcfail)").select(*carried, "start", "cigar", "seq", "qual")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.select(*carried).schema)
    return used.mapInArrow(lambda batches: _runs(batches, least_quality, carried), f"{kinds}, run_low bigint, run_high bigint")


def depth_of(layout: DataFrame, met: DataFrame, key: str, config: Config = DEFAULT) -> DataFrame:
    """bin_layout with cov, the mean base depth of the bin, from rows of calls and reads.

    Reads become stretches of good bases, and a bin adds up what it shares with each: no row for a base.
    """
    begin, end = F.greatest(F.lit(1), c("low") - config.flank), c("high") + config.flank + 1
    placed = met.select("*", begin.alias("depth_from"), end.alias("depth_to"))
    runs = aligned_runs(placed, ["call_key", "depth_from", "depth_to"]).groupBy("call_key", "depth_from", "depth_to", "run_low", "run_high").agg(F.count("*").alias("n"))
    runs = runs.withColumns({"run_low": F.greatest("run_low", "depth_from"), "run_high": F.least(c("run_high"), c("depth_to") - 1)}).where("run_low <= run_high")
    place = lambda x: F.floor((c(x) - c("depth_from")) / config.bin).cast("int")
    binned = runs.withColumn("bin", F.explode(F.sequence(place("run_low"), place("run_high"))))
    bin_start = c("depth_from") + c("bin") * config.bin
    shared = F.least(c("run_high"), bin_start + config.bin - 1) - F.greatest(c("run_low"), bin_start) + 1
    sums = binned.groupBy(c("call_key").alias(key), "bin").agg(F.sum(shared * c("n")).alias("total"))
    out = layout.join(sums, [key, "bin"], "left")
    return out.withColumn("cov", F.coalesce("total", F.lit(0)) / (c("bin_end") - c("bin_start"))).drop("total")


def binned_depth(calls: DataFrame, reads: DataFrame, key: str, config: Config = DEFAULT) -> DataFrame:
    """bin_layout with cov, the mean base depth of the bin. Only reads near a call are taken apart."""
    return depth_of(bin_layout(calls, key, config), meet(windows(calls, key, F.lit("deletion"), config), reads), key, config)


def depth_statistics(bins: DataFrame, key: str, global_coverage: Column | float) -> DataFrame:
    """One row a call from (key, bin, region, cov): means, spreads, ratios, t statistics, z-score, variation.

    The whole flank counts as the genome's coverage if it has no bins; a call without target bins has one of 0.
    """
    g = F.lit(global_coverage) if not isinstance(global_coverage, Column) else global_coverage
    target, flank = F.when(c("region") == "target", c("cov")), F.when(c("region") != "target", c("cov"))
    out = bins.groupBy(key).agg(
        F.count(target).alias("n_target"),
        F.coalesce(F.avg(target), F.lit(0.0)).alias("target_mean"),
        F.coalesce(F.median(target), F.lit(0.0)).alias("target_median"),
        F.coalesce(F.stddev_pop(target), F.lit(0.0)).alias("target_std"),
        F.var_samp(target).alias("target_var"),
        F.count(flank).alias("n_flank"),
        F.avg(flank).alias("__flank"),
        F.coalesce(F.stddev_pop(flank), F.lit(0.0)).alias("flank_std"),
        F.var_samp(flank).alias("flank_var"),
        F.avg("cov").alias("all_mean"),
        F.stddev_pop("cov").alias("all_std"),
    )
    out = out.withColumns({"global_cov": g.cast("double"), "flank_mean": F.coalesce("__flank", g.cast("double"))}).drop("__flank")
    ratio = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(0.0))
    t_global = F.when(c("n_target") > 1, F.try_divide(c("target_mean") - c("global_cov"), F.sqrt(c("target_var") / c("n_target")))).otherwise(F.lit(0.0))
    freedom = c("n_target") + c("n_flank") - 2
    pooled = ((c("n_target") - 1) * c("target_var") + (c("n_flank") - 1) * c("flank_var")) / freedom
    both = (c("n_target") > 1) & (c("n_flank") > 1)
    t_flank = F.when(both, F.try_divide(c("target_mean") - c("flank_mean"), F.sqrt(pooled * (F.lit(1.0) / c("n_target") + F.lit(1.0) / c("n_flank"))))).otherwise(F.lit(0.0))
    return out.withColumns(
        {
            "global_ratio": ratio("target_mean", "global_cov"),
            "flank_ratio": ratio("target_mean", "flank_mean"),
            "cv_target": ratio("target_std", "target_mean"),
            "cv_flank": ratio("flank_std", "flank_mean"),
            "t_global": t_global,
            "t_flank": t_flank,
            "df_global": F.when(c("n_target") > 1, c("n_target") - 1),
            "df_flank": F.when(both, freedom),
            "mean_z": F.when(c("n_target") > 0, F.try_divide(c("target_mean") - c("all_mean"), c("all_std"))).otherwise(F.lit(0.0)),
        }
    )


def with_p_values(statistics: DataFrame) -> DataFrame:
    """p_global and p_flank; 1 where the test is not made."""
    p = lambda t, df: F.when(c(df).isNull(), F.lit(1.0)).otherwise(p_value(c(t), c(df)))
    return statistics.withColumns({"p_global": p("t_global", "df_global"), "p_flank": p("t_flank", "df_flank")})


def z_scores(bins: DataFrame, key: str) -> DataFrame:
    """bins with their population z-score among the bins of their call."""
    mine = Window.partitionBy(key)
    return bins.withColumn("z", F.try_divide(c("cov") - F.avg("cov").over(mine), F.stddev_pop("cov").over(mine)))


def gradients(bins: DataFrame, key: str, window: int = 5) -> DataFrame:
    """(key, pre_cov, target_cov, post_cov, and for each event type its ratios and pattern)."""
    first = bins.where("region = 'target'").groupBy(key).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.count("*").alias("n"), F.avg("cov").alias("target_cov"))
    rows = bins.join(first, key)
    near = lambda a, b: F.avg(F.when(c("bin").between(a, b), c("cov")))
    out = rows.groupBy(key, "n", "target_cov").agg(near(c("lo") - window, c("lo") - 1).alias("pre"), near(c("hi") + 1, c("hi") + window).alias("post"))
    out = out.withColumns({"pre_cov": F.coalesce("pre", "target_cov"), "post_cov": F.coalesce("post", "target_cov")}).drop("pre", "post")
    over = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(1.0))
    out = out.withColumns({"drop_ratio": over("target_cov", "pre_cov"), "recovery_ratio": over("post_cov", "target_cov"), "rise_pre": over("target_cov", "pre_cov"), "rise_post": over("target_cov", "post_cov")})
    few, smooth = c("n") < 3, lambda a, b: c(a).between(0.8, 1.2) & c(b).between(0.8, 1.2)
    deletion = F.when(few, "insufficient_data").when((c("drop_ratio") < 0.7) & (c("recovery_ratio") > 1.3), "sharp_drop_recovery").when((c("drop_ratio") < 0.8) & (c("recovery_ratio") > 1.2), "moderate_drop_recovery")
    duplication = F.when(few, "insufficient_data").when((c("rise_pre") > 1.3) & (c("rise_post") > 1.3), "sharp_elevation_pattern").when((c("rise_pre") > 1.2) & (c("rise_post") > 1.2), "moderate_elevation_pattern")
    deletion = deletion.when(smooth("drop_ratio", "recovery_ratio"), "smooth_transition").otherwise("irregular")
    duplication = duplication.when(smooth("rise_pre", "rise_post"), "smooth_transition").otherwise("irregular")
    return out.withColumns({"gradient_del": deletion, "gradient_dup": duplication}).drop("n")


def minimum_window(bins: DataFrame, key: str, window: int = 5) -> DataFrame:
    """(key, first_mid, last_mid, window_mean): the lowest mean of so many neighbouring target bins, the first of equals."""
    order = Window.partitionBy(key).orderBy("bin")
    frame = order.rowsBetween(0, window - 1)
    rows = bins.where("region = 'target'").withColumns({"window_mean": F.avg("cov").over(frame), "last_mid": F.last("mid").over(frame), "n": F.count("*").over(frame)})
    best = rows.where(c("n") == window).groupBy(key).agg(F.min_by(F.struct(c("mid").alias("first_mid"), "last_mid", "window_mean"), F.struct("window_mean", "bin")).alias("w"))
    return best.select(key, "w.*")


def _score(strong: list[Column], medium: list[Column], weak: list[Column], counter: list[Column]) -> tuple[Column, Column]:
    add = lambda tests: sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))
    return add(strong) * 3 + add(medium) * 2 + add(weak) - add(counter) * 2, add(strong)


def _verdict(rows: DataFrame, score: Column, strong: Column, name: str) -> DataFrame:
    level = F.when((score >= 6) & (strong >= 1), "high").when((score >= 4) & (strong >= 1), "medium").when(score >= 2, "low").otherwise("not_supported")
    return rows.withColumns({f"{name}_score": score, f"{name}_level": level, f"is_{name}": score >= 2})


def score_deletion(rows: DataFrame, threshold: float = 0.5, flank_threshold: float = 0.7) -> DataFrame:
    """Depth statistics with gradients and p-values -> deletion_score, deletion_level, is_deletion."""
    flank, target = c("flank_mean") / c("global_cov"), c("target_mean") / c("global_cov")
    score, strong = _score(
        [c("global_ratio") < threshold, (c("p_global") < 0.01) & (c("target_mean") < c("global_cov")) & (c("global_ratio") < 0.8), c("gradient_del") == "sharp_drop_recovery"],
        [(c("flank_ratio") < flank_threshold) & (c("p_flank") < 0.05) & ~(flank > 1.5), c("mean_z") < -2, c("gradient_del") == "moderate_drop_recovery"],
        [(c("global_ratio") > threshold) & (c("global_ratio") < 0.8)],
        [flank > 2.0, target.between(0.8, 1.2), c("gradient_del") == "smooth_transition"],
    )
    return _verdict(rows, score, strong, "deletion")


def score_duplication(rows: DataFrame, threshold: float = 1.5, flank_threshold: float = 1.3) -> DataFrame:
    """The mirror of score_deletion for duplications."""
    flank, target = c("flank_mean") / c("global_cov"), c("target_mean") / c("global_cov")
    score, strong = _score(
        [c("global_ratio") > threshold, (c("p_global") < 0.01) & (c("target_mean") > c("global_cov")) & (c("global_ratio") > 1.2), c("gradient_dup") == "sharp_elevation_pattern"],
        [(c("flank_ratio") > flank_threshold) & (c("p_flank") < 0.05) & ~(flank < 0.5), c("mean_z") > 2, c("gradient_dup") == "moderate_elevation_pattern"],
        [(c("global_ratio") > 1.2) & (c("global_ratio") < threshold)],
        [flank < 0.5, target.between(0.8, 1.2), c("gradient_dup") == "smooth_transition"],
    )
    return _verdict(rows, score, strong, "duplication")


def anomalies(rows: DataFrame) -> DataFrame:
    """Tags of unusual depth for deletions (anomalies_del) and duplications (anomalies_dup), comma-separated."""
    flank, target = c("flank_mean") / c("global_cov"), c("target_mean") / c("global_cov")
    normal = F.when(target.between(0.8, 1.2), "normal_target_coverage")
    high = F.when(flank > 2.0, "high_flanking_coverage:high").when(flank > 1.5, "high_flanking_coverage:medium")
    raised = F.when(target > 1.2, "high_target_coverage")
    dup = F.when(target > 2.0, "very_high_target_coverage").when(target > 1.5, "high_target_coverage").otherwise(normal)
    low = F.when(flank < 0.5, "low_flanking_coverage")
    return rows.withColumns({"anomalies_del": F.concat_ws(",", high, F.coalesce(raised, normal)), "anomalies_dup": F.concat_ws(",", dup, low)})


def depth_evidence(calls: DataFrame, reads: DataFrame, key: str, global_coverage: float, config: Config = DEFAULT) -> DataFrame:
    """Deletion and duplication scores of calls from the depth of reads."""
    return depth_scores(binned_depth(calls, reads, key, config), key, global_coverage)


def depth_scores(bins: DataFrame, key: str, global_coverage: float) -> DataFrame:
    """Deletion and duplication scores of calls from the depths of their bins."""
    rows = with_p_values(depth_statistics(bins, key, global_coverage)).join(gradients(bins, key).select(key, "gradient_del", "gradient_dup"), key, "left")
    return score_duplication(score_deletion(rows.fillna("insufficient_data", ["gradient_del", "gradient_dup"])))


# --- k-mers ----------------------------------------------------------------------------------------------


def informative(reads: DataFrame) -> Column:
    """Reads with a clip of 10, an indel of 5, or poor mapping."""
    ops = cigar.operations(c("cigar"))
    return c("seq").isNotNull() & (F.exists(ops, lambda x: ((x["op"] == "S") & (x["len"] >= 10)) | (x["op"].isin("I", "D") & (x["len"] >= 5))) | (c("mapq") < 20))


def kmer_evidence(calls: DataFrame, reads: DataFrame, reference: DataFrame, key: str, config: Config = DEFAULT) -> DataFrame:
    """(key, n_reads, kmer_deletion, kmer_duplication) from informative reads around each call.

    reference: (key, sequence) of the call's span.
    """
    return kmers_of(calls, meet(windows(calls, key, F.lit("deletion"), config), reads.where(informative(reads))), reference, key, config)


def kmers_of(calls: DataFrame, met: DataFrame, reference: DataFrame, key: str, config: Config = DEFAULT) -> DataFrame:
    """kmer_evidence from rows of calls and reads; reads that are not informative are left out here."""
    near = met.where(informative(met) & within(c("low") - config.read_margin, c("high") + config.read_margin)).select(c("call_key").alias(key), "seq")
    n = near.groupBy(key).agg(F.count("*").alias("n_reads"))
    known = settle(kmers.reference_kmers(reference, [key], "sequence", config.k), "reference-kmers")
    matched = kmers.match(known, kmers.kmer_counts(near, [key], "seq", config.k, known), [key])
    deletion = kmers.deletion_support(matched, [key]).select(key, c("is_match").alias("kmer_deletion"))
    duplication = kmers.duplication_support(matched, n, [key]).select(key, c("is_match").alias("kmer_duplication"))
    out = calls.select(key).join(n, key, "left").join(deletion, key, "left").join(duplication, key, "left")
    enough = F.coalesce("n_reads", F.lit(0)) >= 2
    return out.withColumns({"n_reads": F.coalesce("n_reads", F.lit(0)), "kmer_deletion": enough & F.coalesce("kmer_deletion", F.lit(False)), "kmer_duplication": enough & F.coalesce("kmer_duplication", F.lit(False))})


# --- inversions, translocations, insertions --------------------------------------------------------------


def usable(config: Config = DEFAULT) -> Column:
    return ~(c("is_unmapped") | c("is_secondary") | c("is_supplementary")) & (c("mapq") >= config.min_read_mapq)


def count_inversion(calls: DataFrame, reads: DataFrame, key: str, config: Config = DEFAULT) -> DataFrame:
    """Pair, clip, strand and supplementary counts inside and at the ends of each span."""
    return inversions_of(calls, meet(windows(calls, key, F.lit("inversion"), config), reads), key, config)


def inversions_of(calls: DataFrame, met: DataFrame, key: str, config: Config = DEFAULT) -> DataFrame:
    """count_inversion from rows of calls and reads."""
    trim = F.least(F.lit(100), F.floor((c("high") - c("low")) / 10))
    inner = c("high") - trim > c("low") + trim
    begin, end = F.when(inner, c("low") + trim).otherwise(c("low") - 500), F.when(inner, c("high") - trim).otherwise(c("high") + 500)
    inside = within(begin, end) & usable(config)
    pair = inside & c("is_paired") & ~c("mate_unmapped") & (c("mate_contig") == c("contig")) & c("mate_start").between(F.greatest(F.lit(0), begin), end)
    sized = pair & (c("template_length") != 0)
    odd = (F.abs("template_length") > 2000) | (F.abs("template_length") < 100)
    clipped = (c("mapq") >= config.min_read_mapq) & F.exists(cigar.operations(c("cigar")), lambda x: (x["op"] == "S") & (x["len"] >= 15))
    # a read counts at each end that it meets
    split_at = lambda at: F.count_if(clipped & within(c(at) - 200, c(at) + 200) & (F.abs(c("start") - c(at)) <= 100))
    mixed = F.contains(c("sa"), c("contig")) & (F.contains(c("sa"), F.lit("+-")) | F.contains(c("sa"), F.lit("-+")))
    counts = met.groupBy(c("call_key").alias(key)).agg(
        F.count_if(pair).alias("total_pairs"),
        F.count_if(pair & (c("is_reverse") == c("mate_reverse"))).alias("same_orientation"),
        F.count_if(sized).alias("n_sized"),
        F.count_if(sized & odd).alias("n_odd_sizes"),
        F.count_if(inside & ~c("is_reverse")).alias("n_forward"),
        F.count_if(inside & c("is_reverse")).alias("n_reverse"),
        (split_at("low") + split_at("high")).alias("n_splits"),
        F.count_if(c("is_supplementary") & (c("mapq") >= config.min_read_mapq) & mixed).alias("n_supplementary"),
    )
    return calls.select(key).join(counts, key, "left").fillna(0)


def score_inversion(rows: DataFrame) -> DataFrame:
    """Counts of count_inversion -> inversion_score, inversion_level, is_inversion. Without pairs it is none."""
    same = F.try_divide(c("same_orientation"), c("total_pairs"))
    odd = F.coalesce(F.try_divide(c("n_odd_sizes"), c("n_sized")), F.lit(0.0))
    bias = F.coalesce(F.try_divide(F.abs(c("n_forward") - c("n_reverse")), c("n_forward") + c("n_reverse")), F.lit(0.0))
    score = (
        points((same >= 0.7, 5), (same >= 0.5, 4), (same >= 0.3, 2), (same <= 0.1, -3))
        + points((c("same_orientation") >= 8, 3), (c("same_orientation") >= 3, 2), (c("same_orientation") >= 1, 1))
        + points((c("n_splits") >= 4, 3), (c("n_splits") >= 2, 2), (c("n_splits") >= 1, 1))
        + points((odd >= 0.5, 3), (odd >= 0.3, 2))
        + points((c("n_supplementary") >= 3, 3), (c("n_supplementary") >= 1, 2))
        + points((bias >= 0.7, 2), (bias >= 0.6, 1))
    )
    some = c("total_pairs") > 0
    level = F.when(~some, "insufficient_data").when(score >= 8, "high").when(score >= 5, "medium").when(score >= 2, "low").otherwise("negative")
    return rows.withColumns({"inversion_score": F.when(some, score), "inversion_level": level, "is_inversion": some & (score >= 2)})


def _to_partner(contig: Column, at: Column, config: Config) -> Column:
    """Number of alignments in the SA tag near the partner end, mapped well enough."""
    parts = F.filter(F.split(F.coalesce("sa", F.lit("")), ";"), lambda x: x != "")
    near = lambda x: (F.get(F.split(x, ","), F.lit(0)) == contig) & (F.abs(F.get(F.split(x, ","), F.lit(1)).try_cast("bigint") - at) <= config.translocation_window) & (F.get(F.split(x, ","), F.lit(4)).try_cast("int") >= config.min_read_mapq)
    return F.size(F.filter(parts, lambda x: (F.size(F.split(x, ",")) >= 6) & F.coalesce(near(x), F.lit(False))))


def count_translocation(calls: DataFrame, reads: DataFrame, key: str, config: Config = DEFAULT) -> DataFrame:
    """Reads at both ends whose mates or split alignments lead to the other end, and orientations at the first."""
    return translocations_of(calls, meet(windows(calls, key, F.lit("translocation"), config), reads), key, config)


def translocations_of(calls: DataFrame, met: DataFrame, key: str, config: Config = DEFAULT) -> DataFrame:
    """count_translocation from rows of calls and reads."""
    w = config.translocation_window
    used, one, two = met.where(usable(config)), c("place") == "first", c("place") == "second"
    leads = lambda contig, at: c("is_paired") & ~c("mate_unmapped") & (c("mate_contig") == contig) & (F.abs(c("mate_start") - at) <= w)
    clip = one & ~c("is_paired") & F.exists(cigar.operations(c("cigar")), lambda x: (x["op"] == "S") & (x["len"] >= 20)) & (F.abs(c("start") - c("p1")) <= 100)
    to_two, to_one = one & leads(c("c2"), c("p2")), two & leads(c("c1"), c("p1"))
    facing = lambda a, b: F.count_if(to_two & (c("is_reverse") == a) & (c("mate_reverse") == b))
    partner = lambda here, contig, at: F.coalesce(F.sum(F.when(here, _to_partner(c(contig), c(at), config))), F.lit(0))
    counts = used.groupBy(c("call_key").alias(key)).agg(
        F.count_if(one).alias("n_reads_1"), F.count_if(to_two).alias("pairs_1"), (F.count_if(clip) + partner(one, "c2", "p2")).alias("splits_1"),
        F.greatest(facing(False, False), facing(False, True), facing(True, False), facing(True, True)).alias("dominant"),
        F.count_if(two).alias("n_reads_2"), F.count_if(to_one).alias("pairs_2"), partner(two, "c1", "p1").alias("splits_2"),
    )
    return calls.select(key).join(counts, key, "left").fillna(0)


def score_translocation(rows: DataFrame) -> DataFrame:
    """Counts of count_translocation -> translocation_score, translocation_level, is_translocation."""
    pairs, splits = c("pairs_1") + c("pairs_2"), c("splits_1") + c("splits_2")
    score = (
        points((pairs >= 5, 6), (pairs >= 3, 4), (pairs >= 1, 2))
        + points((splits >= 3, 5), (splits >= 2, 3), (splits >= 1, 2))
        + points(((c("pairs_1") > 0) & (c("pairs_2") > 0), 3))
        + points(((c("splits_1") > 0) & (c("splits_2") > 0), 3))
        + points(((c("dominant") >= 2) & (F.try_divide(c("dominant"), c("pairs_1")) >= 0.7), 2))
        + points((c("n_reads_1") + c("n_reads_2") >= 20, 1))
    )
    level = F.when(score >= 10, "high").when(score >= 6, "medium").when(score >= 3, "low").otherwise("not_supported")
    return rows.withColumns({"translocation_score": score, "translocation_level": level, "is_translocation": score >= 3})


def count_insertion(calls: DataFrame, reads: DataFrame, key: str, expected_length: Column, insert_kmers: Column | None = None, config: Config = DEFAULT) -> DataFrame:
    """Clips on both sides of an insertion point, those of like length, and those that share k-mers with it."""
    return insertions_of(calls, meet(windows(calls, key, F.lit("insertion"), config), reads), key, expected_length, insert_kmers, config)


def insertions_of(calls: DataFrame, met: DataFrame, key: str, expected_length: Column, insert_kmers: Column | None = None, config: Config = DEFAULT) -> DataFrame:
    """count_insertion from rows of calls and reads."""
    facts = calls.select(c(key).alias("call_key"), expected_length.alias("expected"), (insert_kmers if insert_kmers is not None else F.lit(None).cast("array<string>")).alias("known"))
    met = met.where(usable(config) & c("seq").isNotNull() & ((F.abs(c("start") - c("p1")) <= 100) | (F.abs(c("end") - c("p1")) <= 100))).join(facts, "call_key")
    ops = cigar.operations(c("cigar"))
    clip = lambda i: F.when(F.element_at(ops, i)["op"] == "S", F.element_at(ops, i)["len"])
    left = F.when((clip(1) >= 10) & (c("start") >= c("p1") - 50), F.struct(clip(1).alias("len"), F.substring(c("seq"), F.lit(1), clip(1).cast("int")).alias("seq"), F.lit("l").alias("side")))
    right = F.when((clip(-1) >= 10) & (c("end") <= c("p1") + 50), F.struct(clip(-1).alias("len"), F.substring(c("seq"), (F.length("seq") - clip(-1) + 1).cast("int"), clip(-1).cast("int")).alias("seq"), F.lit("r").alias("side")))
    clips = met.select("call_key", "expected", "known", F.explode(F.array_compact(F.array(left, right))).alias("c"))
    like = F.abs(c("c.len") - c("expected")) <= F.greatest(F.lit(5.0), c("expected") * 0.2)
    out = clips.groupBy(c("call_key").alias(key)).agg(
        F.count_if(c("c.side") == "l").alias("n_left"), F.count_if(c("c.side") == "r").alias("n_right"),
        F.count_if((c("expected") > 10) & like).alias("n_like"),
        F.count_if(kmers.shares_kmer(c("c.seq"), c("known"), config.k_insert)).alias("n_kmer"),
        F.count(c("known")).alias("n_tested"),
    )
    return calls.select(key).join(out, key, "left").fillna(0)


def score_insertion(rows: DataFrame) -> DataFrame:
    """Counts of count_insertion -> insertion_score, insertion_level, is_insertion."""
    n = c("n_left") + c("n_right")
    share = F.when(c("n_tested") > 0, F.try_divide(c("n_kmer"), n))
    score = (
        points((share >= 0.5, 4), (share >= 0.3, 3), (share >= 0.1, 2))
        + points((n >= 5, 3), (n >= 2, 2), (n >= 1, 1))
        + points(((c("n_left") > 0) & (c("n_right") > 0), 2))
        + points((c("n_like") >= 2, 2))
    )
    level = F.when(score >= 6, "high").when(score >= 4, "medium").when(score >= 2, "low").otherwise("unsupported")
    return rows.withColumns({"insertion_score": score, "insertion_level": level, "is_insertion": score >= 2})


# --- routing ---------------------------------------------------------------------------------------------


def route(config: Config = DEFAULT) -> Column:
    """Which test a call takes: keep (none), deletion, duplication, inversion, translocation, insertion or unknown.

    Calls at negative places and large events of one contig are kept untested. Insertions are tested if they
    have more than five inserted sequences; the number of sequences then also stands for the insert's length.
    """
    one = c("start_chr") == c("end_chr")
    n = c("breakpoint_notation")
    return (
        F.when((c("start_loc") < 0) | (c("end_loc") < 0), "keep")
        .when(one & (F.abs(c("end_loc") - c("start_loc")) > config.large_event), "keep")
        .when(one & (n == "+-"), "deletion")
        .when(one & (n == "-+"), "duplication")
        .when(one & n.isin("++", "--"), "inversion")
        .when(~one, "translocation")
        .when((n == INSERTION) & (c("n_sequences") > 5), "insertion")
        .otherwise("unknown")
    )


def tested(calls: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The calls that have a test, with their __route. Insertions of 21 sequences or more are kept: their test fails."""
    routed = calls.withColumn("__route", route(config))
    return routed.where(~c("__route").isin("keep", "unknown") & ((c("__route") != "insertion") | (c("n_sequences") < 21)))


def test_spans(calls: DataFrame, key: str, config: Config = DEFAULT) -> DataFrame:
    """(contig, low, high): where reads are that any test of the calls looks at."""
    return windows(tested(calls, config), key, c("__route"), config).select(c("window_contig").alias("contig"), c("window_low").alias("low"), c("window_high").alias("high"))


def evidence_rows(calls: DataFrame, reads: DataFrame, key: str, config: Config = DEFAULT) -> DataFrame:
    """The rows of all tests, from one pass over the reads: bases and qualities are kept where a test needs them."""
    met = meet(windows(tested(calls, config), key, c("__route"), config), reads.select(*[x for x in READ_COLUMNS if x in reads.columns]))
    based, graded = c("route").isin("deletion", "duplication", "insertion"), c("route").isin("deletion", "duplication")
    return met.withColumns({"seq": F.when(based, c("seq")), "qual": F.when(graded, c("qual"))})


def germline_evidence(calls: DataFrame, reads: DataFrame, reference: DataFrame, key: str, global_coverage: float, config: Config = DEFAULT) -> DataFrame:
    """(key, route, score, is_germline) of the calls that have a test.

    score: of the route's own test (depth for deletions and duplications), null where it gives none.
    reference: (key, sequence) of spans.
    """
    asked = tested(calls, config)
    of = lambda *kinds: asked.where(c("__route").isin(*kinds))
    met = settle(evidence_rows(calls, reads, key, config), "evidence")
    at = lambda *kinds: met.where(c("route").isin(*kinds))
    spans, near = of("deletion", "duplication"), at("deletion", "duplication")
    depth = depth_scores(depth_of(bin_layout(spans, key, config), near, key, config), key, global_coverage * config.coverage_factor)
    judged = spans.select(key, c("__route").alias("route")).join(depth, key, "left").join(kmers_of(spans, near, reference, key, config), key, "left")
    of_depth = lambda name: F.when(c("route") == "deletion", c(f"{name.format('deletion')}")).otherwise(c(f"{name.format('duplication')}"))
    found = F.coalesce(of_depth("is_{}"), F.lit(False)) | F.coalesce(of_depth("kmer_{}"), F.lit(False))
    parts = [judged.select(key, "route", of_depth("{}_score").cast("int").alias("score"), found.alias("is_germline"))]
    inverted = score_inversion(inversions_of(of("inversion"), at("inversion"), key, config))
    moved = score_translocation(translocations_of(of("translocation"), at("translocation"), key, config))
    grown = score_insertion(insertions_of(of("insertion"), at("insertion"), key, c("n_sequences"), config=config))
    for name, rows in (("inversion", inverted), ("translocation", moved), ("insertion", grown)):
        parts.append(rows.select(key, F.lit(name).alias("route"), c(f"{name}_score").cast("int").alias("score"), c(f"is_{name}").alias("is_germline")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def filter_germline(calls: DataFrame, reads: DataFrame, reference: DataFrame, key: str, global_coverage: float, config: Config = DEFAULT) -> DataFrame:
    """calls without those that the normal sample's reads show to be germline.

    reference: (key, sequence) of spans. Calls without a test are kept.
    """
    found = germline_evidence(calls, reads, reference, key, global_coverage, config).where("is_germline").select(key)
    return calls.join(found, key, "left_anti")
