"""Consensus calls from clusters of breakpoints, as grouped aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import DEFAULT, Config
from strandloom.functions.columns import INSERTION, SINGLE, insertion_like, round3
from strandloom.operators.clustering import CLUSTER, SAMPLES, cluster_statistics, comprehensive_statistics, end_clusters, insert_length_islands, moments, numbered_starts, read_sets, sample_reads, sample_supports, segmented_starts, size_median, with_wide_statistics
from strandloom.operators.ordered import number_segments
from strandloom.operators.quantiles import LARGE, POSITIONS, aggregated, has_large
from strandloom.operators.refinement import refine
from strandloom.operators.stages import settle

GROUP = [*CLUSTER, "end_chr"]


def phase_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each group and sample: reads, alignments, haplotype histograms and phase sets of both ends.

    Haplotypes other than 1 and 2 count with those without one.
    """
    def histogram(end: str) -> list[Column]:
        hp = F.col(f"haplotype_{end}")
        known = hp.isin(1, 2)
        return [
            F.count_if(hp == 1).alias(f"{end}_hp1"),
            F.count_if(hp == 2).alias(f"{end}_hp2"),
            F.count_if(hp.isNull() | ~known).alias(f"{end}_hp_none"),
            F.array_join(F.transform(F.array_sort(F.collect_set(f"phase_set_{end}")), lambda x: x.cast("string")), ",").alias(f"{end}_phase_sets"),
        ]

    return rows.groupBy(*keys, "sample").agg(F.count_distinct("read_name").alias("n_reads"), F.count("*").alias("n_alignments"), *histogram("start"), *histogram("end"))


def supported_calls(rows: DataFrame, keys: list[str], config: Config = DEFAULT, large: int | None = LARGE, more: list[Column] | None = None, keep: Column | None = None) -> DataFrame:
    """One row for each group with support: its sums, the medians of its places and the statistics of its origin.

    The keys must not be null. more: further aggregates; keep: groups that stay without support (with large None).
    """
    inserts = F.when(F.col("breakpoint_notation") == INSERTION, F.col("insert_length"))
    sums = [
        F.array_join(F.array_sort(F.collect_set("source")), "/").alias("source"),
        F.count_if(F.col("breakpoint_notation") == INSERTION).alias("n_insertions"),
        F.avg(inserts).cast("bigint").alias("insert_mean"),
        F.count("inserted_sequence").alias("n_sequences"),
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col("sample") == s).alias(f"{s}_alignments") for s in SAMPLES],
        *moments("origin_"),
        *(more or []),
    ]
    place = lambda x, name: (F.col(x), POSITIONS, {name: 0.5})
    medians = [place("start_loc", "start_loc"), place("end_loc", "end_median"), size_median("origin_event_size_median")]
    whole = {x: F.col(x).cast("bigint") for x in ("start_loc", "end_median")}
    if large is None:
        calls = aggregated(rows, keys, sums + read_sets(), medians, None).where(_has_support(config) if keep is None else _has_support(config) | keep)
    else:
        calls = aggregated(rows, keys, sums, medians, large).join(sample_reads(rows, keys).where(_has_support(config)), keys)
    return calls.withColumns(whole | {"origin_event_size_median": round3(F.col("origin_event_size_median"))})


def total_reads(clustered: DataFrame, large: int | None = LARGE) -> DataFrame:
    """Distinct reads of each sample in a whole start cluster, of any event type; large is None where no cluster is large."""
    counts = sample_reads(clustered, CLUSTER) if large else clustered.groupBy(*CLUSTER).agg(*read_sets())
    return counts.select(*CLUSTER, *[F.col(f"{s}_reads").alias(f"clustered_{s}") for s in SAMPLES])


def _has_support(config: Config) -> Column:
    return F.greatest("tumor_reads", "normal_reads") >= config.min_support


def _large_groups(clustered: DataFrame, config: Config) -> DataFrame:
    groups = clustered.groupBy(*GROUP).agg(F.count("*").alias("__n")).where(F.col("__n") >= config.min_support).drop("__n")
    return clustered.join(groups, GROUP, "left_semi")


def insertion_calls(rows: DataFrame, config: Config = DEFAULT, large: int | None = LARGE) -> DataFrame:
    """Calls from the insertion-like rows of each (cluster, end contig).

    An island of insert lengths with two insertions or more is one call; else each of its notations is one
    of its own, if it has the support alone.
    """
    like = rows.where(insertion_like(F.col("breakpoint_notation")))
    enough = like.groupBy(*GROUP).agg(F.count("*").alias("__n")).where(F.col("__n") >= config.min_support).drop("__n")
    numbered = settle(insert_length_islands(like.join(enough, GROUP, "left_semi"), GROUP, config.insert_fraction), "length-islands")
    island = [*GROUP, "length_island"]
    insertions = numbered.groupBy(*island).agg(F.count_if(F.col("breakpoint_notation") == INSERTION).alias("__insertions"))
    labels = insertions.select(*island, (F.col("__insertions") >= 2).alias("__one"))
    # one aggregate for both kinds of calls: a whole island counts under the notation of its call
    labelled = numbered.join(labels, island).withColumn("__call", F.when(F.col("__one"), F.lit(INSERTION)).otherwise(F.col("breakpoint_notation")))
    return _insertions(supported_calls(labelled, [*island, "__call"], config, large))


def _insertions(calls: DataFrame) -> DataFrame:
    calls = calls.withColumnRenamed("__call", "breakpoint_notation")
    length = F.when(F.col("breakpoint_notation") == INSERTION, F.col("insert_mean")).otherwise(F.lit(0).cast("bigint"))
    end = {s.replace("origin_", "end_"): F.col(s) for s in calls.columns if s.startswith("origin_")}
    placed = calls.withColumns({"end_loc": F.col("start_loc"), "sv_length": length, "part": F.col("length_island"), **end})
    return placed.withColumns({"group_end_chr": F.col("end_chr"), "end_chr": F.col("start_chr")}).drop("length_island", "end_median", "insert_mean")


def end_calls(rows: DataFrame, config: Config = DEFAULT, reads: DataFrame | None = None, large: int | None = LARGE) -> DataFrame:
    """Calls from rows with two ends: one for each end cluster and notation with support and length.

    With config.refine and the reads, end clusters are first taken apart by their reads' alignments.
    """
    ends = end_clusters(rows, config)
    if config.refine and reads is not None:
        parted = refine(ends, reads, [*GROUP, "end_cluster"], config)
        ends = parted.withColumn("end_cluster", F.when(F.col("part") == 0, F.col("end_cluster")).otherwise(F.xxhash64("end_cluster", "part"))).drop("part")
    ends = settle(ends, "end-clusters")
    keys = [*GROUP, "end_cluster"]
    calls = supported_calls(ends, [*keys, "breakpoint_notation"], config, large).join(cluster_statistics(ends, keys, "end_", large), keys)
    return _with_ends(calls, config)


def _with_ends(calls: DataFrame, config: Config) -> DataFrame:
    length = F.when(F.col("start_chr") != F.col("end_chr"), F.lit(0)).otherwise(F.abs(F.col("end_median") - F.col("start_loc"))).cast("bigint")
    placed = calls.withColumns({"end_loc": F.col("end_median"), "sv_length": length, "part": F.col("end_cluster"), "group_end_chr": F.col("end_chr")})
    kept = placed.where((F.col("sv_length") >= config.min_length) | (F.col("start_chr") != F.col("end_chr")))
    return kept.drop("end_cluster", "end_median", "insert_mean")


#: Kinds of rows in local_calls; a marker carries the number of clusters of its segment, a wide row the statistics of its cluster.
_END, _LIKE, _MARKER, _WIDE = 0, 1, 2, 3


def local_calls(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Calls, with the reads of their clusters, of start clusters of fewer than LARGE rows, neither refined nor split at their ends.

    Rows are shuffled once, by their cluster, and windows and aggregates of its groups need no more. A call has
    min_support reads, so its groups have as many rows.
    """
    kind = F.when(insertion_like(F.col("breakpoint_notation")), _LIKE).otherwise(_END)
    return _placed_calls(rows.withColumn("__kind", kind).repartition(*CLUSTER), CLUSTER, config).drop("__kind")


def _placed_calls(rows: DataFrame, cluster: list[str], config: Config) -> DataFrame:
    """local_calls of rows with their __kind that are partitioned by keys of the cluster; markers stay rows.

    Where wide rows carry a struct __wide, the calls of their cluster have it.
    """
    insertion, like, marker = F.col("breakpoint_notation") == INSERTION, F.col("__kind") == _LIKE, F.col("__kind") >= _MARKER
    wide = ["__wide"] if "__wide" in rows.columns else []
    # a read counts in its first row
    named = Window.partitionBy(*cluster, "sample", "read_name").orderBy("__kind")
    first = (F.row_number().over(named) == 1) & F.col("read_name").isNotNull()
    totals = [f"clustered_{s}" for s in SAMPLES]
    held = rows.withColumn("__first", first & ~marker)
    held = held.withColumns({t: F.count_if(F.col("__first") & (F.col("sample") == s)).over(Window.partitionBy(*cluster)) for t, s in zip(totals, SAMPLES)}).drop("__first")

    # chains of lengths, as in insert_length_islands; single ends follow the insertions of their group
    group = Window.partitionBy(*cluster, "end_chr", "__kind")
    held = held.withColumn("__rows", F.count("*").over(group)).where((F.col("__rows") >= config.min_support) | marker).drop("__rows")
    by_length = group.orderBy(~insertion, "insert_length")
    length, before = F.col("insert_length"), F.lag("insert_length").over(by_length)
    opens = insertion & ((F.row_number().over(by_length) == 1) | (~length.eqNullSafe(before) & (before.isNull() | (length > F.ceil(before * F.lit(2.0 - config.insert_fraction))))))
    held = held.withColumn("__opens", F.when(like & opens, 1).otherwise(0))
    held = held.withColumn("part", F.greatest(F.lit(1), F.sum("__opens").over(by_length)).cast("bigint")).drop("__opens")
    if config.min_reads > config.min_support:
        held = held.withColumn("__names", F.size(F.collect_set("read_name").over(group))).where((F.col("__kind") != _END) | (F.col("__names") >= config.min_reads)).drop("__names")
    # the statistics of all rows of the end cluster: the same in each of its calls
    size, share, name = size_median("end_event_size_median")[0], F.lit(0.5), "end_event_size_median"
    names = [f"end_{x}" for x in ("starts_std_dev", "mapq_mean", "event_size_std_dev", "event_size_mean")]
    whole = [F.stddev_pop("start_loc"), F.avg("mapq"), F.stddev_pop(size), F.avg(size)]
    stated = {n: round3(x.over(group)) for n, x in zip(names, whole)} | {name: round3(F.percentile(size.cast("double"), share).over(group))}
    held = held.withColumns(stated)
    one = like & (F.count_if(insertion).over(Window.partitionBy(*cluster, "end_chr", "__kind", "part")) >= 2)
    held = held.withColumn("__call", F.when(one, F.lit(INSERTION)).otherwise(F.col("breakpoint_notation")))

    keys = [*cluster, "end_chr", "__kind", "part", "__call"]
    more = [F.max(n).alias(n) for n in [*stated, *totals]] + [F.first(n, True).alias(n) for n in wide]
    calls = supported_calls(held, keys, config, None, more, marker).withColumnRenamed("__call", "breakpoint_notation")
    calls = calls.withColumns({n: F.first(n, True).over(Window.partitionBy(*cluster)) for n in wide}).where(F.col("__kind") != _WIDE)
    within = F.when(F.col("start_chr") != F.col("end_chr"), F.lit(0)).otherwise(F.abs(F.col("end_median") - F.col("start_loc")))
    inserted = F.when(F.col("breakpoint_notation") == INSERTION, F.col("insert_mean")).otherwise(F.lit(0))
    calls = calls.withColumns({n: F.when(like, F.col(n.replace("end_", "origin_", 1))).otherwise(F.col(n)) for n in stated})
    calls = calls.withColumns({"end_loc": F.when(like, F.col("start_loc")).otherwise(F.col("end_median")), "sv_length": F.when(like, inserted).otherwise(within).cast("bigint")})
    calls = calls.where((F.col("__kind") != _END) | (F.col("sv_length") >= config.min_length) | (F.col("start_chr") != F.col("end_chr")))
    calls = calls.withColumns({"group_end_chr": F.col("end_chr"), "end_chr": F.when(like, F.col("start_chr")).otherwise(F.col("end_chr"))}).drop("end_median", "insert_mean")
    # a marker is no call: it neither is one of a kind nor drops others
    kept = F.max(F.when(~F.col("breakpoint_notation").isin(*SINGLE) & ~marker, 1).otherwise(0)).over(Window.partitionBy(*cluster, "group_end_chr"))
    return calls.withColumn("__major", kept).where(marker | ~F.col("breakpoint_notation").isin(*SINGLE) | (F.col("__major") == 0)).drop("__major")


def segmented_calls(breakpoints: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """call_breakpoints of the start clusters of breakpoints, which are neither numbered nor written before.

    Segments of contigs begin where a cluster does: rows are shuffled once, by segment, and clusters and calls are made
    from that. A marker row a segment tells how many clusters it has, by which the calls' clusters are
    numbered. Where a segment could hold a cluster of LARGE rows, the clusters are numbered first.
    """
    calls = _segment_calls(breakpoints, config)
    if calls is None:
        return call_breakpoints(numbered_starts(breakpoints, config), config)
    return number_segments(calls, ["start_chr"], F.col("__kind") == _MARKER, "cluster", "raw-calls").drop("__kind")


def reported_calls(breakpoints: DataFrame, names: list[str], config: Config = DEFAULT, wide: bool = False) -> DataFrame:
    """The columns names of segmented_calls, which alone are written; wide: followed by those of with_cluster_statistics."""
    calls = _segment_calls(breakpoints, config, wide)
    if calls is None:
        clustered = numbered_starts(breakpoints, config)
        calls = call_breakpoints(clustered, config)
        stated = with_cluster_statistics(calls, clustered, config) if wide else calls
        return stated.select(*names, *[x for x in stated.columns if x not in calls.columns])
    reads = [F.col(f"clustered_{s}").alias(f"__{s}") for s in SAMPLES] if wide else []
    held = calls.select("segment", "__kind", *names, *reads, *["__wide"] * wide)
    if wide:
        held = held.select(*[x for x in held.columns if x != "__wide"], *[F.col(f"__wide.{x}").alias(f"start_{x}") for x in held.schema["__wide"].dataType.names])
    out = number_segments(held, ["start_chr"], F.col("__kind") == _MARKER, "cluster").drop("__kind")
    if wide:
        tumor, normal = F.col("__tumor"), F.col("__normal")
        more = {"tumor_reads": tumor, "normal_reads": normal, **sample_supports(tumor, normal, F.col("start_total_breakpoints"))}
        out = out.withColumns({f"start_{n}": x for n, x in more.items()}).drop("__tumor", "__normal")
    return out


def _segment_calls(breakpoints: DataFrame, config: Config, wide: bool = False) -> DataFrame | None:
    """Calls and markers with the number of their cluster in its segment; None where a segment could hold a large cluster."""
    held = None if config.split_ends else segmented_starts(_present(breakpoints), config, LARGE)
    if held is None:
        return None
    cluster = ["start_chr", "segment", "cluster"]
    if wide:
        held = with_wide_statistics(held, cluster, "__wide", config)
    kind = F.when(insertion_like(F.col("breakpoint_notation")), _LIKE).otherwise(_END)
    # the last row of a segment has the number of its clusters, the first of a cluster its statistics
    kinds = [kind, F.when(F.col("__last"), _MARKER)] + [F.when(F.col("__head"), _WIDE)] * wide
    held = held.withColumn("__kind", F.explode(F.array_compact(F.array(*kinds)))).drop("__last", "__head")
    if wide:
        held = held.withColumn("__wide", F.when(F.col("__kind") == _WIDE, F.col("__wide")))
    return _placed_calls(held, cluster, config)


def _present(breakpoints: DataFrame) -> DataFrame:
    """Only whether a row has a sequence counts: the bases need not be written again."""
    return breakpoints.withColumn("inserted_sequence", F.when(F.col("inserted_sequence").isNotNull(), F.lit("")))


def drop_minor_single_ends(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Without the single-end calls of groups that have calls of another kind."""
    major = ~F.col("breakpoint_notation").isin("+", "-")
    seen = F.max(F.when(major, 1).otherwise(0)).over(Window.partitionBy(*keys))
    return calls.withColumn("__major", seen).where(major | (F.col("__major") == 0)).drop("__major")


def call_breakpoints(clustered: DataFrame, config: Config = DEFAULT, reads: DataFrame | None = None) -> DataFrame:
    """Clustered breakpoints -> consensus calls, one flat row each."""
    every = _present(clustered)
    if (config.refine and reads is not None) or config.split_ends:
        few, many = None, every
    elif has_large(every, CLUSTER):
        # of n rows no more than n / LARGE clusters are large
        big = F.broadcast(settle(every.groupBy(*CLUSTER).agg(F.count("*").alias("__n")).where(F.col("__n") >= LARGE).drop("__n"), "large-clusters"))
        few, many = every.join(big, CLUSTER, "left_anti"), every.join(big, CLUSTER, "left_semi")
    else:
        few, many = every, None
    calls = None if few is None else settle(local_calls(few, config), "raw-calls")
    if many is not None:
        rows = settle(_large_groups(many, config), "call-groups")
        large = LARGE if has_large(rows, GROUP) else None
        raw = settle(insertion_calls(rows, config, large).unionByName(end_calls(rows, config, reads, large)), "raw-calls")
        spread = drop_minor_single_ends(raw, [*CLUSTER, "group_end_chr"]).join(total_reads(many), CLUSTER)
        calls = spread if calls is None else calls.unionByName(spread)
    return calls


def with_cluster_statistics(calls: DataFrame, clustered: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """calls with the wide statistics of their start cluster (start_*); a call's end statistics are those it carries."""
    wide = comprehensive_statistics(clustered, config=config)
    return calls.join(wide.select(*CLUSTER, *[F.col(x).alias(f"start_{x}") for x in wide.columns if x not in CLUSTER]), CLUSTER)
