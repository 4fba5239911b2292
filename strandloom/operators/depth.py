"""Local depth and allele fractions of calls, by lookup joins on binned coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import DEFAULT, Config
from strandloom.operators.coverage import haplotype_known
from strandloom.operators.ordered import interval_join

#: Bins in a step of the join with runs of depth.
RUN_WIDTH = 1000
#: Bins in a chunk of a contig in which reads and calls meet.
CHUNK_BINS = 100_000
SAMPLES, PLACES, ENDS = ("tumor", "normal"), ("before", "at", "after"), ("start", "end")


def allele_fraction(support: Column, depth: Column) -> Column:
    """Supporting alignments over depth, three decimals, at most 1; 0 without depth."""
    return F.when(depth > 0, F.least(F.lit(1.0), F.bround(support / depth, 3))).otherwise(F.lit(0.0))


def read_count_report(calls: DataFrame, clustered: DataFrame | None = None, key: str = "call_id") -> DataFrame:
    """(key, sample, called_reads, cluster_reads, differs): distinct reads of each call against those of its start cluster.

    The reads of the cluster are counted from clustered, or are those that its calls carry (clustered_tumor, clustered_normal).
    """
    if clustered is None:
        sides = F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), F.col(f"{s}_reads").alias("called_reads"), F.col(f"clustered_{s}").alias("cluster_reads")) for s in SAMPLES]))
        return calls.select(key, sides.alias("r")).select(key, "r.*", (F.col("r.called_reads") != F.col("r.cluster_reads")).alias("differs"))
    called = calls.select(key, "start_chr", "cluster", F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), F.col(f"{s}_reads").alias("called_reads")) for s in SAMPLES])).alias("r")).select(key, "start_chr", "cluster", "r.*")
    own = clustered.groupBy("start_chr", "cluster", "sample").agg(F.count_distinct("read_name").alias("cluster_reads"))
    out = called.join(own, ["start_chr", "cluster", "sample"], "left").withColumn("cluster_reads", F.coalesce("cluster_reads", F.lit(0).cast("bigint")))
    return out.select(key, "sample", "called_reads", "cluster_reads", (F.col("called_reads") != F.col("cluster_reads")).alias("differs"))


def _asked_ends(calls: DataFrame, contigs: DataFrame | None, config: Config, key: str) -> DataFrame:
    """(key, end_name, contig, loc, centre, __last): both ends of each call, with their bin and the last one of the contig."""
    ends = calls.select(key, F.explode(F.array(*[F.struct(F.lit(e).alias("end_name"), F.col(f"{e}_chr").alias("contig"), F.col(f"{e}_loc").alias("loc")) for e in ENDS])).alias("e")).select(key, "e.*")
    centre = F.greatest(F.lit(0), F.floor(F.col("loc") / config.coverage_bin)).cast("bigint")
    if contigs is not None:
        ends = ends.join(contigs.select("contig", F.floor(F.col("length") / config.coverage_bin).alias("__last")), "contig", "left")
        centre = F.least(centre, F.coalesce("__last", centre)).cast("bigint")
    else:
        ends = ends.withColumn("__last", F.lit(None).cast("bigint"))
    return ends.withColumn("centre", centre)


def annotate_read_depth(calls: DataFrame, reads: DataFrame, contigs: DataFrame | None = None, config: Config = DEFAULT, key: str = "call_id") -> DataFrame:
    """annotate_depth by the coverage of reads, which is not made: one row a read and chunk is shuffled, once.

    Reads and the ends of calls meet in chunks of bins. A read rises in its first bin of a chunk and falls behind its last,
    so the running sums of a chunk take nothing over from those before it.
    """
    low, high = F.least("start", "end"), F.greatest("start", "end")
    first, last = F.floor(low / config.coverage_bin), F.floor(high / config.coverage_bin)
    tracks = [(s, hp) for s in SAMPLES for hp in (1, 2, None)]
    track = F.coalesce(*[F.when((F.col("sample") == s) & F.col("haplotype").eqNullSafe(hp), F.lit(i)) for i, (s, hp) in enumerate(tracks)])
    chunks = lambda a, b: F.explode(F.sequence(F.floor(a / CHUNK_BINS), F.floor(b / CHUNK_BINS)))
    spans = reads.where(haplotype_known()).select("contig", track.alias("track"), first.alias("__first"), last.alias("__last_bin"), chunks(first, last).alias("chunk")).where("track is not null")
    begin, none = F.col("chunk") * CHUNK_BINS, lambda t: F.lit(None).cast(t)
    spans = spans.select("contig", "chunk", "track", (F.greatest("__first", begin) - begin).cast("int").alias("at"), (F.least(F.col("__last_bin") + 1, begin + CHUNK_BINS) - begin).cast("int").alias("until"))
    ends = _asked_ends(calls, contigs, config, key)
    asked = ends.select("contig", chunks(F.col("centre") - 1, F.col("centre") + 1).alias("chunk"), F.col(key), "end_name", "centre", "__last")
    asked = asked.select("contig", "chunk", none("int").alias("track"), (F.col("centre") - begin).cast("int").alias("at"), none("int").alias("until"), key, "end_name", "__last")
    both = spans.select("*", none(calls.schema[key].dataType).alias(key), none("string").alias("end_name"), none("bigint").alias("__last")).unionByName(asked)

    step = lambda at, d, place: F.struct(at.alias("at"), F.lit(d).alias("d"), F.lit(place).alias("place"))
    steps = F.array(step(F.col("at"), 1, None), step(F.col("until"), -1, None))
    places = F.array(*[step(F.col("at") + i - 1, 0, p) for i, p in enumerate(PLACES)])
    events = both.repartition("contig", "chunk").select("contig", "chunk", "track", key, "end_name", "__last", F.explode(F.when(F.col("track").isNull(), places).otherwise(steps)).alias("s"))
    events = events.select("contig", "chunk", "track", key, "end_name", "__last", "s.*")
    place = F.col("chunk") * CHUNK_BINS + F.col("at")
    inside = F.col("at").between(0, CHUNK_BINS - 1) & (place >= 0) & (F.col("__last").isNull() | (place <= F.col("__last")))
    # steps at one bin are peers: a call's sums have all of them
    along = Window.partitionBy("contig", "chunk").orderBy("at")
    sums = [F.coalesce(F.sum(F.when(F.col("track") == i, F.col("d"))).over(along), F.lit(0)).alias(f"__{i}") for i in range(len(tracks))]
    met = events.select(key, "end_name", "place", inside.alias("__inside"), "track", *sums).where("track is null and __inside")
    of = lambda p, e, x: F.max(F.when((F.col("place") == p) & (F.col("end_name") == e), x))
    each = {s: [F.col(f"__{i}") for i, t in enumerate(tracks) if t[0] == s] for s in SAMPLES}
    totals = [of(p, e, each[s][0] + each[s][1] + each[s][2]).cast("bigint").alias(f"dp_{s}_{p}_{e}") for s in SAMPLES for p in PLACES for e in ENDS]
    phased = [F.concat_ws(",", *[F.coalesce(of("at", e, x), F.lit(0)).cast("string") for x in each[s]]).alias(f"hp_{s}_{e}") for s in SAMPLES for e in ENDS]
    return _with_depths(calls, met.groupBy(key).agg(*totals, *phased), key)


def annotate_depth(calls: DataFrame, coverage: DataFrame, contigs: DataFrame | None = None, config: Config = DEFAULT, key: str = "call_id") -> DataFrame:
    """calls with dp_<sample>_<place>_<end> (all haplotypes), hp_<sample>_<end> ('1,2,none' at the bin) and af_<sample>_<end>.

    coverage has bins (coverage.binned_coverage), or runs of equal depth (coverage.coverage_by_deltas): those
    are two rows a read instead of one for each bin it touches. The bin of an end is clamped to the contig
    where contigs (contig, length) are given; bins beyond an end of the contig count 0.
    """
    ends = _asked_ends(calls, contigs, config, key)
    places = F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.lit(i - 1).alias("shift")) for i, p in enumerate(PLACES)]))
    asked = ends.withColumn("p", places).select(key, "end_name", "contig", F.col("p.place").alias("place"), (F.col("centre") + F.col("p.shift")).alias("bin"), "__last")
    asked = asked.where((F.col("bin") >= 0) & (F.col("__last").isNull() | (F.col("bin") <= F.col("__last")))).drop("__last")
    if "next_bin" in coverage.columns:
        runs = coverage.select(F.col("contig").alias("__contig"), "sample", "haplotype", F.col("bin").alias("__first"), "next_bin", "depth")
        met = interval_join(asked, runs, [("contig", "__contig")], F.col("bin"), F.col("__first"), F.col("next_bin") - 1, RUN_WIDTH)
    else:
        met = asked.join(coverage, ["contig", "bin"])
    depth = lambda s, p, e: F.sum(F.when((F.col("sample") == s) & (F.col("place") == p) & (F.col("end_name") == e), F.col("depth")))
    by_hp = lambda s, e, hp: F.coalesce(F.sum(F.when((F.col("sample") == s) & (F.col("place") == "at") & (F.col("end_name") == e) & F.col("haplotype").eqNullSafe(hp), F.col("depth"))), F.lit(0))
    totals = [depth(s, p, e).cast("bigint").alias(f"dp_{s}_{p}_{e}") for s in SAMPLES for p in PLACES for e in ENDS]
    phased = [F.concat_ws(",", *[by_hp(s, e, hp).cast("string") for hp in (1, 2, None)]).alias(f"hp_{s}_{e}") for s in SAMPLES for e in ENDS]
    return _with_depths(calls, met.groupBy(key).agg(*totals, *phased), key)


def _with_depths(calls: DataFrame, found: DataFrame, key: str) -> DataFrame:
    out = calls.join(found, key, "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in found.columns if c.startswith("dp_")})
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit("0,0,0")) for c in found.columns if c.startswith("hp_")})
    return out.withColumns({f"af_{s}_{e}": allele_fraction(F.col(f"{s}_alignments"), F.col(f"dp_{s}_at_{e}")) for s in SAMPLES for e in ENDS})
