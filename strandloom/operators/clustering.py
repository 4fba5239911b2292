"""Clusters of breakpoints along the genome, by end contig, by insert length, and their statistics.

Breakpoints stay flat rows with a cluster number; a cluster is a group of rows, not a nested value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import DEFAULT, Config
from strandloom.functions.columns import INSERTION, event_size, insertion_like, round3
from strandloom.operators.ordered import CHUNKS, islands
from strandloom.operators.quantiles import LARGE, POSITIONS, Measures, aggregated
from strandloom.operators.stages import settle

CLUSTER = ["start_chr", "cluster"]
SAMPLES = ("tumor", "normal")
#: Rows that a task of segments sorts at most, on average: its windows then need no spill.
TASK_ROWS = 250_000


def reach(config: Config = DEFAULT) -> Column:
    """How far a breakpoint extends its cluster: to its end if that is near, else its start."""
    return F.when(F.col("is_nearby_event"), F.col("end_loc")).otherwise(F.col("start_loc"))


def bp_event_size() -> Column:
    return event_size(*[F.col(c) for c in ("breakpoint_notation", "start_chr", "start_loc", "end_chr", "end_loc", "insert_length")])


def numbered_starts(breakpoints: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """breakpoints with the number of their cluster on the start contig, also of clusters of too few reads.

    Rows at the same start are taken in the order of ord, since their extensions can differ.
    """
    extension = F.when(F.col("breakpoint_notation") == INSERTION, F.lit(config.insert_extension)).otherwise(F.lit(config.start_extension))
    return islands(breakpoints, ["start_chr"], F.col("start_loc"), reach(config), extension, [F.col("start_loc"), F.col("ord")], config.chunk, "cluster")


def segmented_starts(breakpoints: DataFrame, config: Config = DEFAULT, most: int = LARGE) -> DataFrame | None:
    """breakpoints with a segment of their contig and the number of their cluster in it, partitioned by segment.

    A segment begins where a cluster does, in the first positions of a chunk; chunks without such a place go on with the segment
    before. To find them only the rows of those positions are put in order, so rows are shuffled once, over tasks that grow with
    them, and not written. __last marks the last row of a segment, __head the first of a cluster. None if a segment would have
    most rows or there are too many chunks.
    """
    at, zone = F.col("start_loc"), max(1, config.chunk // 50)
    extension = F.when(F.col("breakpoint_notation") == INSERTION, F.lit(config.insert_extension)).otherwise(F.lit(config.start_extension))
    by, order = ["start_chr", "__chunk"], ["start_loc", "ord"]
    chunked = breakpoints.withColumn("__chunk", F.floor(at / config.chunk))
    along = Window.partitionBy("start_chr").orderBy("__chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    chunks = settle(chunked.groupBy(*by).agg(F.max(reach(config)).alias("__end"), F.count("*").alias("__n")), "chunks")
    n_chunks, n_rows = chunks.agg(F.count("*"), F.coalesce(F.sum("__n"), F.lit(0))).first()
    if n_chunks > CHUNKS:
        return None
    reached = chunks.select(*by, F.max("__end").over(earlier).alias("__reach"))
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    heads = chunked.where(at - F.col("__chunk") * config.chunk < zone).select(*by, *order, reach(config).alias("__end"), extension.alias("__extension"))
    heads = heads.join(F.broadcast(reached), by).withColumn("__before", F.greatest(F.max("__end").over(inside), "__reach"))
    opening = heads.where(F.col("__before").isNull() | (at - F.col("__before") > F.col("__extension")))
    cuts = opening.groupBy(*by).agg(F.min(F.struct(*order, F.col("__before"))).alias("__cut"))
    none = F.lit(-(1 << 62))
    cut = chunks.join(F.broadcast(cuts), by, "left").withColumn("__own", F.when(F.col("__cut").isNotNull(), F.col("__chunk")))
    cut = settle(cut.withColumn("__prior", F.coalesce(F.last("__own", True).over(earlier), none)), "segments")
    # the rows before a chunk's cut are counted in both segments
    sizes = cut.select("start_chr", "__n", F.explode(F.array_compact(F.array("__own", "__prior"))).alias("segment")).groupBy("start_chr", "segment").agg(F.sum("__n").alias("__n"))
    if not sizes.where(F.col("__n") >= most).isEmpty():
        return None
    placed = chunked.join(F.broadcast(cut.select(*by, "__cut", "__own", "__prior")), by)
    beyond = F.col("__own").isNotNull() & (F.struct(*order) >= F.struct("__cut.start_loc", "__cut.ord"))
    placed = placed.withColumn("segment", F.when(beyond, F.col("__own")).otherwise(F.col("__prior"))).drop("__chunk", "__cut", "__own", "__prior")
    carried = F.broadcast(cut.where("__own is not null").select("start_chr", F.col("__own").alias("segment"), F.col("__cut.__before").alias("__carried")))
    spark = breakpoints.sparkSession
    tasks = -(-n_rows // TASK_ROWS)
    more = [tasks] if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    held = placed.repartition(*more, "start_chr", "segment").join(carried, ["start_chr", "segment"], "left")
    whole = Window.partitionBy("start_chr", "segment").orderBy(*order)
    rows = whole.rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumns({"__before": F.max(reach(config)).over(whole.rowsBetween(Window.unboundedPreceding, -1)), "__last": F.lead(F.lit(True)).over(whole).isNull()})
    furthest = F.greatest("__before", "__carried")
    held = held.withColumn("__head", furthest.isNull() | (at - furthest > extension))
    return held.withColumn("cluster", F.count_if("__head").over(rows)).drop("__before", "__carried")


def start_clusters(breakpoints: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """numbered_starts without the clusters of too few reads."""
    return supported(numbered_starts(breakpoints, config), CLUSTER, config.min_reads)


def supported(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of the groups that have at least so many distinct read names."""
    # two different names are the smallest and the greatest: no set of names is needed
    n = F.when(F.min("read_name") < F.max("read_name"), 2).otherwise(F.count("read_name").cast("boolean").cast("int")) if least <= 2 else F.count_distinct("read_name")
    enough = rows.groupBy(*keys).agg(n.alias("__reads")).where(F.col("__reads") >= least).drop("__reads")
    return rows.join(enough, keys, "left_semi")


def sample_reads(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct reads of each sample in each group.

    The reads are made distinct first, on all their columns: neither a group's set of names nor several copies
    of each row (one for each distinct count) are held.
    """
    each = rows.select(*keys, "sample", "read_name").distinct()
    return each.groupBy(*keys).agg(*[F.count(F.when(F.col("sample") == s, F.col("read_name"))).alias(f"{s}_reads") for s in SAMPLES])


def read_sets() -> list[Column]:
    """sample_reads as aggregates, for groups whose names a buffer holds."""
    return [F.size(F.collect_set(F.when(F.col("sample") == s, F.col("read_name")))).cast("bigint").alias(f"{s}_reads") for s in SAMPLES]


def cluster_extent(clustered: DataFrame, keys: list[str] | None = None, config: Config = DEFAULT) -> DataFrame:
    """Extent, rows and distinct reads of each cluster."""
    return clustered.groupBy(*(keys or CLUSTER)).agg(
        F.min("start_loc").alias("cluster_start"),
        F.max(reach(config)).alias("cluster_end"),
        F.count("*").alias("n_breakpoints"),
        F.count_distinct("read_name").alias("n_reads"),
    )


def moments(prefix: str = "") -> list[Column]:
    """The statistics of a group of breakpoints that are sums, with three decimals."""
    return [x.alias(f"{prefix}{n}") for n, x in _moments().items()]


def _moments(of: Callable[[Column], Column] = lambda x: x) -> dict[str, Column]:
    size = bp_event_size()
    return {
        "starts_std_dev": round3(of(F.stddev_pop("start_loc"))),
        "mapq_mean": round3(of(F.avg("mapq"))),
        "event_size_std_dev": round3(of(F.stddev_pop(size))),
        "event_size_mean": round3(of(F.avg(size))),
    }


def size_median(name: str) -> tuple[Column, float, dict[str, float]]:
    return bp_event_size(), POSITIONS, {name: 0.5}


def cluster_statistics(clustered: DataFrame, keys: list[str] | None = None, prefix: str = "", large: int | None = LARGE) -> DataFrame:
    """The five statistics of each group, with three decimals; the keys must not be null."""
    name = f"{prefix}event_size_median"
    return aggregated(clustered, keys or CLUSTER, moments(prefix), [size_median(name)], large).withColumn(name, round3(F.col(name)))


def _wide_sums(config: Config, of: Callable[[Column], Column] = lambda x: x) -> dict[str, Column]:
    """The wide statistics of a group that are no medians, of its aggregates as of gives them."""
    size, insert = bp_event_size(), _inserted()
    both = F.flatten(of(F.collect_set(F.array_compact(F.array("phase_set_start", "phase_set_end")))))
    hp = lambda v: of(F.count_if(F.col("haplotype_start").eqNullSafe(v) & _phased())) + of(F.count_if(F.col("haplotype_end").eqNullSafe(v) & _phased()))
    n, span = of(F.count("*")), of(F.max(reach(config))) - of(F.min("start_loc"))
    samples, sources = of(F.collect_set("sample")), of(F.collect_set("source"))
    return {
        "total_breakpoints": n,
        "unique_samples": F.size(samples).cast("bigint"),
        "sample_list": F.array_join(F.array_sort(samples), ","),
        "unique_sources": F.size(sources).cast("bigint"),
        "source_list": F.array_join(F.array_sort(sources), ","),
        **_moments(of),
        "starts_mean": round3(of(F.avg("start_loc"))),
        "starts_min": of(F.min("start_loc")),
        "starts_max": of(F.max("start_loc")),
        "mapq_std_dev": round3(of(F.stddev_pop("mapq"))),
        "mapq_min": of(F.min("mapq")),
        "mapq_max": of(F.max("mapq")),
        "event_size_min": of(F.min(size)),
        "event_size_max": of(F.max(size)),
        "insert_count": of(F.count(insert)),
        "insert_mean": F.coalesce(round3(of(F.avg(insert))), F.lit(0.0)),
        "insert_std_dev": F.coalesce(round3(of(F.stddev_pop(insert))), F.lit(0.0)),
        "tumor_alignments": of(F.count_if(F.col("sample") == "tumor")),
        "normal_alignments": of(F.count_if(F.col("sample") == "normal")),
        "haplotype_1": hp(1),
        "haplotype_2": hp(2),
        "haplotype_none": hp(None),
        "phase_sets_count": F.size(F.array_distinct(both)),
        "cluster_span": span,
        "breakpoint_density": n / F.greatest(F.lit(1), span) * 1000,
    }


def _wide_medians() -> Measures:
    return [size_median("event_size_median"), (F.col("start_loc"), POSITIONS, {"starts_median": 0.5}), (F.col("mapq"), 16, {"mapq_median": 0.5}), (_inserted(), POSITIONS, {"insert_median": 0.5})]


def _dominant(n: str, first: str) -> Column:
    """The most frequent notation and its number; ties go to the one that comes first."""
    return F.max_by(F.struct("breakpoint_notation", F.col(n).alias("n")), F.struct(n, (-F.col(f"{first}.start_loc")).alias("s"), (-F.col(f"{first}.ord")).alias("o")))


def sample_supports(tumor: Column, normal: Column, total: Column) -> dict[str, Column]:
    most, least = F.greatest(tumor, normal), F.when(F.least(tumor, normal) > 0, F.least(tumor, normal)).otherwise(F.greatest(tumor, normal))
    return {"max_sample_support": most, "min_sample_support": least, "support_ratio": most / total}


def comprehensive_statistics(clustered: DataFrame, keys: list[str] | None = None, config: Config = DEFAULT, large: int | None = LARGE) -> DataFrame:
    """The wide statistics of each cluster; histograms become one column for each value that can occur.

    Ties of the most frequent notation go to the one that comes first in the cluster (by start_loc, ord).
    """
    keys = keys or CLUSTER
    sums, medians = [x.alias(n) for n, x in _wide_sums(config).items()], _wide_medians()
    wide = aggregated(clustered, keys, sums, medians, large).withColumns({n: round3(F.col(n)) for _, _, names in medians for n in names})
    wide = wide.withColumn("insert_median", F.coalesce("insert_median", F.lit(0.0)))
    counts = clustered.groupBy(*keys, "breakpoint_notation").agg(F.count("*").alias("n"), F.min(F.struct("start_loc", "ord")).alias("first"))
    dominant = counts.groupBy(*keys).agg(_dominant("n", "first").alias("d"))
    dominant = dominant.select(*keys, F.col("d.breakpoint_notation").alias("dominant_notation"), F.col("d.n").alias("dominant_count"))
    supports = sample_supports(F.col("tumor_reads"), F.col("normal_reads"), F.col("total_breakpoints"))
    return wide.join(dominant, keys).join(sample_reads(clustered, keys), keys).withColumns(supports)


def with_wide_statistics(rows: DataFrame, keys: list[str], name: str, config: Config = DEFAULT) -> DataFrame:
    """rows with a struct of the comprehensive_statistics of their group in its row with __head, else null; the distinct reads are left out.

    They are windows of the groups, which hold fewer than LARGE rows: rows that are partitioned by some of the keys are not shuffled again.
    """
    noted, whole = Window.partitionBy(*keys, "breakpoint_notation"), Window.partitionBy(*keys)
    held = rows.withColumns({"__n": F.count("*").over(noted), "__noted": F.min(F.struct("start_loc", "ord")).over(noted)})
    aggregates: dict[str, Column] = {}

    def of(x: Column) -> Column:
        # equal aggregates are one column
        place = list(aggregates).index(str(x)) if str(x) in aggregates else len(aggregates)
        aggregates.setdefault(str(x), x)
        return F.col(f"__wide{place}")

    stated = _wide_sums(config, of)
    stated |= {n: round3(of(F.percentile(x.cast("double"), F.lit(share)))) for x, _, names in _wide_medians() for n, share in names.items()}
    stated["insert_median"] = F.coalesce(stated["insert_median"], F.lit(0.0))
    dominant = of(_dominant("__n", "__noted"))
    stated |= {"dominant_notation": dominant["breakpoint_notation"], "dominant_count": dominant["n"]}
    columns = {f"__wide{i}": x.over(whole) for i, x in enumerate(aggregates.values())}
    held = held.withColumns(columns).withColumn(name, F.when(F.col("__head"), F.struct(*[x.alias(n) for n, x in stated.items()])))
    return held.drop("__n", "__noted", *columns)


def summary_lines(statistics_: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, summary): a readable report of each row of comprehensive_statistics."""
    col = F.col
    whole, one = (lambda x: F.format_number(x, 0)), (lambda x: F.format_number(x, 1))
    part = lambda *items: F.concat(*[F.lit(i) if isinstance(i, str) else i.cast("string") for i in items])
    lines = [
        part("Total Breakpoints: ", col("total_breakpoints")),
        part("Samples: ", F.replace("sample_list", F.lit(","), F.lit(", ")), " (n=", col("unique_samples"), ")"),
        part("Sources: ", F.replace("source_list", F.lit(","), F.lit(", ")), " (n=", col("unique_sources"), ")"),
        part("Range: ", whole("starts_min"), " - ", whole("starts_max"), " bp"),
        part("Position Mean ± SD: ", one("starts_mean"), " ± ", one("starts_std_dev"), " bp"),
        part("Span: ", whole("cluster_span"), " bp"),
        part("MAPQ Mean ± SD: ", one("mapq_mean"), " ± ", one("mapq_std_dev")),
        part("MAPQ Range: ", col("mapq_min"), " - ", col("mapq_max")),
        part("Event Size Mean ± SD: ", one("event_size_mean"), " ± ", one("event_size_std_dev"), " bp"),
        part("Event Size Median: ", one("event_size_median"), " bp"),
        part("Dominant Type: ", col("dominant_notation"), ": ", col("dominant_count")),
        part("Unique Reads: ", col("tumor_reads") + col("normal_reads")),
        part("Density: ", F.format_number("breakpoint_density", 2), " breakpoints/kb"),
    ]
    return statistics_.select(*(keys or CLUSTER), F.concat_ws("\n", *lines).alias("summary"))


def _inserted() -> Column:
    return F.when(F.col("breakpoint_notation") == INSERTION, F.col("insert_length"))


def _phased() -> Column:
    return F.col("haplotype_start").isNotNull() | F.col("haplotype_end").isNotNull()


def insert_length_islands(rows: DataFrame, keys: list[str], fraction: float = DEFAULT.insert_fraction) -> DataFrame:
    """Number insertion-like rows by chains of insert lengths within keys.

    Insertions are sorted by length; a row stays in the chain if its length is at most
    ceil((2 - fraction) * the length before it). Single ends go to the last chain. As a length stays in the
    chain of an equal one, chains are formed from the distinct lengths of a group, of which there are no more
    than the longest insertion has bases, however many rows the group has. Rows without a length are a chain.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be from 0 to 1")
    by_length = Window.partitionBy(*keys).orderBy("insert_length")
    inserts = rows.where(F.col("breakpoint_notation") == INSERTION)
    lengths = inserts.select(*keys, "insert_length").distinct().withColumn("__before", F.lag("insert_length").over(by_length))
    opens = F.when(F.col("__before").isNull() | (F.col("insert_length") > F.ceil(F.col("__before") * F.lit(2.0 - fraction))), 1).otherwise(0)
    lengths = lengths.withColumn("__opens", opens).withColumn("length_island", F.sum("__opens").over(by_length).cast("bigint"))
    lengths = lengths.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("insert_length").alias("__length"), "length_island")
    same = F.col("insert_length").eqNullSafe(F.col("__length"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    inserts = inserts.join(lengths, same).drop("__length", *[f"__{k}" for k in keys])
    single = rows.where(F.col("breakpoint_notation").isin("+", "-"))
    last = inserts.groupBy(*keys).agg(F.max("length_island").alias("length_island"))
    return inserts.unionByName(single.join(last, keys, "left").withColumn("length_island", F.coalesce("length_island", F.lit(1).cast("bigint"))))


def end_clusters(clustered: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Rows with two ends, with the number of their end cluster within (cluster, end contig).

    By default all rows of a start cluster that end on one contig are one end cluster. With
    config.split_ends they are split at gaps of more than end_extension between sorted ends. End clusters of
    too few reads are dropped.
    """
    rows = clustered.where(~insertion_like(F.col("breakpoint_notation")))
    keys = [*CLUSTER, "end_chr"]
    if config.split_ends:
        numbered = islands(rows, keys, F.col("end_loc"), F.col("end_loc"), F.lit(config.end_extension), [F.col("end_loc"), F.col("ord")], config.chunk, "end_cluster")
    else:
        numbered = rows.withColumn("end_cluster", F.lit(1).cast("bigint"))
    return supported(numbered, [*keys, "end_cluster"], config.min_reads)
