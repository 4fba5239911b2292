"""Named queries over the driver tables and the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.config import DEFAULT
from strandloom.functions import cigar, kmers
from strandloom.functions import columns as x
from strandloom.operators import assembly, breakpoints, calling, clustering, coverage, depth, germline, ordered, panel, refinement, shortreads, somatic
from strandloom.operators.stages import settle, stored
from strandloom.plans import views as v
from strandloom.sources import text, variants

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r6(value):
    """Six decimals, half up, by the same arithmetic as the SQL: rounding functions differ on ties."""
    return F.floor((c(value) if isinstance(value, str) else value) * 1_000_000 + F.lit(0.5)) / F.lit(1_000_000.0)


def _r3(e: str) -> str:
    return f"floor(({e}) * 1000 + 0.5) / 1000.0"


def _stats(prefix: str = "") -> str:
    return ", ".join(
        f"{_r3(e)} AS {prefix}{n}"
        for n, e in (
            ("starts_std_dev", "stddev_pop(start_loc)"),
            ("mapq_mean", "avg(mapq)"),
            ("event_size_std_dev", "stddev_pop(event_size)"),
            ("event_size_median", "median(event_size)"),
            ("event_size_mean", "avg(event_size)"),
        )
    )


# --- clustering ------------------------------------------------------------------------------------------


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    return settle(clustering.start_clusters(v.breakpoints(spark, d)), "clusters")


@query(f"""WITH {v.CLUSTERED}
    SELECT start_chr, cluster, min(start_loc) AS cluster_start, max(CASE WHEN is_nearby_event THEN end_loc ELSE start_loc END) AS cluster_end,
           count(*) AS n_breakpoints, count(DISTINCT read_name) AS n_reads FROM cl GROUP BY start_chr, cluster""")
def start_clusters(spark, d):
    return clustering.cluster_extent(_clustered(spark, d))


@query(f"WITH {v.CLUSTERED} SELECT start_chr, cluster, {_stats()} FROM cl GROUP BY start_chr, cluster")
def cluster_stats(spark, d):
    return clustering.cluster_statistics(_clustered(spark, d))


_SPAN = "(max(CASE WHEN is_nearby_event THEN end_loc ELSE start_loc END) - min(start_loc))"
_INS = "FILTER (WHERE breakpoint_notation = '<INS>')"
_PHASED = "(haplotype_start IS NOT NULL OR haplotype_end IS NOT NULL)"


def _hp(value: str) -> str:
    return f"count(*) FILTER (WHERE haplotype_start IS NOT DISTINCT FROM {value} AND {_PHASED}) + count(*) FILTER (WHERE haplotype_end IS NOT DISTINCT FROM {value} AND {_PHASED})"


@query(f"""WITH {v.CLUSTERED}, sets AS (
        SELECT start_chr, cluster, count(DISTINCT ps) AS n FROM (SELECT start_chr, cluster, phase_set_start AS ps FROM cl UNION ALL SELECT start_chr, cluster, phase_set_end FROM cl) GROUP BY ALL
    ), notations AS (
        SELECT start_chr, cluster, breakpoint_notation, count(*) AS n, min((start_loc, ord)) AS f FROM cl GROUP BY ALL
    ), dominant AS (
        SELECT start_chr, cluster, breakpoint_notation AS dominant_notation, n AS dominant_count FROM notations
        QUALIFY row_number() OVER (PARTITION BY start_chr, cluster ORDER BY n DESC, f) = 1
    ), wide AS (
        SELECT start_chr, cluster, count(*) AS total_breakpoints, count(DISTINCT sample) AS unique_samples, string_agg(DISTINCT sample, ',' ORDER BY sample) AS sample_list,
               count(DISTINCT source) AS unique_sources, string_agg(DISTINCT source, ',' ORDER BY source) AS source_list, {_stats()},
               {_r3("avg(start_loc)")} AS starts_mean, {_r3("median(start_loc)")} AS starts_median, min(start_loc) AS starts_min, max(start_loc) AS starts_max,
               {_r3("median(mapq)")} AS mapq_median, {_r3("stddev_pop(mapq)")} AS mapq_std_dev, min(mapq) AS mapq_min, max(mapq) AS mapq_max,
               CAST(min(event_size) AS BIGINT) AS event_size_min, CAST(max(event_size) AS BIGINT) AS event_size_max, count(*) {_INS} AS insert_count,
               coalesce({_r3(f"avg(insert_length) {_INS}")}, 0.0) AS insert_mean, coalesce({_r3(f"median(insert_length) {_INS}")}, 0.0) AS insert_median,
               coalesce({_r3(f"stddev_pop(insert_length) {_INS}")}, 0.0) AS insert_std_dev,
               count(*) FILTER (WHERE sample = 'tumor') AS tumor_alignments, count(*) FILTER (WHERE sample = 'normal') AS normal_alignments,
               count(DISTINCT read_name) FILTER (WHERE sample = 'tumor') AS tumor_reads, count(DISTINCT read_name) FILTER (WHERE sample = 'normal') AS normal_reads,
               {_hp("1")} AS haplotype_1, {_hp("2")} AS haplotype_2, {_hp("NULL")} AS haplotype_none,
               CAST({_SPAN} AS BIGINT) AS cluster_span, count(*) / greatest(1, {_SPAN}) * 1000 AS breakpoint_density
        FROM cl GROUP BY start_chr, cluster)
    SELECT wide.*, n AS phase_sets_count, dominant_notation, dominant_count, greatest(tumor_reads, normal_reads) AS max_sample_support,
           CASE WHEN least(tumor_reads, normal_reads) > 0 THEN least(tumor_reads, normal_reads) ELSE greatest(tumor_reads, normal_reads) END AS min_sample_support,
           greatest(tumor_reads, normal_reads) / total_breakpoints AS support_ratio
    FROM wide JOIN sets USING (start_chr, cluster) JOIN dominant USING (start_chr, cluster)""")
def cluster_stats_full(spark, d):
    out = clustering.comprehensive_statistics(_clustered(spark, d))
    return out.withColumn("phase_sets_count", c("phase_sets_count").cast("bigint"))


_ENDS = v.CLUSTERED + """, ec AS (SELECT * FROM cl WHERE breakpoint_notation NOT IN ('<INS>', '+', '-')
    AND (start_chr, cluster, end_chr) IN (SELECT (start_chr, cluster, end_chr) FROM cl WHERE breakpoint_notation NOT IN ('<INS>', '+', '-') GROUP BY start_chr, cluster, end_chr HAVING count(DISTINCT read_name) >= 2))"""


@query(f"WITH {_ENDS} SELECT start_chr, cluster, end_chr, count(*) AS n_breakpoints, count(DISTINCT read_name) AS n_reads, min(end_loc) AS first_end, max(end_loc) AS last_end FROM ec GROUP BY ALL")
def end_groups(spark, d):
    rows = clustering.end_clusters(_clustered(spark, d))
    return rows.groupBy("start_chr", "cluster", "end_chr").agg(F.count("*").alias("n_breakpoints"), F.count_distinct("read_name").alias("n_reads"), F.min("end_loc").alias("first_end"), F.max("end_loc").alias("last_end"))


@query(f"""WITH {v.CLUSTERED}, e AS (SELECT *, CASE WHEN end_loc - max(end_loc) OVER (PARTITION BY start_chr, cluster, end_chr ORDER BY end_loc, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 50 THEN 0 ELSE 1 END AS eo
        FROM cl WHERE breakpoint_notation NOT IN ('<INS>', '+', '-')
    ), n AS (SELECT *, CAST(sum(eo) OVER (PARTITION BY start_chr, cluster, end_chr ORDER BY end_loc, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_cluster FROM e)
    SELECT start_chr, cluster, end_chr, end_cluster, count(*) AS n_breakpoints FROM n GROUP BY ALL HAVING count(DISTINCT read_name) >= 2""")
def end_clusters_split(spark, d):
    from dataclasses import replace

    rows = clustering.end_clusters(_clustered(spark, d), replace(DEFAULT, split_ends=True))
    return rows.groupBy("start_chr", "cluster", "end_chr", "end_cluster").agg(F.count("*").alias("n_breakpoints"))


_ISLANDS = """ins AS (SELECT *, lag(insert_length) OVER (PARTITION BY start_chr, cluster, end_chr ORDER BY insert_length, ord) AS before FROM {rows} WHERE breakpoint_notation = '<INS>'
    ), li AS (SELECT *, CAST(sum(CASE WHEN before IS NULL OR insert_length > ceil(before * 1.25) THEN 1 ELSE 0 END) OVER (PARTITION BY start_chr, cluster, end_chr ORDER BY insert_length, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS length_island FROM ins)"""


@query(f"WITH {v.CLUSTERED}, {_ISLANDS.format(rows='cl')} SELECT start_chr, cluster, length_island, count(*) AS n, min(insert_length) AS shortest, max(insert_length) AS longest FROM li GROUP BY ALL")
def insert_length_islands(spark, d):
    rows = clustering.insert_length_islands(_clustered(spark, d).where("breakpoint_notation = '<INS>'"), calling.GROUP)
    return rows.groupBy("start_chr", "cluster", "length_island").agg(F.count("*").alias("n"), F.min("insert_length").alias("shortest"), F.max("insert_length").alias("longest"))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, value FROM events
    ), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM e
    ), n AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM f)
    SELECT user_id, session, count(*) AS n_events, min(t) AS first_us, max(t) AS last_us FROM n GROUP BY ALL""")
def session_clusters_events(spark, d):
    rows = v.table(spark, d, "events").select("user_id", "event_id", F.unix_micros(c("ts").cast("timestamp")).alias("t"))
    out = ordered.islands(rows, ["user_id"], c("t"), c("t"), F.lit(1_800_000_000), [c("t"), c("event_id")], 86_400_000_000, "session")
    return out.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("t").alias("first_us"), F.max("t").alias("last_us"))


# --- calls -----------------------------------------------------------------------------------------------

_SUPPORT = """count(DISTINCT read_name) FILTER (WHERE sample = 'tumor') AS tumor_reads, count(DISTINCT read_name) FILTER (WHERE sample = 'normal') AS normal_reads,
    count(*) FILTER (WHERE sample = 'tumor') AS tumor_alignments, count(*) FILTER (WHERE sample = 'normal') AS normal_alignments"""
_AGG = f"""CAST(trunc(median(start_loc)) AS BIGINT) AS start_loc, CAST(trunc(median(end_loc)) AS BIGINT) AS end_median, string_agg(DISTINCT source, '/' ORDER BY source) AS source,
    count(*) FILTER (WHERE breakpoint_notation = '<INS>') AS n_insertions, CAST(trunc(avg(insert_length) {_INS}) AS BIGINT) AS insert_mean, count(inserted_sequence) AS n_sequences, count(*) AS n_rows,
    {_SUPPORT}, {_stats("origin_")}"""
_ORIGIN_AS_END = ", ".join(f"origin_{s} AS end_{s}" for s in variants.STATISTICS)
_ORIGINS = ", ".join(f"origin_{s}" for s in variants.STATISTICS)
_EACH = "start_chr, cluster, start_loc, end_chr, end_loc, breakpoint_notation, sv_length, part, source, n_insertions, n_sequences, n_rows, tumor_reads, normal_reads, tumor_alignments, normal_alignments"
_CALLS = v.CLUSTERED + f""", big AS (SELECT * FROM cl WHERE (start_chr, cluster, end_chr) IN (SELECT (start_chr, cluster, end_chr) FROM cl GROUP BY ALL HAVING count(*) >= 3)
    ), many AS (SELECT * FROM big WHERE breakpoint_notation = '<INS>' AND (start_chr, cluster, end_chr) IN (SELECT (start_chr, cluster, end_chr) FROM big WHERE breakpoint_notation = '<INS>' GROUP BY ALL HAVING count(*) >= 3)
    ), {_ISLANDS.format(rows='many')}, whole AS (SELECT start_chr, cluster, end_chr, length_island AS part, '<INS>' AS breakpoint_notation, {_AGG} FROM li GROUP BY start_chr, cluster, end_chr, length_island
    ), icalls AS (SELECT *, start_loc AS end_loc, insert_mean AS sv_length, end_chr AS group_end_chr, {_ORIGIN_AS_END} FROM whole WHERE greatest(tumor_reads, normal_reads) >= 3
    ), ends AS (SELECT * FROM big WHERE breakpoint_notation <> '<INS>' AND (start_chr, cluster, end_chr) IN (SELECT (start_chr, cluster, end_chr) FROM big WHERE breakpoint_notation <> '<INS>' GROUP BY ALL HAVING count(DISTINCT read_name) >= 2)
    ), estats AS (SELECT start_chr, cluster, end_chr, {_stats("end_")} FROM ends GROUP BY ALL
    ), eagg AS (SELECT start_chr, cluster, end_chr, 1::BIGINT AS part, breakpoint_notation, {_AGG} FROM ends GROUP BY start_chr, cluster, end_chr, breakpoint_notation
    ), ecalls AS (SELECT eagg.*, end_median AS end_loc, CASE WHEN start_chr <> end_chr THEN 0 ELSE abs(end_median - start_loc) END AS sv_length, end_chr AS group_end_chr, estats.* EXCLUDE (start_chr, cluster, end_chr)
                   FROM eagg JOIN estats USING (start_chr, cluster, end_chr) WHERE greatest(tumor_reads, normal_reads) >= 3
    ), allcalls AS (SELECT {_EACH}, {_ORIGINS}, {", ".join("end_" + s for s in variants.STATISTICS)} FROM icalls
                    UNION ALL SELECT {_EACH}, {_ORIGINS}, {", ".join("end_" + s for s in variants.STATISTICS)} FROM ecalls WHERE sv_length >= 50 OR start_chr <> end_chr
    ), totals AS (SELECT start_chr, cluster, count(DISTINCT read_name) FILTER (WHERE sample = 'tumor') AS clustered_tumor, count(DISTINCT read_name) FILTER (WHERE sample = 'normal') AS clustered_normal FROM cl GROUP BY ALL
    ), calls AS (SELECT *, start_chr || ':' || cluster || ':' || end_chr || ':' || part || ':' || breakpoint_notation AS call_id FROM allcalls JOIN totals USING (start_chr, cluster))"""


def _called(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Breakpoints with the columns of calls."""
    used = [*calling.GROUP[:1], "end_chr", "start_loc", "end_loc", "read_name", "sample", "breakpoint_notation", "insert_length", "inserted_sequence", "mapq", "source", "is_nearby_event", "ord"]
    return v.breakpoints(spark, d).select(*used, *more)


_KEYED = ["start_chr", "cluster", "end_chr", "part", "breakpoint_notation"]


def _keyed(calls: DataFrame) -> DataFrame:
    return calls.withColumn("call_id", F.concat_ws(":", *[c(x).cast("string") for x in _KEYED]))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Consensus calls with a key."""
    return _keyed(calling.segmented_calls(_called(spark, d)).drop("group_end_chr"))


@query(f"WITH {_CALLS} SELECT * FROM calls")
def consensus_calls(spark, d):
    return _calls(spark, d)


_PHASES = ", ".join(
    f"count(*) FILTER (WHERE haplotype_{e} = 1) AS {e}_hp1, count(*) FILTER (WHERE haplotype_{e} = 2) AS {e}_hp2, count(*) FILTER (WHERE haplotype_{e} IS NULL OR haplotype_{e} NOT IN (1, 2)) AS {e}_hp_none, "
    f"coalesce(string_agg(DISTINCT CAST(phase_set_{e} AS VARCHAR), ',' ORDER BY CAST(phase_set_{e} AS VARCHAR)), '') AS {e}_phase_sets"
    for e in ("start", "end")
)


@query(f"WITH {v.CLUSTERED} SELECT start_chr, cluster, breakpoint_notation, sample, count(DISTINCT read_name) AS n_reads, count(*) AS n_alignments, {_PHASES} FROM cl GROUP BY ALL")
def phase_counts(spark, d):
    return calling.phase_counts(_clustered(spark, d), ["start_chr", "cluster", "breakpoint_notation"])


@query("""WITH g AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '+-' ELSE '+' END AS breakpoint_notation FROM orders)
    SELECT * FROM g WHERE breakpoint_notation NOT IN ('+', '-') OR o_custkey NOT IN (SELECT o_custkey FROM g WHERE breakpoint_notation NOT IN ('+', '-'))""")
def svtype_filter(spark, d):
    n = F.element_at(F.array(*[F.lit(a) for a in ("+", "-", "+-", "+")]), (c("o_orderkey") % 4 + 1).cast("int"))
    return calling.drop_minor_single_ends(v.table(spark, d, "orders").select("o_orderkey", "o_custkey", n.alias("breakpoint_notation")), ["o_custkey"])


# --- coverage and depth ----------------------------------------------------------------------------------

_COV = v.READS + """, cov AS (SELECT sample, contig, haplotype, bin, count(*) AS depth
    FROM (SELECT sample, contig, haplotype, unnest(range(start // 10, "end" // 10 + 1)) AS bin FROM reads) GROUP BY ALL)"""


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage.binned_coverage(v.reads(spark, d), DEFAULT.coverage_bin)


@query(f"WITH {_COV} SELECT * FROM cov")
def coverage_bins(spark, d):
    return _coverage(spark, d)


@query(f"WITH {_COV} SELECT sample, contig, haplotype, count(*) AS n_bins, CAST(sum(depth) AS BIGINT) AS total, max(depth) AS deepest FROM cov GROUP BY ALL")
def coverage_by_hp(spark, d):
    runs = coverage.coverage_by_deltas(v.reads(spark, d), DEFAULT.coverage_bin)
    wide = c("next_bin") - c("bin")
    return runs.groupBy("sample", "contig", "haplotype").agg(F.sum(wide).alias("n_bins"), F.sum(c("depth") * wide).alias("total"), F.max("depth").alias("deepest"))


@query(f"WITH {_COV} SELECT sample, contig, haplotype, bin, depth FROM cov")
def coverage_deltas(spark, d):
    runs = coverage.coverage_by_deltas(v.reads(spark, d), DEFAULT.coverage_bin, 500)
    return runs.select("sample", "contig", "haplotype", F.explode(F.sequence("bin", c("next_bin") - 1)).alias("bin"), "depth")


@query(f"""WITH {_COV}, parts AS (SELECT sample, contig, haplotype, bin, depth FROM cov UNION ALL SELECT sample, contig, haplotype, bin, depth FROM cov WHERE sample = 'normal')
    SELECT sample, contig, haplotype, bin, CAST(sum(depth) AS BIGINT) AS depth FROM parts GROUP BY ALL""")
def coverage_merge(spark, d):
    runs = coverage.coverage_by_deltas(v.reads(spark, d), DEFAULT.coverage_bin)
    return coverage.run_bins(coverage.merge_runs(runs, runs.where("sample = 'normal'")))


@query(f"""WITH {_COV}, w AS (SELECT DISTINCT sample, contig, haplotype FROM cov), b AS (SELECT *, unnest(range(0, 30001)) AS bin FROM w)
    SELECT b.sample, b.contig, b.haplotype, count(*) AS n_bins, CAST(sum(coalesce(depth, 0)) AS BIGINT) AS total, count(*) FILTER (WHERE depth IS NULL) AS n_empty
    FROM b LEFT JOIN cov ON b.sample = cov.sample AND b.contig = cov.contig AND b.haplotype IS NOT DISTINCT FROM cov.haplotype AND b.bin = cov.bin GROUP BY ALL""")
def coverage_dense(spark, d):
    rows = coverage.dense_coverage(_coverage(spark, d), v.contigs(spark, d), DEFAULT.coverage_bin)
    return rows.groupBy("sample", "contig", "haplotype").agg(F.count("*").alias("n_bins"), F.sum("depth").alias("total"), F.count_if(c("depth") == 0).alias("n_empty"))


@query(f"WITH {v.READS} SELECT sample, CAST(sum(query_length) AS BIGINT) AS read_length, CAST(sum(query_length) AS BIGINT) / {v.GENOME} AS coverage FROM reads GROUP BY sample")
def global_coverage(spark, d):
    return coverage.genome_coverage(v.reads(spark, d), v.GENOME)


def _depth_sql() -> str:
    cols = []
    for s in ("tumor", "normal"):
        for p, shift in (("before", -1), ("at", 0), ("after", 1)):
            for e in ("start", "end"):
                cols.append(f"CAST(coalesce(sum(depth) FILTER (WHERE sample = '{s}' AND shift = {shift} AND e = '{e}'), 0) AS BIGINT) AS dp_{s}_{p}_{e}")
        for e in ("start", "end"):
            parts = " || ',' || ".join(f"CAST(coalesce(sum(depth) FILTER (WHERE sample = '{s}' AND shift = 0 AND e = '{e}' AND haplotype IS NOT DISTINCT FROM {hp}), 0) AS VARCHAR)" for hp in ("1", "2", "NULL"))
            cols.append(f"{parts} AS hp_{s}_{e}")
    return _CALLS + ", " + _COV.replace(v.READS, v.READS) + f""", ends AS (SELECT call_id, 'start' AS e, start_chr AS contig, start_loc AS loc FROM calls UNION ALL SELECT call_id, 'end', end_chr, end_loc FROM calls
    ), asked AS (SELECT call_id, e, contig, shift, loc // 10 + shift AS bin FROM ends, (VALUES (-1), (0), (1)) AS t(shift)
    ), met AS (SELECT call_id, {", ".join(cols)} FROM asked LEFT JOIN cov USING (contig, bin) GROUP BY call_id
    ), raw AS (SELECT * FROM calls JOIN met USING (call_id)
    ), ann AS (SELECT *, {", ".join(f"CASE WHEN dp_{s}_at_{e} > 0 THEN least(1.0, round_even({s}_alignments / dp_{s}_at_{e}, 3)) ELSE 0.0 END AS af_{s}_{e}" for s in ("tumor", "normal") for e in ("start", "end"))} FROM raw)"""


_ANNOTATED = _depth_sql().replace(", ends AS (SELECT * FROM big", ", wends AS (SELECT * FROM big").replace("FROM ends GROUP BY", "FROM wends GROUP BY")
_DEPTHS = [f"dp_{s}_{p}_{e}" for s in ("tumor", "normal") for p in ("before", "at", "after") for e in ("start", "end")]


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    return depth.annotate_read_depth(_calls(spark, d), v.reads(spark, d))


@query(f"WITH {_ANNOTATED} SELECT call_id, {', '.join(_DEPTHS)}, hp_tumor_start, hp_tumor_end, hp_normal_start, hp_normal_end FROM ann")
def depth_annotation(spark, d):
    return _annotated(spark, d).select("call_id", *_DEPTHS, "hp_tumor_start", "hp_tumor_end", "hp_normal_start", "hp_normal_end")


@query(f"WITH {_ANNOTATED} SELECT call_id, tumor_alignments, normal_alignments, af_tumor_start, af_tumor_end, af_normal_start, af_normal_end FROM ann")
def allele_fraction(spark, d):
    return _annotated(spark, d).select("call_id", "tumor_alignments", "normal_alignments", "af_tumor_start", "af_tumor_end", "af_normal_start", "af_normal_end")


# --- somatic filters -------------------------------------------------------------------------------------

_FEATURED = _ANNOTATED + """, f0 AS (SELECT *, greatest(af_tumor_start, af_tumor_end) AS tumor_af, greatest(af_normal_start, af_normal_end) AS normal_af,
        tumor_reads / (normal_reads + 1) AS support_ratio, least(origin_mapq_mean, end_mapq_mean) AS min_mapq, abs(origin_mapq_mean - end_mapq_mean) AS mapq_diff,
        least(dp_tumor_at_start, dp_tumor_at_end) AS tumor_coverage, least(dp_normal_at_start, dp_normal_at_end) AS normal_coverage FROM ann
    ), feat AS (SELECT *, tumor_reads / (tumor_coverage + 1) AS support_density, tumor_reads / greatest(2.0, tumor_coverage * 0.06::DOUBLE) AS support_ratio_expected,
        tumor_af * tumor_coverage / (tumor_reads + 1) AS af_support_consistency, clustered_normal / (clustered_tumor + 1) AS normal_noise_ratio,
        greatest(origin_starts_std_dev, end_starts_std_dev) / (end_event_size_mean + 1) AS std_dev_ratio,
        CASE WHEN tumor_coverage > 0 THEN ceil(tumor_coverage * 0.1::DOUBLE) + 1 ELSE 3 END AS ms FROM f0)"""
_FEATURES = ["tumor_af", "normal_af", "support_ratio", "min_mapq", "mapq_diff", "tumor_coverage", "normal_coverage", "support_density", "support_ratio_expected", "af_support_consistency", "normal_noise_ratio", "std_dev_ratio"]


def _featured(spark: SparkSession, d: str) -> DataFrame:
    return somatic.features(_annotated(spark, d), "ONT")


@query(f"WITH {_FEATURED} SELECT call_id, {', '.join(_FEATURES)} FROM feat")
def features(spark, d):
    return _featured(spark, d).select("call_id", *_FEATURES)


_SPREAD_SQL = "(origin_starts_std_dev / (end_event_size_mean + 1) > 10 OR end_starts_std_dev / (end_event_size_mean + 1) > 40)"
_NOISY_SQL = "(clustered_normal > 1 AND clustered_normal / (clustered_tumor + 1e-8) > 0.1)"
_COVERAGES = (2.0, 1.0)


@query(f"""WITH {_FEATURED} SELECT call_id, CASE WHEN normal_coverage / {_COVERAGES[1]}::DOUBLE < 0.3 OR normal_coverage / {_COVERAGES[1]}::DOUBLE > 3.0 THEN 'abnormal_coverage_ratio' WHEN normal_coverage < 2 THEN 'low_normal_coverage'
    WHEN normal_af > 0.05 THEN 'high_normal_af' WHEN tumor_af < 0.05 THEN 'low_tumor_af' WHEN min_mapq < 55 THEN 'low_mapq' WHEN mapq_diff > 5 THEN 'mapq_diff_too_large'
    WHEN normal_reads > CASE WHEN normal_coverage > 0 THEN floor(normal_coverage * 0.1::DOUBLE) ELSE 1 END THEN 'high_normal_support' WHEN tumor_reads < ms THEN 'low_tumor_support'
    WHEN {_SPREAD_SQL} THEN 'high_std_dev' WHEN {_NOISY_SQL} THEN 'high_clustered_normal_ratio' WHEN support_ratio < {_COVERAGES[0]}::DOUBLE * 0.15::DOUBLE THEN 'low_support_ratio'
    WHEN breakpoint_notation = '<INS>' AND origin_starts_std_dev > 30 THEN 'insertion_high_std_dev' END AS reason FROM feat""")
def filter_strict_high(spark, d):
    return _featured(spark, d).select("call_id", somatic.strict_high(F.lit(_COVERAGES[0]), F.lit(_COVERAGES[1])).alias("reason"))


@query(f"""WITH {_FEATURED} SELECT call_id, CASE WHEN tumor_af < 0.05 THEN 'low_tumor_af' WHEN normal_af > 0.05 THEN 'high_normal_af' WHEN min_mapq < 55 THEN 'low_mapq' WHEN normal_coverage < 2 THEN 'low_normal_coverage'
    WHEN mapq_diff > 5 THEN 'mapq_diff_too_large' WHEN {_SPREAD_SQL} THEN 'high_std_dev' WHEN {_NOISY_SQL} THEN 'high_clustered_normal_ratio' END AS reason FROM feat""")
def filter_strict_low(spark, d):
    return _featured(spark, d).select("call_id", somatic.strict_low().alias("reason"))


_LENIENT_SQL = """CASE WHEN normal_af > 0.05 AND NOT (normal_af <= 0.07 AND tumor_af >= 0.2 AND tumor_reads >= ms * 3 AND support_ratio >= 10) THEN 'bed_high_normal_af'
    WHEN tumor_af < 0.1 AND NOT (tumor_af >= 0.08 AND tumor_reads >= ms * 3 AND normal_reads = 0) THEN 'bed_low_tumor_af'
    WHEN min_mapq < 40 AND NOT (min_mapq >= 35 AND tumor_reads >= ms * 3 AND tumor_af >= 0.2 AND normal_reads = 0) THEN 'bed_low_mapq'
    WHEN normal_reads > 0 AND NOT (normal_reads <= 1 AND tumor_reads >= ms * 3 AND tumor_af >= 0.2 AND support_ratio >= ms) THEN 'bed_high_normal_support'
    WHEN tumor_reads < ms AND NOT (tumor_reads >= ms * 0.8 AND tumor_af >= 0.3 AND normal_reads = 0) THEN 'bed_low_tumor_support'
    WHEN clustered_normal > 3 AND NOT (clustered_normal <= 4 AND tumor_reads >= ms * 3 AND tumor_af >= 0.3 AND normal_reads = 0) THEN 'bed_high_clustered_normal' END"""


@query(f"WITH {_FEATURED} SELECT call_id, {_LENIENT_SQL} AS reason FROM feat")
def filter_bed_lenient(spark, d):
    return _featured(spark, d).select("call_id", somatic.bed_lenient().alias("reason"))


@query(f"""WITH {_FEATURED} SELECT call_id, NOT ((abs(sv_length) BETWEEN 1 AND 49) OR normal_af > 0.1 OR tumor_af < 0.1 OR min_mapq < 40 OR normal_reads > 1 OR tumor_reads < ceil(30 * 0.1::DOUBLE) + 1 OR clustered_normal > 1) AS passes FROM feat""")
def filter_legacy(spark, d):
    return _featured(spark, d).select("call_id", somatic.legacy(30.0).alias("passes"))


_CONFIDENT = _FEATURED + """, conf0 AS (SELECT *, least(1.0, tumor_af / 0.05::DOUBLE) AS af_confidence, least(1.0, support_ratio_expected) AS support_confidence, least(1.0, min_mapq / 60.0::DOUBLE) AS quality_confidence,
        1.0::DOUBLE / (1.0 + normal_noise_ratio * 10) AS noise_confidence, greatest(0.1, 1.0 - greatest(0.0, normal_af - 0.01::DOUBLE) * 20) AS normal_af_confidence FROM feat
    ), conf AS (SELECT *, (af_confidence + support_confidence + quality_confidence + noise_confidence + normal_af_confidence) / 6.0 AS confidence_score FROM conf0)"""


@query(f"WITH {_CONFIDENT} SELECT call_id, af_confidence, support_confidence, quality_confidence, noise_confidence, normal_af_confidence, confidence_score FROM conf")
def confidence(spark, d):
    return somatic.confidence(_featured(spark, d)).select("call_id", *somatic.confidence_factors(), "confidence_score")


@query(f"""WITH {_FEATURED} SELECT quantile_cont(tumor_af, 0.1) AS af_p10, quantile_cont(tumor_af, 0.25) AS af_p25, quantile_cont(tumor_af, 0.5) AS af_p50, quantile_cont(tumor_af, 0.75) AS af_p75,
    quantile_cont(tumor_af, 0.9) AS af_p90, CAST(median(tumor_reads) AS DOUBLE) AS support_median, median(min_mapq) AS mapq_median, count(*) AS total_variants FROM feat""")
def reference_stats(spark, d):
    # read for the quantiles and the count
    return somatic.reference_statistics(settle(_featured(spark, d).select("tumor_af", "tumor_reads", "min_mapq"), "featured"))


@query(f"WITH {_ANNOTATED} SELECT coalesce(avg((af_tumor_start + af_tumor_end) / 2) FILTER (WHERE (af_tumor_start + af_tumor_end) / 2 >= 0.1 AND (af_normal_start + af_normal_end) / 2 <= 0.01), 0.0) AS mean_af FROM ann")
def mean_somatic_af(spark, d):
    return somatic.mean_somatic_af(_annotated(spark, d))


@query(f"WITH {_FEATURED} SELECT avg(tumor_af) FILTER (WHERE tumor_af BETWEEN 0.1 AND 0.6) AS tumor_mean_af, avg(normal_af) FILTER (WHERE normal_af BETWEEN 0.1 AND 0.6) AS normal_mean_af FROM feat")
def af_distribution(spark, d):
    return somatic.af_distribution(_annotated(spark, d))


@query(f"WITH {_FEATURED} SELECT avg(tumor_coverage) * 0.1::DOUBLE AS depth_threshold FROM feat")
def depth_threshold(spark, d):
    return somatic.depth_threshold(_annotated(spark, d))


@query(f"""WITH {_CALLS}, {v.REGIONS}, hit AS (SELECT call_id, min((b.start, b."end")) AS r FROM calls JOIN bed b ON b.contig = calls.start_chr AND calls.start_loc BETWEEN b.start AND b."end" + 1 GROUP BY call_id)
    SELECT call_id, r[1] AS region_start, r[2] AS region_end, r IS NOT NULL AS in_region FROM calls LEFT JOIN hit USING (call_id)""")
def bed_lookup(spark, d):
    return somatic.lookup_regions(settle(_calls(spark, d), "calls"), v.regions(spark, d)).select("call_id", "region_start", "region_end", "in_region")


_STRICT_LOW_SQL = ORACLES["filter_strict_low"].split("SELECT call_id, ")[-1].rsplit(" AS reason", 1)[0]


@query(f"""WITH {_CONFIDENT}, {v.REGIONS}, hit AS (SELECT DISTINCT call_id FROM calls JOIN bed b ON b.contig = calls.start_chr AND calls.start_loc BETWEEN b.start AND b."end" + 1
    ), why AS (SELECT call_id, confidence_score, hit.call_id IS NOT NULL AS in_region, CASE WHEN abs(sv_length) BETWEEN 1 AND 49 THEN 'failed_basic_prefilter' WHEN hit.call_id IS NOT NULL THEN {_LENIENT_SQL} ELSE {_STRICT_LOW_SQL} END AS rejected
        FROM conf LEFT JOIN hit USING (call_id))
    SELECT call_id, coalesce(rejected, CASE WHEN in_region THEN 'passed_bed_lenient' ELSE 'passed_strict_low' END) AS reason, rejected IS NULL AND confidence_score >= 0.7 AS passed FROM why""")
def filter_somatic(spark, d):
    return somatic.filter_somatic(settle(_annotated(spark, d), "annotated"), *_COVERAGES, mean_af=0.2, regions=v.regions(spark, d)).select("call_id", "reason", "passed")


# --- panel of normals ------------------------------------------------------------------------------------


@query(f"WITH {v.KNOWN} SELECT * FROM pon WHERE af >= 0.01")
def pon_candidates(spark, d):
    return panel.common_variants(v.known_variants(spark, d))


@query(f"""WITH {v.BREAKPOINTS}, {v.KNOWN}, p AS (SELECT * FROM pon WHERE af >= 0.01)
    SELECT ord, start_chr, start_loc, end_chr, end_loc FROM bp WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.chr1 = bp.start_chr AND p.chr2 = bp.end_chr AND (
        (abs(bp.start_loc - p.start) <= 500 AND abs(bp.end_loc - p."end") <= 500) OR (bp.start_chr = bp.end_chr AND abs(bp.start_loc - p."end") <= 500 AND abs(bp.end_loc - p.start) <= 500)))""")
def pon_antijoin(spark, d):
    known = panel.common_variants(v.known_variants(spark, d))
    rows = v.breakpoints(spark, d).withColumn("key", F.xxhash64("ord", "start_loc", "end_loc", "mapq"))
    return panel.subtract(rows, known, "key").select("ord", "start_chr", "start_loc", "end_chr", "end_loc")


# --- alignments ------------------------------------------------------------------------------------------

_OPS = v.READS + """, ops AS (SELECT ord, start, cigar, is_reverse, unnest(regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 1)) AS n, unnest(regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 2)) AS op,
        unnest(range(1, len(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]')) + 1)) AS i, len(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]')) AS total FROM (SELECT DISTINCT ord, start, cigar, is_reverse FROM reads)
    ), o AS (SELECT *, CAST(n AS BIGINT) AS len FROM ops)"""


def _own_reads(spark: SparkSession, d: str) -> DataFrame:
    return v.reads(spark, d).select("ord", "start", "cigar", "is_reverse").distinct()


@query(f"""WITH {_OPS}, s AS (SELECT ord, start, cigar, is_reverse, coalesce(sum(len) FILTER (WHERE op = 'S' AND i = CASE WHEN is_reverse THEN total ELSE 1 END), 0) AS sl, coalesce(sum(len) FILTER (WHERE op = 'S' AND i <> CASE WHEN is_reverse THEN total ELSE 1 END), 0) AS sr,
        sum(len) FILTER (WHERE op = 'M') AS m, sum(len) FILTER (WHERE op = 'I') AS ins, sum(len) FILTER (WHERE op = 'D') AS del FROM o GROUP BY ALL)
    SELECT ord, cigar, CAST(sl AS BIGINT) AS softclip_left, CAST(sr AS BIGINT) AS softclip_right, CAST(m AS BIGINT) AS match_length, CAST(ins AS BIGINT) AS insert_length, CAST(del AS BIGINT) AS delete_length, 0::BIGINT AS mismatch_length,
        start AS ref_start, CAST(start + m + del AS BIGINT) AS ref_end, CAST(sl AS BIGINT) AS query_start, CAST(sl + m + ins AS BIGINT) AS query_end FROM s""")
def cigar_summary(spark, d):
    return _own_reads(spark, d).select("ord", "cigar", cigar.summary(c("cigar"), c("start"), c("is_reverse")).alias("a")).select("ord", "cigar", "a.*")


_WALK = _OPS + """, w AS (SELECT *, start + coalesce(sum(CASE WHEN op IN ('M', 'D', '=', 'X') THEN len ELSE 0 END) OVER (PARTITION BY ord, start, cigar, is_reverse ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r,
        coalesce(sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN len ELSE 0 END) OVER (PARTITION BY ord, start, cigar, is_reverse ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q FROM o)"""


@query(f"WITH {_WALK} SELECT ord, cigar, is_reverse, op AS kind, CAST(r AS BIGINT) AS event_start, CAST(r + CASE WHEN op = 'D' THEN len ELSE 0 END AS BIGINT) AS event_end, len AS event_length, CAST(q AS BIGINT) AS query_offset FROM w WHERE op IN ('D', 'I') AND len >= 30")
def cigar_indels(spark, d):
    rows, parts = _own_reads(spark, d), []
    for kind in ("D", "I"):
        e = rows.select("ord", "cigar", "is_reverse", F.lit(kind).alias("kind"), F.explode(cigar.events(cigar.operations(c("cigar")), c("start"), kind, 30)).alias("e"))
        parts.append(e.select("ord", "cigar", "is_reverse", "kind", c("e.start").alias("event_start"), c("e.end").alias("event_end"), c("e.len").alias("event_length"), c("e.query").alias("query_offset")))
    return parts[0].unionByName(parts[1])


_GAPS = """iv AS (SELECT DISTINCT l_suppkey AS g, l_partkey * 100 AS s, l_partkey * 100 + CAST(l_quantity AS BIGINT) AS e FROM lineitem
    ), fl AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 60 THEN 0 ELSE 1 END AS opens FROM iv
    ), nu AS (SELECT *, sum(opens) OVER (PARTITION BY g ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM fl)"""


@query(f"WITH {_GAPS} SELECT g AS l_suppkey, min(s) AS merged_start, max(e) AS merged_end, CAST(sum(e - s) AS BIGINT) AS merged_length FROM nu GROUP BY g, k")
def merge_intervals(spark, d):
    low = c("l_partkey") * 100
    q = c("l_quantity").cast("bigint")
    rows = v.table(spark, d, "lineitem").select("l_suppkey", F.struct(low.alias("start"), (low + q).alias("end"), q.alias("len"), F.lit(0).cast("bigint").alias("query")).alias("e")).distinct()
    merged = rows.groupBy("l_suppkey").agg(cigar.merge(F.collect_list("e"), 60).alias("m")).select("l_suppkey", F.explode("m").alias("m"))
    return merged.select("l_suppkey", c("m.start").alias("merged_start"), c("m.end").alias("merged_end"), c("m.len").alias("merged_length"))


@query(f"WITH {v.READS} SELECT ord, count(*) AS n, count(*) FILTER (WHERE CAST(regexp_extract(cigar, '^(\\d+)S', 1) AS BIGINT) >= 20) AS n_clipped FROM reads GROUP BY ord")
def clip_flags(spark, d):
    return v.reads(spark, d).groupBy("ord").agg(F.count("*").alias("n"), F.count_if(shortreads.clipped(20)).alias("n_clipped"))


@query(f"""WITH l AS (SELECT 'r' || l_orderkey AS read_name, 'chr' || ((l_suppkey + 1) % 24 + 1) AS contig, CAST(l_partkey * 100 AS BIGINT) AS ref_start, l_linestatus = 'F' AS is_reverse, CAST(l_quantity * 10 AS BIGINT) || 'S' || CAST(l_quantity * 30 AS BIGINT) || 'M' AS cigar,
        CAST(CAST(l_quantity AS BIGINT) % 60 AS INTEGER) AS mapq, l_suppkey FROM lineitem)
    SELECT read_name, 'tumor' AS sample, contig, ref_start, is_reverse, cigar, mapq FROM l WHERE mapq > 5 AND (l_suppkey + 1) % 24 + 1 <= 22""")
def sa_explode(spark, d):
    return breakpoints.split_alignments(v.split_tags(spark, d), DEFAULT.min_mapq)


_PAIRS = v.ALIGNMENTS + """, p0 AS (SELECT *, lead(contig) OVER w AS c2, lead(ref_start) OVER w AS s2, lead(ref_end) OVER w AS e2, lead(is_reverse) OVER w AS r2, lead(mapq) OVER w AS m2, lead(is_primary) OVER w AS y2, lead(query_end) OVER w AS qe2, lead(query_start) OVER w AS qs2
        FROM al WINDOW w AS (PARTITION BY read_name ORDER BY query_start)
    ), pairs AS (SELECT sample, read_name, ord, contig AS first_chr, CASE WHEN is_reverse THEN ref_start ELSE ref_end END AS first_loc, CASE WHEN is_reverse THEN '-' ELSE '+' END AS first_sign,
        CAST(substr(contig, 4) AS INTEGER) <= 22 AND mapq >= 5 AS first_reliable, is_primary AS first_primary, query_start AS first_query_start, query_end AS first_query_end, c2 AS second_chr, CASE WHEN r2 THEN e2 ELSE s2 END AS second_loc,
        CASE WHEN r2 THEN '+' ELSE '-' END AS second_sign, CAST(substr(c2, 4) AS INTEGER) <= 22 AND m2 >= 5 AS second_reliable, y2 AS second_primary, qs2 AS second_query_start, qe2 AS second_query_end, least(mapq, m2) AS mapq FROM p0 WHERE c2 IS NOT NULL)"""


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def breakpoint_pairs(spark, d):
    return breakpoints.breakpoint_pairs(v.alignments(spark, d))


@query(f"""WITH {_PAIRS}, sw AS (SELECT *, CASE WHEN first_chr = second_chr THEN first_loc > second_loc ELSE CAST(substr(first_chr, 4) AS INTEGER) > CAST(substr(second_chr, 4) AS INTEGER) END AS swap FROM pairs WHERE first_reliable AND second_reliable
    ), k AS (SELECT sample, read_name, ord, mapq, CASE WHEN swap THEN second_chr ELSE first_chr END AS start_chr, CASE WHEN swap THEN second_loc ELSE first_loc END AS start_loc, CASE WHEN swap THEN first_chr ELSE second_chr END AS end_chr,
        CASE WHEN swap THEN first_loc ELSE second_loc END AS end_loc, CASE WHEN swap THEN second_sign || first_sign ELSE first_sign || second_sign END AS sign, CASE WHEN CASE WHEN swap THEN second_primary ELSE first_primary END THEN 'start' ELSE 'end' END AS phased_end,
        CASE WHEN swap THEN second_query_start ELSE first_query_start END AS query_from, CASE WHEN swap THEN first_query_end ELSE second_query_end END AS query_to FROM sw)
    SELECT sample, read_name, ord, mapq, start_chr, start_loc, end_chr, CASE WHEN start_chr = end_chr AND sign = '-+' AND end_loc - start_loc < 50 THEN start_loc ELSE end_loc END AS end_loc, phased_end, query_from, query_to,
        CASE WHEN start_chr = end_chr AND sign = '-+' AND end_loc - start_loc < 50 THEN '<INS>' ELSE sign END AS breakpoint_notation FROM k""")
def canonical_order(spark, d):
    return breakpoints.canonical_junctions(breakpoints.breakpoint_pairs(v.alignments(spark, d)))


_TANDEM = """SELECT a.sample, a.read_name, least(a.mapq, b.mapq) AS mapq, a.contig AS start_chr, greatest(a.ref_start, b.ref_start) AS start_loc, a.contig AS end_chr, least(a.ref_end, b.ref_end) AS end_loc, '-+' AS breakpoint_notation,
    CASE WHEN a.is_primary THEN 'start' ELSE 'end' END AS phased_end FROM {t} a JOIN {t} b ON {on} AND a.is_reverse = b.is_reverse AND a.ord < b.ord AND least(a.ref_end, b.ref_end) - greatest(a.ref_start, b.ref_start) >= 30"""


@query(f"WITH {v.ALIGNMENTS}, m AS (SELECT * REPLACE ('chr1' AS contig, ref_start % 2000 AS ref_start, ref_start % 2000 + 400 AS ref_end) FROM al) " + _TANDEM.format(t="m", on="a.read_name = b.read_name AND a.contig = b.contig"))
def tandem_dups(spark, d):
    # the alignments of a read are brought to one stretch, so that many of them overlap
    rows = v.alignments(spark, d).withColumn("contig", F.lit("chr1")).withColumn("ref_start", c("ref_start") % 2000)
    return breakpoints.tandem_duplications(rows.withColumn("ref_end", c("ref_start") + 400))


# --- k-mers ----------------------------------------------------------------------------------------------

_K = DEFAULT.k
_REF = f"""ref AS (SELECT DISTINCT item_id, kmer FROM (SELECT item_id, unnest(list_transform(range(1, greatest(length(t) - {_K} + 2, 1)), lambda i: substr(t, i, {_K}))) AS kmer FROM (SELECT item_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS t FROM benchmark)) WHERE kmer NOT LIKE '%N%')"""
_READ = f"""rk AS (SELECT kmer, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(length(t) - {_K} + 2, 1)), lambda i: substr(t, i, {_K}))) AS kmer FROM (SELECT translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS t FROM documents)) WHERE kmer NOT LIKE '%N%' GROUP BY kmer)"""


def _reference_kmers(spark: SparkSession, d: str) -> DataFrame:
    return kmers.reference_kmers(v.table(spark, d, "benchmark"), ["item_id"], "text", _K)


def _matched(spark: SparkSession, d: str) -> DataFrame:
    known = settle(_reference_kmers(spark, d), "reference-kmers")
    counts = kmers.kmer_counts(v.table(spark, d, "documents"), [], "text", _K, known.select("kmer"))
    return known.join(counts, "kmer", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


@query(f"WITH {_REF} SELECT item_id, count(*) AS n_kmers, min(kmer) AS first_kmer FROM ref GROUP BY item_id")
def ref_kmers(spark, d):
    return _reference_kmers(spark, d).groupBy("item_id").agg(F.count("*").alias("n_kmers"), F.min("kmer").alias("first_kmer"))


@query(f"WITH {_READ} SELECT n, count(*) AS n_kmers FROM rk GROUP BY n")
def read_kmer_counts(spark, d):
    return kmers.kmer_counts(v.table(spark, d, "documents"), [], "text", _K).groupBy("n").agg(F.count("*").alias("n_kmers"))


@query(f"WITH {_REF}, {_READ} SELECT item_id, count(*) AS n_kmers, count(*) FILTER (WHERE coalesce(n, 0) >= 3) AS n_supported, count(*) FILTER (WHERE coalesce(n, 0) >= 3) / count(*) > 0.85 AS is_match FROM ref LEFT JOIN rk USING (kmer) GROUP BY item_id")
def kmer_match(spark, d):
    return kmers.deletion_support(_matched(spark, d), ["item_id"])


@query(f"""WITH {_REF}, {_READ}, t AS (SELECT item_id, count(*) AS n_kmers FROM ref GROUP BY item_id)
    SELECT item_id, n_kmers, count(*) FILTER (WHERE coalesce(n, 0) > (SELECT count(*) FROM documents) / greatest(100, n_kmers) * 1.5::DOUBLE) AS n_frequent,
        count(*) FILTER (WHERE coalesce(n, 0) > (SELECT count(*) FROM documents) / greatest(100, n_kmers) * 1.5::DOUBLE) / n_kmers > 0.3 AS is_match FROM ref JOIN t USING (item_id) LEFT JOIN rk USING (kmer) GROUP BY item_id, n_kmers""")
def kmer_match_dup(spark, d):
    # one count for all items: a scalar of the documents, joined by a constant key
    n = v.table(spark, d, "documents").agg(F.count("*").alias("n_reads")).first().n_reads
    items = v.table(spark, d, "benchmark").select("item_id", F.lit(n).alias("n_reads")).distinct()
    return kmers.duplication_support(_matched(spark, d), items, ["item_id"])


_LONG = "unnest(list_transform(range(1, greatest(length(t) - 21 + 2, 1)), lambda i: substr(t, i, 21))) AS kmer"
_LETTERS = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query(f"""WITH k AS (SELECT DISTINCT kmer FROM (SELECT {_LONG} FROM (SELECT {_LETTERS} AS t FROM benchmark)) WHERE kmer NOT LIKE '%N%')
    SELECT doc_id, count(DISTINCT kmer) AS n_shared FROM (SELECT doc_id, {_LONG} FROM (SELECT doc_id, {_LETTERS} AS t FROM documents)) JOIN k USING (kmer) GROUP BY doc_id""")
def insertion_kmers(spark, d):
    known = kmers.reference_kmers(v.table(spark, d, "benchmark"), [], "text", DEFAULT.k_insert)
    return kmers.shared_kmers(v.table(spark, d, "documents"), ["doc_id"], "text", known, DEFAULT.k_insert)


# --- depth evidence --------------------------------------------------------------------------------------

_BINS = """bins AS (SELECT l_suppkey AS call_id, l_partkey % 60 AS bin, CAST(l_partkey % 60 * 10 AS BIGINT) AS mid, CASE WHEN l_partkey % 60 < 20 THEN 'up' WHEN l_partkey % 60 < 40 THEN 'target' ELSE 'down' END AS region,
    CAST(sum(CAST(l_quantity AS BIGINT) * CASE WHEN l_suppkey % 3 = 0 AND l_partkey % 60 BETWEEN 20 AND 39 THEN 1 ELSE 3 END) AS DOUBLE) / 8 AS cov FROM lineitem GROUP BY ALL)"""
_G = 30.0


def _bins(spark: SparkSession, d: str) -> DataFrame:
    t = v.table(spark, d, "lineitem")
    bin_ = c("l_partkey") % 60
    factor = F.when((c("l_suppkey") % 3 == 0) & bin_.between(20, 39), 1).otherwise(3)
    region = F.when(bin_ < 20, "up").when(bin_ < 40, "target").otherwise("down")
    return t.groupBy(c("l_suppkey").alias("call_id"), bin_.alias("bin"), (bin_ * 10).alias("mid"), region.alias("region")).agg((F.sum(c("l_quantity").cast("bigint") * factor).cast("double") / 8).alias("cov"))


def _depth_sql(g: float | str) -> str:
    """Statistics ds of bins, beside genome coverage g."""
    return f""", d0 AS (SELECT call_id, count(*) FILTER (WHERE region = 'target') AS n_target, coalesce(avg(cov) FILTER (WHERE region = 'target'), 0.0) AS target_mean, coalesce(median(cov) FILTER (WHERE region = 'target'), 0.0) AS target_median,
        coalesce(stddev_pop(cov) FILTER (WHERE region = 'target'), 0.0) AS target_std, var_samp(cov) FILTER (WHERE region = 'target') AS target_var, count(*) FILTER (WHERE region <> 'target') AS n_flank,
        coalesce(avg(cov) FILTER (WHERE region <> 'target'), {g}) AS flank_mean, coalesce(stddev_pop(cov) FILTER (WHERE region <> 'target'), 0.0) AS flank_std, var_samp(cov) FILTER (WHERE region <> 'target') AS flank_var,
        avg(cov) AS all_mean, stddev_pop(cov) AS all_std FROM bins GROUP BY call_id
    ), ds AS (SELECT *, target_mean / {g}::DOUBLE AS global_ratio, CASE WHEN flank_mean > 0 THEN target_mean / flank_mean ELSE 0 END AS flank_ratio,
        CASE WHEN n_target > 1 THEN (target_mean - {g}) / nullif(sqrt(target_var / n_target), 0) ELSE 0.0 END AS t_global,
        CASE WHEN n_target > 1 AND n_flank > 1 THEN (target_mean - flank_mean) / nullif(sqrt(((n_target - 1) * target_var + (n_flank - 1) * flank_var) / (n_target + n_flank - 2) * (1.0 / n_target + 1.0 / n_flank)), 0) ELSE 0.0 END AS t_flank,
        CASE WHEN n_target > 0 THEN (target_mean - all_mean) / nullif(all_std, 0) ELSE 0.0 END AS mean_z FROM d0)"""


_DSTATS = _BINS + _depth_sql(_G)


@query(f"WITH {_DSTATS} SELECT call_id, n_target, n_flank, {', '.join(f'floor({x} * 1000000 + 0.5) / 1000000.0 AS {x}' for x in ('target_mean', 'target_median', 'target_std', 'flank_mean', 'flank_std', 'global_ratio', 'flank_ratio', 't_global', 't_flank', 'mean_z'))} FROM ds")
def coverage_ttest(spark, d):
    rows = germline.depth_statistics(_bins(spark, d), "call_id", _G)
    return rows.select("call_id", "n_target", "n_flank", *[_r6(n).alias(n) for n in ("target_mean", "target_median", "target_std", "flank_mean", "flank_std", "global_ratio", "flank_ratio", "t_global", "t_flank", "mean_z")])


def _p_sql(t: str, freedom: str) -> str:
    """Two-sided p-value of a t statistic of whole degrees of freedom, as the finite sum of powers of the cosine of atan(t / sqrt(freedom))."""
    cos2 = f"({freedom} / ({freedom} + {t} * {t}))"
    steps = f"list_transform(range(1, CAST(greatest(1, {freedom} // 2) AS BIGINT)), lambda k: {{'s': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'k': k}})"
    total = lambda ratio: f"(list_reduce(list_prepend({{'s': 1.0::DOUBLE, 'c': 1.0::DOUBLE, 'k': 0::BIGINT}}, {steps}), lambda a, x: {{'s': a.s + a.c * {cos2} * {ratio}, 'c': a.c * {cos2} * {ratio}, 'k': x.k}})).s"
    sine = f"abs({t}) / sqrt({freedom} + {t} * {t})"
    angle = f"atan(abs({t}) / sqrt({freedom}))"
    odd = f"2 / pi() * ({angle} + CASE WHEN {freedom} > 1 THEN {sine} * sqrt({cos2}) * {total('(2.0::DOUBLE * x.k / (2 * x.k + 1))')} ELSE 0 END)"
    even = f"{sine} * {total('((2.0::DOUBLE * x.k - 1) / (2 * x.k))')}"
    return f"CASE WHEN {freedom} IS NULL THEN 1.0::DOUBLE WHEN {t} IS NOT NULL THEN greatest(0, 1 - CASE WHEN {freedom} % 2 = 1 THEN {odd} ELSE {even} END) END"


_FREEDOM = "CASE WHEN n_target > 1 THEN n_target - 1 END AS df_global, CASE WHEN n_target > 1 AND n_flank > 1 THEN n_target + n_flank - 2 END AS df_flank"


@query(f"WITH {_DSTATS}, f AS (SELECT *, {_FREEDOM} FROM ds), p AS (SELECT call_id, {_p_sql('t_global', 'df_global')} AS p_global, {_p_sql('t_flank', 'df_flank')} AS p_flank FROM f) SELECT call_id, floor(p_global * 1000000 + 0.5) / 1000000.0 AS p_global, floor(p_flank * 1000000 + 0.5) / 1000000.0 AS p_flank FROM p")
def coverage_pvalues(spark, d):
    rows = germline.with_p_values(germline.depth_statistics(_bins(spark, d), "call_id", _G))
    return rows.select("call_id", _r6("p_global").alias("p_global"), _r6("p_flank").alias("p_flank"))


@query(f"WITH {_BINS} SELECT call_id, bin, floor((cov - avg(cov) OVER w) / nullif(stddev_pop(cov) OVER w, 0) * 1000000 + 0.5) / 1000000.0 AS z FROM bins WINDOW w AS (PARTITION BY call_id)")
def coverage_zscore(spark, d):
    return germline.z_scores(_bins(spark, d), "call_id").select("call_id", "bin", _r6("z").alias("z"))


_GRADIENTS = """, tb AS (SELECT call_id, min(bin) AS lo, max(bin) AS hi, count(*) AS n, avg(cov) AS t FROM bins WHERE region = 'target' GROUP BY call_id
    ), g0 AS (SELECT call_id, n, t, coalesce(avg(cov) FILTER (WHERE bin BETWEEN lo - 5 AND lo - 1), t) AS pre, coalesce(avg(cov) FILTER (WHERE bin BETWEEN hi + 1 AND hi + 5), t) AS post FROM bins JOIN tb USING (call_id) GROUP BY call_id, n, t
    ), g AS (SELECT *, CASE WHEN pre > 0 THEN t / pre ELSE 1 END AS a, CASE WHEN t > 0 THEN post / t ELSE 1 END AS b, CASE WHEN post > 0 THEN t / post ELSE 1 END AS r FROM g0)"""
_GRAD = _BINS + _GRADIENTS
_GRADIENT_DEL = "CASE WHEN n < 3 THEN 'insufficient_data' WHEN a < 0.7 AND b > 1.3 THEN 'sharp_drop_recovery' WHEN a < 0.8 AND b > 1.2 THEN 'moderate_drop_recovery' WHEN a BETWEEN 0.8 AND 1.2 AND b BETWEEN 0.8 AND 1.2 THEN 'smooth_transition' ELSE 'irregular' END"
_GRADIENT_DUP = "CASE WHEN n < 3 THEN 'insufficient_data' WHEN a > 1.3 AND r > 1.3 THEN 'sharp_elevation_pattern' WHEN a > 1.2 AND r > 1.2 THEN 'moderate_elevation_pattern' WHEN a BETWEEN 0.8 AND 1.2 AND r BETWEEN 0.8 AND 1.2 THEN 'smooth_transition' ELSE 'irregular' END"


@query(f"WITH {_GRAD} SELECT call_id, floor(a * 1000000 + 0.5) / 1000000.0 AS drop_ratio, floor(b * 1000000 + 0.5) / 1000000.0 AS recovery_ratio, {_GRADIENT_DEL} AS gradient_del FROM g")
def gradient_del(spark, d):
    return germline.gradients(_bins(spark, d), "call_id").select("call_id", _r6("drop_ratio").alias("drop_ratio"), _r6("recovery_ratio").alias("recovery_ratio"), "gradient_del")


@query(f"WITH {_GRAD} SELECT call_id, floor(a * 1000000 + 0.5) / 1000000.0 AS rise_pre, floor(r * 1000000 + 0.5) / 1000000.0 AS rise_post, {_GRADIENT_DUP} AS gradient_dup FROM g")
def gradient_dup(spark, d):
    return germline.gradients(_bins(spark, d), "call_id").select("call_id", _r6("rise_pre").alias("rise_pre"), _r6("rise_post").alias("rise_post"), "gradient_dup")


@query(f"""WITH {_BINS}, w AS (SELECT call_id, bin, mid AS first_mid, avg(cov) OVER f AS window_mean, last_value(mid) OVER f AS last_mid, count(*) OVER f AS n FROM bins WHERE region = 'target' WINDOW f AS (PARTITION BY call_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
    SELECT call_id, first_mid, last_mid, floor(window_mean * 1000000 + 0.5) / 1000000.0 AS window_mean FROM w WHERE n = 5 QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY window_mean, bin) = 1""")
def min_window(spark, d):
    return germline.minimum_window(_bins(spark, d), "call_id").select("call_id", "first_mid", "last_mid", _r6("window_mean").alias("window_mean"))


@query(f"""WITH {_DSTATS} SELECT call_id, concat_ws(',', CASE WHEN flank_mean / {_G} > 2 THEN 'high_flanking_coverage:high' WHEN flank_mean / {_G} > 1.5 THEN 'high_flanking_coverage:medium' END,
        CASE WHEN global_ratio > 1.2 THEN 'high_target_coverage' WHEN global_ratio BETWEEN 0.8 AND 1.2 THEN 'normal_target_coverage' END) AS anomalies_del,
    concat_ws(',', CASE WHEN global_ratio > 2 THEN 'very_high_target_coverage' WHEN global_ratio > 1.5 THEN 'high_target_coverage' WHEN global_ratio BETWEEN 0.8 AND 1.2 THEN 'normal_target_coverage' END, CASE WHEN flank_mean / {_G} < 0.5 THEN 'low_flanking_coverage' END) AS anomalies_dup FROM ds""")
def coverage_anomalies(spark, d):
    return germline.anomalies(germline.depth_statistics(_bins(spark, d), "call_id", _G)).select("call_id", "anomalies_del", "anomalies_dup")


# scores: p-values come from a stand-in column, so that SQL can follow
_SCORED = """s AS (SELECT l_orderkey AS call_id, l_linenumber AS line, CAST(l_partkey % 200 AS DOUBLE) / 80 AS global_ratio, CAST(l_suppkey % 90 AS DOUBLE) / 60 AS flank_ratio, CAST(l_partkey % 200 AS DOUBLE) / 80 * 30 AS target_mean, CAST(l_suppkey % 90 AS DOUBLE) AS flank_mean,
    CAST(l_quantity AS DOUBLE) / 1000 AS p_global, CAST(l_quantity AS DOUBLE) / 500 AS p_flank, CAST(l_quantity - 25 AS DOUBLE) / 8 AS mean_z, l_orderkey % 5 AS gp FROM lineitem)"""
_PATTERNS = {"del": ["sharp_drop_recovery", "moderate_drop_recovery", "smooth_transition", "irregular", "insufficient_data"], "dup": ["sharp_elevation_pattern", "moderate_elevation_pattern", "smooth_transition", "irregular", "insufficient_data"]}


def _scored(spark: SparkSession, d: str) -> DataFrame:
    t = v.table(spark, d, "lineitem")
    pattern = lambda k: F.element_at(F.array(*[F.lit(p) for p in _PATTERNS[k]]), (c("l_orderkey") % 5 + 1).cast("int"))
    ratio = (c("l_partkey") % 200).cast("double") / 80
    return t.select(
        c("l_orderkey").alias("call_id"), c("l_linenumber").alias("line"), ratio.alias("global_ratio"), ((c("l_suppkey") % 90).cast("double") / 60).alias("flank_ratio"), (ratio * 30).alias("target_mean"), (c("l_suppkey") % 90).cast("double").alias("flank_mean"),
        F.lit(30.0).alias("global_cov"), (c("l_quantity") / 1000).alias("p_global"), (c("l_quantity") / 500).alias("p_flank"), ((c("l_quantity") - 25) / 8).alias("mean_z"), pattern("del").alias("gradient_del"), pattern("dup").alias("gradient_dup"),
    )


def _level(score: str, strong: str) -> str:
    return f"CASE WHEN {score} >= 6 AND {strong} >= 1 THEN 'high' WHEN {score} >= 4 AND {strong} >= 1 THEN 'medium' WHEN {score} >= 2 THEN 'low' ELSE 'not_supported' END"


def _i(*tests: str) -> str:
    return "(" + " + ".join(f"CAST(coalesce({t}, FALSE) AS INTEGER)" for t in tests) + ")"


_STRONG_DEL = _i("global_ratio < 0.5", "p_global < 0.01 AND target_mean < 30 AND global_ratio < 0.8", "gp = 0")
_SCORE_DEL = f"{_STRONG_DEL} * 3 + {_i('flank_ratio < 0.7 AND p_flank < 0.05 AND NOT flank_mean / 30 > 1.5', 'mean_z < -2', 'gp = 1')} * 2 + {_i('global_ratio > 0.5 AND global_ratio < 0.8')} - {_i('flank_mean / 30 > 2', 'target_mean / 30 BETWEEN 0.8 AND 1.2', 'gp = 2')} * 2"
_STRONG_DUP = _i("global_ratio > 1.5", "p_global < 0.01 AND target_mean > 30 AND global_ratio > 1.2", "gp = 0")
_SCORE_DUP = f"{_STRONG_DUP} * 3 + {_i('flank_ratio > 1.3 AND p_flank < 0.05 AND NOT flank_mean / 30 < 0.5', 'mean_z > 2', 'gp = 1')} * 2 + {_i('global_ratio > 1.2 AND global_ratio < 1.5')} - {_i('flank_mean / 30 < 0.5', 'target_mean / 30 BETWEEN 0.8 AND 1.2', 'gp = 2')} * 2"


@query(f"WITH {_SCORED}, z AS (SELECT *, {_SCORE_DEL} AS sc, {_STRONG_DEL} AS st FROM s) SELECT call_id, line, sc AS deletion_score, {_level('sc', 'st')} AS deletion_level, sc >= 2 AS is_deletion FROM z")
def score_del(spark, d):
    return germline.score_deletion(_scored(spark, d)).select("call_id", "line", "deletion_score", "deletion_level", "is_deletion")


@query(f"WITH {_SCORED}, z AS (SELECT *, {_SCORE_DUP} AS sc, {_STRONG_DUP} AS st FROM s) SELECT call_id, line, sc AS duplication_score, {_level('sc', 'st')} AS duplication_level, sc >= 2 AS is_duplication FROM z")
def score_dup(spark, d):
    return germline.score_duplication(_scored(spark, d)).select("call_id", "line", "duplication_score", "duplication_level", "is_duplication")


# --- pair, clip and split evidence ------------------------------------------------------------------------


def _some_calls(spark: SparkSession, d: str) -> DataFrame:
    """Places to test, from suppliers: a span on one contig, or two contigs for every third."""
    t = v.table(spark, d, "supplier")
    low = c("s_suppkey") * 1789 % 200_000
    contig = lambda k: F.concat(F.lit("chr"), ((c("s_suppkey") + k) % 24 + 1).cast("string"))
    return t.select(c("s_suppkey").alias("call_id"), contig(0).alias("start_chr"), low.alias("start_loc"), F.when(c("s_suppkey") % 3 == 0, contig(1)).otherwise(contig(0)).alias("end_chr"), (low + c("s_suppkey") % 7 * 300 + 50).alias("end_loc"))


_PLACES = """pl AS (SELECT s_suppkey AS call_id, 'chr' || (s_suppkey % 24 + 1) AS c1, s_suppkey * 1789 % 200000 AS p1, CASE WHEN s_suppkey % 3 = 0 THEN 'chr' || ((s_suppkey + 1) % 24 + 1) ELSE 'chr' || (s_suppkey % 24 + 1) END AS c2,
    s_suppkey * 1789 % 200000 + s_suppkey % 7 * 300 + 50 AS p2 FROM supplier)"""
_USABLE = "NOT is_secondary AND NOT is_supplementary AND mapq >= 20"
_INV = v.SHORT_READS + ", " + _PLACES + f""", sp AS (SELECT *, CASE WHEN p2 - least(100, (p2 - p1) // 10) > p1 + least(100, (p2 - p1) // 10) THEN p1 + least(100, (p2 - p1) // 10) ELSE greatest(0, p1 - 500) END AS lo,
        CASE WHEN p2 - least(100, (p2 - p1) // 10) > p1 + least(100, (p2 - p1) // 10) THEN p2 - least(100, (p2 - p1) // 10) ELSE p2 + 500 END AS hi FROM pl
    ), m AS (SELECT call_id, sr.*, is_paired AND NOT mate_unmapped AND mate_contig = contig AND mate_start BETWEEN lo AND hi AS pair FROM sp JOIN sr ON sr.contig = c1 AND sr.start < hi AND sr."end" > lo WHERE {_USABLE}
    ), inside AS (SELECT call_id, count(*) FILTER (WHERE pair) AS total_pairs, count(*) FILTER (WHERE pair AND is_reverse = mate_reverse) AS same_orientation, count(*) FILTER (WHERE pair AND template_length <> 0) AS n_sized,
        count(*) FILTER (WHERE pair AND template_length <> 0 AND (abs(template_length) > 2000 OR abs(template_length) < 100)) AS n_odd_sizes, count(*) FILTER (WHERE NOT is_reverse) AS n_forward, count(*) FILTER (WHERE is_reverse) AS n_reverse FROM m GROUP BY call_id
    ), ends AS (SELECT call_id, c1, p1 AS place FROM pl UNION ALL SELECT call_id, c1, p2 FROM pl
    ), spl AS (SELECT call_id, count(*) AS n_splits FROM ends JOIN sr ON sr.contig = c1 AND sr.start < place + 200 AND sr."end" > greatest(0, place - 200) WHERE mapq >= 20 AND form < 2 AND clip >= 15 AND abs(start - place) <= 100 GROUP BY call_id
    ), cnt AS (SELECT call_id, coalesce(total_pairs, 0) AS total_pairs, coalesce(same_orientation, 0) AS same_orientation, coalesce(n_sized, 0) AS n_sized, coalesce(n_odd_sizes, 0) AS n_odd_sizes, coalesce(n_forward, 0) AS n_forward, coalesce(n_reverse, 0) AS n_reverse,
        coalesce(n_splits, 0) AS n_splits, 0::BIGINT AS n_supplementary FROM pl LEFT JOIN inside USING (call_id) LEFT JOIN spl USING (call_id)
    ), rt AS (SELECT *, same_orientation / nullif(total_pairs, 0) AS same, coalesce(n_odd_sizes / nullif(n_sized, 0), 0) AS odd, coalesce(abs(n_forward - n_reverse) / nullif(n_forward + n_reverse, 0), 0) AS bias FROM cnt
    ), z AS (SELECT *, CASE WHEN same >= 0.7 THEN 5 WHEN same >= 0.5 THEN 4 WHEN same >= 0.3 THEN 2 WHEN same <= 0.1 THEN -3 ELSE 0 END + CASE WHEN same_orientation >= 8 THEN 3 WHEN same_orientation >= 3 THEN 2 WHEN same_orientation >= 1 THEN 1 ELSE 0 END
        + CASE WHEN n_splits >= 4 THEN 3 WHEN n_splits >= 2 THEN 2 WHEN n_splits >= 1 THEN 1 ELSE 0 END + CASE WHEN odd >= 0.5 THEN 3 WHEN odd >= 0.3 THEN 2 ELSE 0 END + CASE WHEN bias >= 0.7 THEN 2 WHEN bias >= 0.6 THEN 1 ELSE 0 END AS sc FROM rt)"""


@query(f"""WITH {_INV} SELECT call_id, total_pairs, same_orientation, n_sized, n_odd_sizes, n_forward, n_reverse, n_splits, n_supplementary, CASE WHEN total_pairs > 0 THEN sc END AS inversion_score,
    CASE WHEN total_pairs = 0 THEN 'insufficient_data' WHEN sc >= 8 THEN 'high' WHEN sc >= 5 THEN 'medium' WHEN sc >= 2 THEN 'low' ELSE 'negative' END AS inversion_level, total_pairs > 0 AND sc >= 2 AS is_inversion FROM z""")
def score_inv(spark, d):
    return germline.score_inversion(germline.count_inversion(_some_calls(spark, d), v.short_reads(spark, d), "call_id"))


_BND = v.SHORT_READS + ", " + _PLACES + f""", one AS (SELECT call_id, count(*) AS n_reads_1, count(*) FILTER (WHERE pair) AS pairs_1, count(*) FILTER (WHERE NOT is_paired AND form < 2 AND clip >= 20 AND abs(start - p1) <= 100) + count(*) FILTER (WHERE split) AS splits_1,
        greatest(count(*) FILTER (WHERE pair AND NOT is_reverse AND NOT mate_reverse), count(*) FILTER (WHERE pair AND NOT is_reverse AND mate_reverse), count(*) FILTER (WHERE pair AND is_reverse AND NOT mate_reverse), count(*) FILTER (WHERE pair AND is_reverse AND mate_reverse)) AS dominant
        FROM (SELECT call_id, p1, sr.*, is_paired AND NOT mate_unmapped AND mate_contig = c2 AND abs(mate_start - p2) <= 5000 AS pair, sa_contig = c2 AND abs(mate_start + 1 - p2) <= 5000 AND sa_mapq >= 20 AS split FROM pl JOIN sr ON sr.contig = c1 AND sr.start < p1 + 5000 AND sr."end" > greatest(0, p1 - 5000) WHERE {_USABLE}) GROUP BY call_id
    ), two AS (SELECT call_id, count(*) AS n_reads_2, count(*) FILTER (WHERE pair) AS pairs_2, count(*) FILTER (WHERE split) AS splits_2
        FROM (SELECT call_id, is_paired AND NOT mate_unmapped AND mate_contig = c1 AND abs(mate_start - p1) <= 5000 AS pair, sa_contig = c1 AND abs(mate_start + 1 - p1) <= 5000 AND sa_mapq >= 20 AS split FROM pl JOIN sr ON sr.contig = c2 AND sr.start < p2 + 5000 AND sr."end" > greatest(0, p2 - 5000) WHERE {_USABLE}) GROUP BY call_id
    ), cnt AS (SELECT call_id, coalesce(n_reads_1, 0) AS n_reads_1, coalesce(pairs_1, 0) AS pairs_1, coalesce(splits_1, 0) AS splits_1, coalesce(dominant, 0) AS dominant, coalesce(n_reads_2, 0) AS n_reads_2, coalesce(pairs_2, 0) AS pairs_2, coalesce(splits_2, 0) AS splits_2
        FROM pl LEFT JOIN one USING (call_id) LEFT JOIN two USING (call_id)
    ), z AS (SELECT *, CASE WHEN pairs_1 + pairs_2 >= 5 THEN 6 WHEN pairs_1 + pairs_2 >= 3 THEN 4 WHEN pairs_1 + pairs_2 >= 1 THEN 2 ELSE 0 END + CASE WHEN splits_1 + splits_2 >= 3 THEN 5 WHEN splits_1 + splits_2 >= 2 THEN 3 WHEN splits_1 + splits_2 >= 1 THEN 2 ELSE 0 END
        + CASE WHEN pairs_1 > 0 AND pairs_2 > 0 THEN 3 ELSE 0 END + CASE WHEN splits_1 > 0 AND splits_2 > 0 THEN 3 ELSE 0 END + CASE WHEN dominant >= 2 AND dominant / nullif(pairs_1, 0) >= 0.7 THEN 2 ELSE 0 END + CASE WHEN n_reads_1 + n_reads_2 >= 20 THEN 1 ELSE 0 END AS sc FROM cnt)"""


@query(f"WITH {_BND} SELECT * EXCLUDE (sc), sc AS translocation_score, CASE WHEN sc >= 10 THEN 'high' WHEN sc >= 6 THEN 'medium' WHEN sc >= 3 THEN 'low' ELSE 'not_supported' END AS translocation_level, sc >= 3 AS is_translocation FROM z")
def score_bnd(spark, d):
    return germline.score_translocation(germline.count_translocation(_some_calls(spark, d), v.short_reads(spark, d), "call_id"))


def _ins_sql(expected: str) -> str:
    return f"""{v.SHORT_READS}, {_PLACES}, m AS (SELECT call_id, {expected} AS expected, p1, sr.* FROM pl JOIN sr ON sr.contig = c1 AND sr.start < p1 + 500 AND sr."end" > greatest(0, p1 - 500) WHERE {_USABLE} AND (abs(start - p1) <= 100 OR abs("end" - p1) <= 100)
    ), k AS (SELECT call_id, expected, clip, 'l' AS side FROM m WHERE form = 0 AND clip >= 10 AND start >= p1 - 50 UNION ALL SELECT call_id, expected, clip, 'r' FROM m WHERE form = 1 AND clip >= 10 AND "end" <= p1 + 50
    ), n AS (SELECT call_id, count(*) FILTER (WHERE side = 'l') AS n_left, count(*) FILTER (WHERE side = 'r') AS n_right, count(*) FILTER (WHERE expected > 10 AND abs(clip - expected) <= greatest(5.0, expected * 0.2::DOUBLE)) AS n_like FROM k GROUP BY call_id
    ), cnt AS (SELECT call_id, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right, coalesce(n_like, 0) AS n_like FROM pl LEFT JOIN n USING (call_id)
    ), z AS (SELECT *, CASE WHEN n_left + n_right >= 5 THEN 3 WHEN n_left + n_right >= 2 THEN 2 WHEN n_left + n_right >= 1 THEN 1 ELSE 0 END + CASE WHEN n_left > 0 AND n_right > 0 THEN 2 ELSE 0 END + CASE WHEN n_like >= 2 THEN 2 ELSE 0 END AS sc FROM cnt)"""


@query(f"""WITH {_ins_sql('call_id % 40')}
    SELECT call_id, n_left, n_right, n_like, 0::BIGINT AS n_kmer, 0::BIGINT AS n_tested, sc AS insertion_score, CASE WHEN sc >= 6 THEN 'high' WHEN sc >= 4 THEN 'medium' WHEN sc >= 2 THEN 'low' ELSE 'unsupported' END AS insertion_level, sc >= 2 AS is_insertion FROM z""")
def score_ins(spark, d):
    return germline.score_insertion(germline.count_insertion(_some_calls(spark, d), v.short_reads(spark, d), "call_id", c("call_id") % 40))


@query(f"""WITH {_CALLS} SELECT call_id, CASE WHEN start_loc < 0 OR end_loc < 0 THEN 'keep' WHEN start_chr = end_chr AND abs(end_loc - start_loc) > 50000 THEN 'keep' WHEN start_chr = end_chr AND breakpoint_notation = '+-' THEN 'deletion'
    WHEN start_chr = end_chr AND breakpoint_notation = '-+' THEN 'duplication' WHEN start_chr = end_chr AND breakpoint_notation IN ('++', '--') THEN 'inversion' WHEN start_chr <> end_chr THEN 'translocation'
    WHEN breakpoint_notation = '<INS>' AND n_sequences > 5 THEN 'insertion' ELSE 'unknown' END AS route FROM calls""")
def germline_router(spark, d):
    return _calls(spark, d).select("call_id", germline.route().alias("route"))


_ORIENT = """CASE WHEN NOT is_reverse AND NOT mate_reverse THEN 'FF' WHEN is_reverse AND mate_reverse THEN 'RR' WHEN NOT is_reverse THEN CASE WHEN start < mate_start THEN 'FR' ELSE 'RF' END WHEN start > mate_start THEN 'RF' ELSE 'FR' END"""
_DISCORDANT = """is_paired AND NOT mate_unmapped AND NOT is_secondary AND NOT is_supplementary AND (contig <> mate_contig OR abs(template_length) < 500 OR abs(template_length) > 800 OR is_reverse = mate_reverse
    OR CASE WHEN (is_read1 AND NOT is_reverse) OR (NOT is_read1 AND is_reverse) THEN start >= mate_start ELSE start <= mate_start END)"""
_ID = "ord, start, mapq, \"end\""


@query(f"WITH {v.SHORT_READS} SELECT orientation, overlapping, count(*) AS n FROM (SELECT {_ORIENT} AS orientation, coalesce(is_paired AND NOT mate_unmapped AND contig = mate_contig AND CASE WHEN mate_length IS NOT NULL THEN start < mate_start + mate_length AND mate_start < \"end\" ELSE (mate_start >= start AND mate_start < \"end\") OR (mate_start <= start AND start < mate_start + query_length) END, FALSE) AS overlapping FROM sr) GROUP BY ALL")
def pair_orientation(spark, d):
    return v.short_reads(spark, d).select(shortreads.pair_orientation().alias("orientation"), shortreads.is_overlapping().alias("overlapping")).groupBy("orientation", "overlapping").agg(F.count("*").alias("n"))


@query(f"WITH {v.SHORT_READS} SELECT read_name, start, ord, {_DISCORDANT} AS discordant, is_qcfail OR is_duplicate OR is_secondary OR is_supplementary OR mapq < 20 AS filtered FROM sr")
def discordant_pairs(spark, d):
    return v.short_reads(spark, d).select("read_name", "start", "ord", shortreads.is_discordant(500, 800).alias("discordant"), shortreads.filtered(20).alias("filtered"))


@query(f"WITH {v.SHORT_READS} SELECT sv_type, count(*) AS n FROM (SELECT CASE WHEN contig <> mate_contig THEN 'TRA' WHEN abs(template_length) > 1000 THEN 'DEL' WHEN is_reverse = mate_reverse THEN 'INV' ELSE 'UNK' END AS sv_type FROM sr) GROUP BY sv_type")
def pair_sv_type(spark, d):
    return v.short_reads(spark, d).groupBy(shortreads.pair_type().alias("sv_type")).agg(F.count("*").alias("n"))


@query(f"""WITH {v.SHORT_READS}, k AS (SELECT * FROM sr WHERE is_read1 AND {_DISCORDANT})
    SELECT ord, start, mapq, contig AS bp1_contig, greatest(0, CASE WHEN is_reverse THEN start ELSE "end" END - 500) AS bp1_begin, least(300000, CASE WHEN is_reverse THEN start ELSE "end" END + 500) AS bp1_end, CASE WHEN is_reverse THEN 'SVBEND_LEFT_OPEN' ELSE 'SVBEND_RIGHT_OPEN' END AS bp1_state,
        mate_contig AS bp2_contig, greatest(0, CASE WHEN mate_reverse THEN mate_start ELSE mate_start + coalesce(mate_length, query_length) END - 500) AS bp2_begin, least(300000, CASE WHEN mate_reverse THEN mate_start ELSE mate_start + coalesce(mate_length, query_length) END + 500) AS bp2_end,
        CASE WHEN mate_reverse THEN 'SVBEND_LEFT_OPEN' ELSE 'SVBEND_RIGHT_OPEN' END AS bp2_state, abs(template_length) AS insert_size, {_ORIENT} AS orientation FROM k""")
def discordant_breakends(spark, d):
    names = [f"bp{i}_{f}" for i in (1, 2) for f in ("contig", "begin", "end", "state")]
    return shortreads.discordant_candidates(v.short_reads(spark, d), v.contigs(spark, d), 500, 800).select("ord", "start", "mapq", *names, "insert_size", "orientation")


@query(f"""WITH {v.SHORT_READS}, a AS (SELECT *, CASE form WHEN 0 THEN clip ELSE 0 END AS aqs, CASE form WHEN 0 THEN clip + 120 ELSE 120 END AS aqe, CASE form WHEN 1 THEN clip ELSE 0 END AS acr, CAST(substr(sa_contig, 4) AS INTEGER) AS cn FROM sr WHERE sa_contig IS NOT NULL AND sa_mapq >= 20
    ), b AS (SELECT *, least(aqe, 30) - greatest(aqs, 0) AS shared, greatest(0, greatest(start, mate_start) - least("end", mate_start + 30)) AS apart FROM a)
    SELECT ord, start, mapq, sa_contig AS split_contig, mate_start AS split_start FROM b WHERE cn <= 22 AND (abs(aqe - 0) <= 10 OR abs(30 - aqs) <= 10 OR (shared <= 20 AND -shared <= 20)) AND (aqe - aqs) + 30 <= 120 + 30 AND (NOT (contig = sa_contig AND apart <= 1000) OR greatest(aqs, acr, 90) >= 8)""")
def sa_validation(spark, d):
    return shortreads.split_alignments(v.short_reads(spark, d)).select("ord", "start", "mapq", "split_contig", c("s.ref_start").alias("split_start"))


@query(f"""WITH {v.SHORT_READS} SELECT ord, start, mapq, 'DEL' AS evidence_type, greatest(0, start + 60 - 100) AS bp1_begin, least(300000, start + 60 + 100) AS bp1_end, greatest(0, start + 105 - 100) AS bp2_begin, least(300000, start + 105 + 100) AS bp2_end FROM sr WHERE form = 2""")
def indel_breakends(spark, d):
    rows = shortreads.indel_candidates(v.short_reads(spark, d), v.contigs(spark, d), c("start"), c("end"), 40)
    return rows.select("ord", "start", "mapq", "evidence_type", "bp1_begin", "bp1_end", "bp2_begin", "bp2_end")


_EVIDENCE = """discordant_ AS (SELECT *, is_read1 AND """ + _DISCORDANT.replace("500", "750").replace("800", "1000000") + """ AS odd, CAST(substr(sa_contig, 4) AS INTEGER) <= 22 AND sa_mapq >= 0 AS has_split, CASE WHEN form < 2 THEN clip ELSE 0 END AS clips FROM sr
    ), used AS (SELECT * FROM discordant_ WHERE NOT (is_qcfail OR is_duplicate OR is_secondary OR is_supplementary))"""
_MATES = """, want AS (SELECT call_id, side, read_name, is_read1, mate_contig FROM m WHERE evidence = 'discordant'
    ), every AS (SELECT call_id, side, read_name, evidence FROM m WHERE evidence IS NOT NULL UNION ALL SELECT call_id, side, w.read_name, 'mate' FROM want w JOIN sr ON sr.read_name = w.read_name AND sr.contig = w.mate_contig AND sr.is_read1 <> w.is_read1)
    SELECT call_id, side, read_name, evidence, count(*) AS n FROM every GROUP BY ALL"""


def _evidence(spark: SparkSession, d: str, kind: str) -> DataFrame:
    rows = shortreads.collect_evidence(_some_calls(spark, d), v.short_reads(spark, d), "call_id", kind)
    return rows.groupBy("call_id", "side", "read_name", "evidence").agg(F.count("*").alias("n"))


@query(f"""WITH {v.SHORT_READS}, {_PLACES}, {_EVIDENCE}, w AS (SELECT call_id, 'span' AS side, c1 AS k, greatest(0, p1 - 1000) AS lo, p2 + 1000 AS hi FROM pl
    ), m AS (SELECT call_id, side, read_name, is_read1, mate_contig, CASE WHEN has_split THEN 'split' WHEN odd THEN 'discordant' WHEN form = 2 THEN 'indel' WHEN clips >= 20 THEN 'semi' END AS evidence
        FROM w JOIN used ON contig = k AND start < hi AND "end" > lo){_MATES}""")
def evidence_small(spark, d):
    return _evidence(spark, d, "small")


_BOTH_ENDS = "w AS (SELECT call_id, 'start' AS side, c1 AS k, greatest(0, p1 - 1000) AS lo, p1 + 1000 AS hi FROM pl UNION ALL SELECT call_id, 'end', c2, greatest(0, p2 - 1000), p2 + 1000 FROM pl)"


@query(f"""WITH {v.SHORT_READS}, {_PLACES}, {_EVIDENCE}, {_BOTH_ENDS}, m AS (SELECT call_id, side, read_name, is_read1, mate_contig, CASE WHEN clips >= 15 THEN 'clip' WHEN has_split THEN 'split' WHEN odd THEN 'discordant' END AS evidence
        FROM w JOIN used ON contig = k AND start < hi AND "end" > lo){_MATES}""")
def evidence_large(spark, d):
    return _evidence(spark, d, "large")


@query(f"""WITH {v.SHORT_READS}, {_PLACES}, {_EVIDENCE}, {_BOTH_ENDS}, m AS (SELECT call_id, side, read_name, is_read1, mate_contig, CASE WHEN clips >= 15 THEN 'clip' WHEN is_paired AND NOT mate_unmapped AND contig <> mate_contig THEN 'discordant' WHEN has_split THEN 'split' END AS evidence
        FROM w JOIN used ON contig = k AND start < hi AND "end" > lo){_MATES}""")
def evidence_bnd(spark, d):
    return _evidence(spark, d, "bnd")


@query(f"""WITH {v.SHORT_READS}, a AS (SELECT *, CASE form WHEN 0 THEN clip ELSE 0 END AS aqs, CASE form WHEN 0 THEN clip + 120 ELSE 120 END AS aqe, CASE form WHEN 1 THEN clip ELSE 0 END AS acr, CAST(substr(sa_contig, 4) AS INTEGER) AS cn FROM sr WHERE sa_contig IS NOT NULL AND sa_mapq >= 20
    ), b AS (SELECT *, least(aqe, 30) - greatest(aqs, 0) AS shared, greatest(0, greatest(start, mate_start) - least("end", mate_start + 30)) AS apart FROM a
    ), k AS (SELECT *, CASE form WHEN 1 THEN "end" ELSE start END AS p1, mate_start + 30 AS p2 FROM b
        WHERE cn <= 22 AND (abs(aqe - 0) <= 10 OR abs(30 - aqs) <= 10 OR (shared <= 20 AND -shared <= 20)) AND (aqe - aqs) + 30 <= 120 + 30 AND (NOT (contig = sa_contig AND apart <= 1000) OR greatest(aqs, acr, 90) >= 8))
    SELECT ord, start, mapq, 'SPLIT' AS evidence_type, contig AS bp1_contig, greatest(0, p1 - 100) AS bp1_begin, least(300000, p1 + 100) AS bp1_end, CASE form WHEN 1 THEN 'SVBEND_RIGHT_OPEN' ELSE 'SVBEND_LEFT_OPEN' END AS bp1_state,
        sa_contig AS bp2_contig, greatest(0, p2 - 100) AS bp2_begin, least(300000, p2 + 100) AS bp2_end, 'SVBEND_RIGHT_OPEN' AS bp2_state FROM k""")
def split_breakends(spark, d):
    names = [f"bp{i}_{f}" for i in (1, 2) for f in ("contig", "begin", "end", "state")]
    return shortreads.split_candidates(v.short_reads(spark, d), v.contigs(spark, d)).select("ord", "start", "mapq", "evidence_type", *names)


# --- base depth of reads near calls ------------------------------------------------------------------------

_LAYOUT = """lay AS (SELECT call_id, c1, lo, hi, b AS bin, f + b * 10 AS bin_start, least(f + b * 10 + 10, t) AS bin_end
    FROM (SELECT *, unnest(range(0, CAST(ceil((t - f) / 10.0) AS BIGINT))) AS b FROM (SELECT call_id, c1, least(p1, p2) AS lo, greatest(p1, p2) AS hi, greatest(1, least(p1, p2) - 2000) AS f, greatest(p1, p2) + 2001 AS t FROM pl)))"""
_GOOD = """base AS (SELECT contig, start + r + 1 AS position, count(*) AS depth FROM (
        SELECT contig, start, i AS r, CASE form WHEN 0 THEN clip + i ELSE i END AS q FROM (SELECT *, unnest(range(0, 120)) AS i FROM sr WHERE form < 2 AND NOT (is_secondary OR is_duplicate OR is_qcfail))
        UNION ALL SELECT contig, start, CASE WHEN i < 60 THEN i ELSE i + 45 END, i FROM (SELECT *, unnest(range(0, 120)) AS i FROM sr WHERE form = 2 AND NOT (is_secondary OR is_duplicate OR is_qcfail)))
    WHERE q % 5 <> 4 AND q % 3 <> 1 GROUP BY ALL)"""


@query(f"""WITH {v.SHORT_READS}, {_PLACES}, {_LAYOUT}, {_GOOD}, s AS (SELECT call_id, bin, sum(depth) AS total FROM lay JOIN base ON contig = c1 AND position >= bin_start AND position < bin_end GROUP BY ALL)
    SELECT call_id, c1 AS contig, bin, bin_start, bin_end, bin_start + (bin_end - bin_start) // 2 AS mid, CASE WHEN bin_start + (bin_end - bin_start) // 2 BETWEEN lo AND hi THEN 'target' WHEN bin_start + (bin_end - bin_start) // 2 < lo THEN 'up' ELSE 'down' END AS region,
        floor(coalesce(total, 0) / (bin_end - bin_start) * 1000000 + 0.5) / 1000000.0 AS cov FROM lay LEFT JOIN s USING (call_id, bin)""")
def binned_coverage(spark, d):
    # every fifth base is unknown, every third of poor quality
    n = F.lit(60)
    reads = v.short_reads(spark, d).withColumns({"seq": F.expr("repeat('ACGTN', 40)"), "qual": F.repeat(F.lit("I!I"), n)})
    rows = germline.binned_depth(_some_calls(spark, d), reads, "call_id")
    return rows.select("call_id", "contig", "bin", "bin_start", "bin_end", "mid", "region", _r6("cov").alias("cov"))


@query(f"""WITH k AS (SELECT DISTINCT kmer FROM (SELECT {_LONG} FROM (SELECT {_LETTERS} AS t FROM benchmark)) WHERE kmer NOT LIKE '%N%'), d AS (SELECT DISTINCT row FROM (SELECT row, {_LONG} FROM (SELECT doc_id AS row, {_LETTERS} AS t FROM documents)) JOIN k USING (kmer))
    SELECT doc_id, doc_id IN (SELECT row FROM d) AS shares FROM documents""")
def insertion_shares(spark, d):
    # a document stands for an inserted sequence; the k-mers of the calls are a bounded list
    known = kmers.reference_kmers(v.table(spark, d, "benchmark"), [], "text", DEFAULT.k_insert)
    docs = v.table(spark, d, "documents")
    shared = kmers.shared_kmers(docs, ["doc_id"], "text", known, DEFAULT.k_insert)
    return docs.select("doc_id").join(shared, "doc_id", "left").select("doc_id", c("n_shared").isNotNull().alias("shares"))


@query(f"""WITH {_CALLS}, t AS (SELECT start_chr, cluster, sample, count(DISTINCT read_name) AS n FROM cl GROUP BY ALL
    ), r AS (SELECT call_id, start_chr, cluster, 'tumor' AS sample, tumor_reads AS called_reads FROM calls UNION ALL SELECT call_id, start_chr, cluster, 'normal', normal_reads FROM calls)
    SELECT call_id, sample, called_reads, coalesce(n, 0) AS cluster_reads, called_reads <> coalesce(n, 0) AS differs FROM r LEFT JOIN t USING (start_chr, cluster, sample)""")
def read_count_report(spark, d):
    counts = [f"{s}_reads" for s in depth.SAMPLES] + [f"clustered_{s}" for s in depth.SAMPLES]
    return depth.read_count_report(_keyed(calling.reported_calls(_called(spark, d), [*_KEYED, *counts])))


@query(f"""WITH wide_stats AS ({ORACLES['cluster_stats_full']}) SELECT start_chr, cluster, array_to_string([
        format('Total Breakpoints: {{}}', total_breakpoints), format('Samples: {{}} (n={{}})', replace(sample_list, ',', ', '), unique_samples), format('Sources: {{}} (n={{}})', replace(source_list, ',', ', '), unique_sources),
        format('Range: {{:,}} - {{:,}} bp', starts_min, starts_max), format('Position Mean ± SD: {{:,.1f}} ± {{:,.1f}} bp', starts_mean, starts_std_dev), format('Span: {{:,}} bp', cluster_span),
        format('MAPQ Mean ± SD: {{:,.1f}} ± {{:,.1f}}', mapq_mean, mapq_std_dev), format('MAPQ Range: {{}} - {{}}', mapq_min, mapq_max),
        format('Event Size Mean ± SD: {{:,.1f}} ± {{:,.1f}} bp', event_size_mean, event_size_std_dev), format('Event Size Median: {{:,.1f}} bp', event_size_median),
        format('Dominant Type: {{}}: {{}}', dominant_notation, dominant_count), format('Unique Reads: {{}}', tumor_reads + normal_reads), format('Density: {{:,.2f}} breakpoints/kb', breakpoint_density)], chr(10)) AS summary FROM wide_stats""")
def cluster_summary(spark, d):
    return clustering.summary_lines(clustering.comprehensive_statistics(_clustered(spark, d))).select("start_chr", "cluster", "summary")


# --- small parts of reads and filters ---------------------------------------------------------------------


@query(f"WITH {v.SHORT_READS} SELECT ord, start, cigar, CASE form WHEN 0 THEN clip || 'M120M' WHEN 1 THEN '120M' || clip || 'M' ELSE cigar END AS matched FROM sr")
def matched_edges(spark, d):
    ops = shortreads.matchify(cigar.operations(c("cigar")))
    text_ = F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")
    return v.short_reads(spark, d).select("ord", "start", "cigar", text_.alias("matched"))


_EDGE = """e AS (SELECT p_partkey, translate(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 24), '0123456789abcdef', 'ACGTACGTACGTACNN') AS a, translate(substr(md5(CAST(p_partkey + 7 AS VARCHAR)), 1, 20 + p_partkey % 5), '0123456789abcdef', 'acgtacgtacgtacNN') AS b FROM part)"""


@query(f"""WITH {_EDGE} SELECT p_partkey, coalesce(list_min(list_filter(range(0, least(length(a), length(b)) - 4), lambda s: len(list_filter(range(1, 6), lambda j: substr(a, s + j, 1) = 'N' OR substr(b, s + j, 1) = 'N' OR upper(substr(a, s + j, 1)) = upper(substr(b, s + j, 1)))) = 5)), -1) AS mismatch FROM e""")
def edge_mismatches(spark, d):
    letters = lambda k, n, to: F.translate(F.substring(F.md5(k.cast("string").cast("binary")), F.lit(1), n), "0123456789abcdef", to)
    rows = v.table(spark, d, "part").select("p_partkey", letters(c("p_partkey"), F.lit(24), "ACGTACGTACGTACNN").alias("a"), letters(c("p_partkey") + 7, (20 + c("p_partkey") % 5).cast("int"), "acgtacgtacgtacNN").alias("b"))
    return rows.select("p_partkey", shortreads.edge_mismatch(c("a"), c("b")).cast("bigint").alias("mismatch"))


@query("SELECT s_suppkey, s_suppkey * 3 > 100 AND s_suppkey % 70 > 50 AS strict FROM supplier")
def strict_choice(spark, d):
    rows = v.table(spark, d, "supplier").select("s_suppkey", (c("s_suppkey") * 3).alias("total_variants"), (c("s_suppkey") % 70).alias("mapq_median"))
    return somatic.strict_by_statistics(rows, 40.0).select("s_suppkey", "strict")


@query("SELECT o_orderkey, least(o_orderkey * 7 % 1000, o_custkey) AS low, greatest(o_orderkey * 7 % 1000, o_custkey) AS high FROM orders")
def ordered_coordinates(spark, d):
    low, high = x.ordered(c("o_orderkey") * 7 % 1000, c("o_custkey"))
    return v.table(spark, d, "orders").select("o_orderkey", low.alias("low"), high.alias("high"))


@query(f"WITH {v.SHORT_READS} SELECT ord, start, CASE WHEN NOT (is_supplementary OR is_secondary) THEN ord % 3 END AS haplotype, CASE WHEN NOT (is_supplementary OR is_secondary) THEN ord % 11 END AS phase_set FROM sr")
def read_phasing(spark, d):
    reads = v.short_reads(spark, d).withColumns({"hp": c("ord") % 3, "ps": c("ord") % 11})
    return breakpoints.phasing(reads).select("ord", "start", "haplotype", "phase_set")


_OVERLAPS = """coalesce(is_paired AND NOT mate_unmapped AND contig = mate_contig AND CASE WHEN mate_length IS NOT NULL THEN start < mate_start + mate_length AND mate_start < "end" ELSE (mate_start >= start AND mate_start < "end") OR (mate_start <= start AND start < mate_start + query_length) END, FALSE)"""


@query(f"""WITH {v.SHORT_READS}, f AS (SELECT *, NOT {_OVERLAPS} OR is_supplementary AS free FROM sr WHERE sa_contig IS NULL
    ), k AS (SELECT ord, start, contig, 'leading' AS edge, start - clip + ord % 60 AS spot FROM f WHERE form = 0 AND ord % 60 >= 30 AND (free OR NOT is_reverse)
        UNION ALL SELECT ord, start, contig, 'trailing', "end" + clip - ord % 50 FROM f WHERE form = 1 AND ord % 50 >= 30 AND (free OR is_reverse))
    SELECT ord, start, edge, contig AS bp1_contig, greatest(0, spot - 100) AS bp1_begin, least(300000, spot + 100) AS bp1_end FROM k""")
def semi_aligned_breakends(spark, d):
    # the reference disagrees with so many bases at the edge as the read's number says, then agrees
    reads = v.short_reads(spark, d).withColumn("seq", F.repeat(F.lit("AC"), F.lit(60)))
    edge = lambda sequence, n: F.concat(F.repeat(F.lit("G"), n.cast("int")), F.substring(sequence, (n + 1).cast("int"), F.lit(120)))
    reads = reads.withColumns({"left_reference": edge(c("seq"), c("ord") % 60), "right_reference": edge(F.reverse("seq"), c("ord") % 50)})
    return shortreads.semi_aligned(reads, v.contigs(spark, d)).select("ord", "start", "edge", "bp1_contig", "bp1_begin", "bp1_end")


# --- text sources, written and read back ----------------------------------------------------------------


def _text(lines: DataFrame, name: str) -> str:
    """A folder of text files with the rows of value, in the shared folder."""
    return stored(lines.select("value"), name)


@query(f"""WITH {v.REGIONS} SELECT contig, start, "end", p_size AS cluster_size, p_retailprice / 2 AS mean_pos, 7 AS support_reads_tumor, 0.25::DOUBLE AS strand_ratio_normal
    FROM (SELECT 'chr' || (p_partkey % 24 + 1) AS contig, p_partkey * 97 % 200000 AS start, p_partkey * 97 % 200000 + p_size * 20 AS "end", p_size, p_retailprice, p_partkey FROM part) WHERE p_partkey % 10 > 1""")
def region_file(spark, d):
    # of ten lines one is a comment and one too short
    t = v.table(spark, d, "part")
    start = c("p_partkey") * 97 % 200_000
    fields = [F.concat(F.lit("chr"), (c("p_partkey") % 24 + 1).cast("string")), start.cast("bigint"), (start + c("p_size") * 20).cast("bigint"), c("p_size"), c("p_retailprice") / 2, F.lit("1.5"), F.lit("60"), F.lit("7"), F.lit("0"), F.lit("0.75"), F.lit("0.25")]
    whole = F.concat_ws("\t", *[x.cast("string") for x in fields])
    line = F.when(c("p_partkey") % 10 == 0, F.concat(F.lit("#"), whole)).when(c("p_partkey") % 10 == 1, F.substring_index(whole, "\t", 9)).otherwise(whole)
    rows = text.read_regions(spark, _text(t.select(line.alias("value")), "regions"))
    return rows.select("contig", "start", "end", "cluster_size", "mean_pos", "support_reads_tumor", "strand_ratio_normal")


def _panel_file(spark: SparkSession, d: str) -> str:
    t = v.table(spark, d, "orders")
    start = (c("o_orderkey") * 13) % 200_000
    kind = F.when(c("o_orderkey") % 3 == 0, "CNV").otherwise("DEL")
    af = ((c("o_orderkey") % 100) / 200).cast("string")
    end = (start + F.floor(c("o_totalprice") / 500)).cast("bigint").cast("string")
    info = F.concat(F.lit("SVTYPE="), kind, F.when(kind == "CNV", F.concat(F.lit(";CN_NONREF_FREQ="), af, F.lit(";POSMIN="), start.cast("bigint").cast("string"), F.lit(";ENDMAX="), end)).otherwise(F.concat(F.lit(";AF="), af, F.lit(",0.9;END="), end)), F.lit(";PRECISE"))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), (c("o_custkey") % 24 + 1).cast("string")), start.cast("bigint").cast("string"), c("o_orderkey").cast("string"), F.lit("N"), F.lit("<X>"), F.lit("."), F.lit("PASS"), info)
    head = spark.range(1).select(F.explode(F.array(F.lit('##INFO=<ID=AF,Number=A,Type=Float,Description="f">'), F.lit('##INFO=<ID=END,Number=1,Type=Integer,Description="e">'), F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"))).alias("value"))
    return _text(head.unionByName(t.select(line.alias("value"))), "panel")


_PANEL = """po AS (SELECT 'chr' || (o_custkey % 24 + 1) AS chrom, o_orderkey * 13 % 200000 AS pos, o_orderkey, o_orderkey % 3 = 0 AS cnv, (o_orderkey % 100) / 200.0::DOUBLE AS af, CAST(o_orderkey * 13 % 200000 + floor(o_totalprice / 500) AS BIGINT) AS e FROM orders)"""


@query(f"WITH {_PANEL} SELECT chrom AS chr1, pos AS start, chrom AS chr2, CASE WHEN cnv THEN pos ELSE e END AS \"end\", CASE WHEN cnv THEN 'CNV' ELSE 'DEL' END AS svtype, af FROM po WHERE af >= 0.01")
def panel_file(spark, d):
    return panel.common_variants(text.read_vcf(spark, _panel_file(spark, d)))


@query(f"WITH {_PANEL} SELECT chrom AS chr1, CASE WHEN cnv THEN pos END AS start, chrom AS chr2, CASE WHEN cnv THEN e END AS \"end\", CASE WHEN cnv THEN 'CNV' ELSE 'DEL' END AS svtype FROM po")
def panel_copy_numbers(spark, d):
    return panel.common_copy_numbers(text.read_vcf(spark, _panel_file(spark, d)))


@query("SELECT 'AF' AS field UNION ALL SELECT 'END'")
def info_fields(spark, d):
    return spark.createDataFrame([(x,) for x in text.info_fields(spark, _panel_file(spark, d))], "field string")


@query("SELECT p_partkey, list_filter([CAST(p_size AS VARCHAR), '', CAST(p_partkey % 7 AS VARCHAR)], lambda x: x <> '') AS numbers FROM part")
def haplotype_numbers(spark, d):
    return v.table(spark, d, "part").select("p_partkey", text.numbers_in(F.concat_ws(",", c("p_size").cast("string"), F.lit(""), (c("p_partkey") % 7).cast("string"), F.lit(""))).alias("numbers"))


@query("SELECT '@contig_' || item_id || '_span_0' || chr(10) || text || chr(10) || '+' || chr(10) || repeat('I', length(text)) AS value FROM benchmark WHERE text IS NOT NULL")
def fastq_records(spark, d):
    rows = v.table(spark, d, "benchmark").where("text is not null")
    return assembly.fastq_lines(rows.select(F.concat(F.lit("contig_"), "item_id", F.lit("_span_0")).alias("contig_name"), c("text").alias("sequence")))


# --- refinement by alignments -------------------------------------------------------------------------------

# ends of one contig in stretches of 2,000 bases; a read is a row of the table
_REFINED = v.READS + """, e AS (
        SELECT DISTINCT contig AS start_chr, start // 2000 AS cluster, 'r' || ord AS read_name, sample, start AS lo, "end" AS hi FROM reads
    ), wide AS (SELECT start_chr, cluster, min(lo) AS lo, max(hi) AS hi FROM e GROUP BY ALL HAVING max(hi) - min(lo) >= 100
    ), met AS (
        SELECT w.start_chr, w.cluster, m.read_name, min({'start': r.start, 'cigar': r.cigar}) AS a FROM wide w JOIN (SELECT DISTINCT start_chr, cluster, read_name FROM e WHERE sample = 'tumor') m USING (start_chr, cluster)
            JOIN reads r ON 'r' || r.ord = m.read_name AND r.contig = w.start_chr AND r.start < w.hi + 500 AND r."end" > w.lo - 500 GROUP BY ALL
    ), cut AS (SELECT start_chr, cluster, read_name, a.start AS s, list_transform(regexp_extract_all(a.cigar, '[0-9]+'), lambda x: CAST(x AS BIGINT)) AS n FROM met
    ), ev AS (SELECT start_chr, cluster, read_name, s + n[2] AS ds, s + n[2] + n[3] AS de, CASE WHEN n[3] >= 2 THEN n[3] END AS dl, s + n[2] + n[3] + n[4] AS i, CASE WHEN n[5] >= 2 THEN n[5] END AS il FROM cut
    ), open_ AS (SELECT start_chr, cluster FROM ev GROUP BY ALL HAVING count(*) FILTER (WHERE dl >= 30 OR il >= 30) >= 2
    ), node AS (SELECT *, (dl IS NOT NULL)::INT + (il IS NOT NULL)::INT AS n FROM ev JOIN open_ USING (start_chr, cluster)
    ), edge AS (
        SELECT a.start_chr, a.cluster, a.read_name AS a, b.read_name AS b FROM node a JOIN node b ON a.start_chr = b.start_chr AND a.cluster = b.cluster AND a.read_name < b.read_name
        WHERE CASE WHEN a.n = 0 AND b.n = 0 THEN TRUE WHEN a.n = 0 OR b.n = 0 THEN FALSE ELSE
            (coalesce(a.dl > 0 AND b.dl > 0 AND abs(a.ds - b.ds) <= 50 AND abs(a.de - b.de) <= 50 AND least(a.dl, b.dl) >= greatest(a.dl, b.dl) * 0.8::DOUBLE, FALSE)::INT
             + coalesce(a.il > 0 AND b.il > 0 AND abs(a.i - b.i) <= 50 AND least(a.il, b.il) >= greatest(a.il, b.il) * 0.8::DOUBLE, FALSE)::INT) / ((a.n + b.n) / 2.0::DOUBLE) >= 0.7::DOUBLE END
    ), linked AS (SELECT * FROM edge UNION ALL SELECT start_chr, cluster, b, a FROM edge
    ), walk AS (SELECT start_chr, cluster, read_name AS a, read_name AS b FROM node UNION SELECT w.start_chr, w.cluster, w.a, e.b FROM walk w JOIN linked e ON w.start_chr = e.start_chr AND w.cluster = e.cluster AND w.b = e.a)"""


@query(f"WITH RECURSIVE {_REFINED} SELECT start_chr, cluster, a AS read_name, min(b) AS part FROM walk GROUP BY ALL")
def refined_parts(spark, d):
    reads = v.reads(spark, d).withColumn("read_name", F.concat(F.lit("r"), "ord"))
    cluster = F.floor(c("start") / 2000).alias("cluster")
    ends = reads.select(c("contig").alias("start_chr"), cluster, "read_name", "sample", c("start").alias("start_loc"), c("end").alias("end_loc"))
    return refinement.alignment_parts(ends, reads, ["start_chr", "cluster"], DEFAULT)


@query("""WITH t AS (SELECT item_id, translate(text, 'abcdefghijklmnopqrstuvwxyzN', 'ABCDEFGHIJKLMTOPQRSTUVWXYZT') AS s FROM benchmark WHERE length(text) >= 120)
    SELECT item_id, CAST(0 AS INTEGER) AS number, s AS sequence, CAST(75 AS INTEGER) AS k FROM t""")
def assembled_contigs(spark, d):
    # reads of 100 letters, one begun every 5 and one at the end, each twice and once more with an error
    letters = F.translate("text", "abcdefghijklmnopqrstuvwxyzN", "ABCDEFGHIJKLMTOPQRSTUVWXYZT")
    items = v.table(spark, d, "benchmark").where(F.length("text") >= 120).select("item_id", letters.alias("s"))
    last = F.length("s") - 99
    starts = items.select("item_id", "s", F.explode(F.array_union(F.sequence(F.lit(1), last, F.lit(5)), F.array(last))).alias("i"), F.explode(F.array(F.lit(0), F.lit(0), F.lit(1))).alias("wrong"))
    exact = F.substring("s", c("i"), F.lit(100))
    seq = F.when(c("wrong") == 1, F.concat(F.substring(exact, 1, 40), F.lit("#"), F.substring(exact, 42, 59))).otherwise(exact)
    return assembly.assemble(starts.select("item_id", seq.alias("seq")), ["item_id"]).select("item_id", "number", "sequence", "k")


_READ_KMERS = """ir AS (SELECT *, upper(substr(repeat(md5('r' || CAST(ord % 40 AS VARCHAR)), 5), 1, 120)) AS seq FROM sr WHERE (form < 2 AND clip >= 10) OR form = 2 OR mapq < 20
    ), met AS (SELECT call_id, seq FROM pl JOIN ir ON contig = c1 AND start < p2 + 200 AND "end" > greatest(0, p1 - 200)
    ), kc AS (SELECT call_id, kmer, count(*) AS n FROM (SELECT call_id, unnest(list_transform(range(1, 91), lambda i: substr(seq, i, 31))) AS kmer FROM met) GROUP BY ALL
    ), ref AS (SELECT DISTINCT call_id, kmer FROM (SELECT call_id, unnest(list_transform(range(1, 35), lambda i: substr(t, i, 31))) AS kmer FROM (SELECT call_id, upper(repeat(md5('r' || CAST(call_id % 40 AS VARCHAR)), 2)) AS t FROM pl))
    ), nr AS (SELECT call_id, count(*) AS n_reads FROM met GROUP BY call_id), nk AS (SELECT call_id, count(*) AS n_kmers FROM ref GROUP BY call_id
    ), j AS (SELECT call_id, n_reads, n_kmers, coalesce(n, 0) AS n FROM ref JOIN nk USING (call_id) JOIN nr USING (call_id) LEFT JOIN kc USING (call_id, kmer)
    ), s AS (SELECT call_id, n_reads, count(*) FILTER (WHERE n >= 3) / n_kmers > 0.85 AS del, count(*) FILTER (WHERE n > n_reads / greatest(100, n_kmers) * 1.5::DOUBLE) / n_kmers > 0.3 AS dup FROM j GROUP BY call_id, n_reads, n_kmers)"""


@query(f"""WITH {v.SHORT_READS}, {_PLACES}, {_READ_KMERS} SELECT call_id, coalesce(n_reads, 0) AS n_reads, coalesce(n_reads >= 2 AND del, FALSE) AS kmer_deletion, coalesce(n_reads >= 2 AND dup, FALSE) AS kmer_duplication FROM pl LEFT JOIN s USING (call_id)""")
def kmer_evidence(spark, d):
    digest = lambda n: F.md5(F.concat(F.lit("r"), (n % 40).cast("string")).cast("binary"))
    reads = v.short_reads(spark, d).withColumn("seq", F.upper(F.substring(F.expr("repeat(md5(cast(concat('r', cast(ord % 40 as string)) as binary)), 5)"), 1, 120)))
    calls = _some_calls(spark, d)
    reference = calls.select("call_id", F.repeat(digest(c("call_id")), F.lit(2)).alias("sequence"))
    return germline.kmer_evidence(calls, reads, reference, "call_id")


_CLIP_KMERS = f"""{v.SHORT_READS}, {_PLACES}, m AS (SELECT call_id, p1, sr.*, upper(substr(repeat(md5('r' || CAST(ord % 40 AS VARCHAR)), 5), 1, 120)) AS seq FROM pl JOIN sr ON sr.contig = c1 AND sr.start < p1 + 500 AND sr."end" > greatest(0, p1 - 500) WHERE {_USABLE} AND (abs(start - p1) <= 100 OR abs("end" - p1) <= 100)
    ), k AS (SELECT call_id, 'l' AS side, clip, substr(seq, 1, clip) AS part FROM m WHERE form = 0 AND clip >= 10 AND start >= p1 - 50 UNION ALL SELECT call_id, 'r', clip, substr(seq, 121 - clip, clip) FROM m WHERE form = 1 AND clip >= 10 AND "end" <= p1 + 50
    ), known AS (SELECT call_id, list_transform(range(1, 45), lambda i: substr(t, i, 21)) AS ks FROM (SELECT call_id, upper(repeat(md5('r' || CAST(call_id % 40 AS VARCHAR)), 2)) AS t FROM pl)
    ), t AS (SELECT call_id, side, list_has_any(list_transform(range(1, greatest(1, length(part) - 19)), lambda i: substr(part, i, 21)), ks) AS shares FROM k JOIN known USING (call_id)
    ), n AS (SELECT call_id, count(*) FILTER (WHERE side = 'l') AS n_left, count(*) FILTER (WHERE side = 'r') AS n_right, count(*) FILTER (WHERE shares) AS n_kmer, count(*) AS n_tested FROM t GROUP BY call_id
    ), cnt AS (SELECT call_id, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right, coalesce(n_kmer, 0) AS n_kmer, coalesce(n_tested, 0) AS n_tested FROM pl LEFT JOIN n USING (call_id)
    ), z AS (SELECT *, CASE WHEN n_kmer / nullif(n_tested, 0) >= 0.5 THEN 4 WHEN n_kmer / nullif(n_tested, 0) >= 0.3 THEN 3 WHEN n_kmer / nullif(n_tested, 0) >= 0.1 THEN 2 ELSE 0 END
        + CASE WHEN n_tested >= 5 THEN 3 WHEN n_tested >= 2 THEN 2 WHEN n_tested >= 1 THEN 1 ELSE 0 END + CASE WHEN n_left > 0 AND n_right > 0 THEN 2 ELSE 0 END AS sc FROM cnt)"""


@query(f"WITH {_CLIP_KMERS} SELECT call_id, n_left, n_right, n_kmer, n_tested, sc AS insertion_score, sc >= 2 AS is_insertion FROM z")
def insertion_kmer_score(spark, d):
    digest = lambda n: F.md5(F.concat(F.lit("r"), (n % 40).cast("string")).cast("binary"))
    reads = v.short_reads(spark, d).withColumn("seq", F.upper(F.substring(F.repeat(digest(c("ord")), F.lit(5)), 1, 120)))
    known = kmers.kmers(F.repeat(digest(c("call_id")), F.lit(2)), DEFAULT.k_insert)
    rows = germline.score_insertion(germline.count_insertion(_some_calls(spark, d), reads, "call_id", F.lit(0), known))
    return rows.select("call_id", "n_left", "n_right", "n_kmer", "n_tested", "insertion_score", "is_insertion")


@query(f"""WITH {v.SHORT_READS}, {_PLACES} SELECT call_id, count(sr.ord) AS n_supplementary, CASE WHEN count(sr.ord) >= 3 THEN 3 WHEN count(sr.ord) >= 1 THEN 2 ELSE 0 END AS points
    FROM pl LEFT JOIN sr ON contig = c1 AND start < p2 + 1000 AND "end" > greatest(0, p1 - 1000) AND is_supplementary AND mapq >= 20 AND ord % 2 = 0 AND contains(sa_contig, contig) GROUP BY call_id""")
def inversion_supplementary(spark, d):
    # tags that name both strands, of every second read
    reads = v.short_reads(spark, d).withColumn("sa", F.when(c("ord") % 2 == 0, F.concat("sa", F.lit("+-"))).otherwise(c("sa")))
    counts = germline.count_inversion(_some_calls(spark, d), reads, "call_id")
    without = germline.score_inversion(counts.withColumns({"n_supplementary": F.lit(0), "total_pairs": F.lit(1)})).select("call_id", c("inversion_score").alias("least"))
    scored = germline.score_inversion(counts.withColumn("total_pairs", F.lit(1))).join(without, "call_id")
    return scored.select("call_id", "n_supplementary", (c("inversion_score") - c("least")).cast("int").alias("points"))


# --- the joined germline filter -----------------------------------------------------------------------------


def _scores_sql(kind: str, g: str) -> str:
    """Score of deletions or duplications by depth, from rows with gradients and p-values, beside genome coverage g."""
    score = {"del": _SCORE_DEL, "dup": _SCORE_DUP}[kind]
    for i in range(3):
        score = score.replace(f"gp = {i}", f"gradient_{kind} = '{_PATTERNS[kind][i]}'")
    return score.replace(" 30", f" {g}")


def _judged_sql(g: str) -> str:
    """judged: both scores of each call, from bins (call_id, bin, region, cov)."""
    return f"""{_depth_sql(g)}{_GRADIENTS}, pat AS (SELECT call_id, {_GRADIENT_DEL} AS gradient_del, {_GRADIENT_DUP} AS gradient_dup FROM g
        ), f AS (SELECT *, {_FREEDOM} FROM ds), pv AS (SELECT *, {_p_sql('t_global', 'df_global')} AS p_global, {_p_sql('t_flank', 'df_flank')} AS p_flank FROM f
        ), full_ AS (SELECT pv.*, coalesce(gradient_del, 'insufficient_data') AS gradient_del, coalesce(gradient_dup, 'insufficient_data') AS gradient_dup FROM pv LEFT JOIN pat USING (call_id)
        ), judged AS (SELECT *, {_scores_sql('del', g)} AS deletion_score, {_scores_sql('dup', g)} AS duplication_score FROM full_)"""


_LAID = "bins AS (SELECT call_id, bin, CASE WHEN bin_start + (bin_end - bin_start) // 2 BETWEEN lo AND hi THEN 'target' WHEN bin_start + (bin_end - bin_start) // 2 < lo THEN 'up' ELSE 'down' END AS region, coalesce(total, 0) / (bin_end - bin_start) AS cov FROM lay LEFT JOIN tot USING (call_id, bin))"
_TOTALS = "tot AS (SELECT call_id, bin, sum(depth) AS total FROM lay JOIN base ON contig = c1 AND position >= bin_start AND position < bin_end GROUP BY ALL)"


@query(f"WITH {v.SHORT_READS}, {_PLACES}, {_LAYOUT}, {_GOOD}, {_TOTALS}, {_LAID}{_judged_sql('0.87::DOUBLE')} SELECT call_id, deletion_score, deletion_score >= 2 AS is_deletion, duplication_score, duplication_score >= 2 AS is_duplication FROM judged")
def depth_evidence(spark, d):
    reads = v.short_reads(spark, d).withColumns({"seq": F.expr("repeat('ACGTN', 40)"), "qual": F.repeat(F.lit("I!I"), F.lit(60))})
    return germline.depth_evidence(_some_calls(spark, d), reads, "call_id", 0.87).select("call_id", "deletion_score", "is_deletion", "duplication_score", "is_duplication")


_GENOME = "(0.2::DOUBLE * 0.8::DOUBLE)"
_LETTER_BASE = """base AS (SELECT contig, start + r + 1 AS position, count(*) AS depth FROM (
        SELECT contig, start, ord, i AS r, CASE form WHEN 0 THEN clip + i ELSE i END AS q FROM (SELECT *, unnest(range(0, 120)) AS i FROM sr WHERE form < 2 AND NOT (is_secondary OR is_duplicate OR is_qcfail))
        UNION ALL SELECT contig, start, ord, CASE WHEN i < 60 THEN i ELSE i + 45 END, i FROM (SELECT *, unnest(range(0, 120)) AS i FROM sr WHERE form = 2 AND NOT (is_secondary OR is_duplicate OR is_qcfail)))
    WHERE substr(upper(substr(repeat(md5('r' || CAST(ord % 40 AS VARCHAR)), 5), 1, 120)), CAST(q + 1 AS BIGINT), 1) IN ('A', 'C') GROUP BY ALL)"""
_ROUTED = """routed AS (SELECT call_id, n_sequences, CASE WHEN c1 <> c2 THEN 'translocation' WHEN call_id % 5 = 0 THEN 'deletion' WHEN call_id % 5 = 1 THEN 'duplication' WHEN call_id % 5 < 4 THEN 'inversion' WHEN n_sequences > 5 THEN 'insertion' ELSE 'unknown' END AS route
    FROM (SELECT *, call_id % 30 + 1 AS n_sequences FROM pl))"""
_GERMLINE = f"""{v.SHORT_READS}, {_PLACES}, {_LAYOUT}, {_LETTER_BASE}, {_TOTALS}, {_LAID}{_judged_sql(_GENOME)}, {_ROUTED}
    , km AS (WITH {v.SHORT_READS}, {_PLACES}, {_READ_KMERS} SELECT call_id, n_reads >= 2 AND del AS kmer_del, n_reads >= 2 AND dup AS kmer_dup FROM s)
    , inv AS (WITH {_INV} SELECT call_id, CASE WHEN total_pairs > 0 THEN sc END AS sc FROM z), bnd AS (WITH {_BND} SELECT call_id, sc FROM z), ins AS (WITH {_ins_sql('call_id % 30 + 1')} SELECT call_id, sc FROM z)
    , evidence AS (
        SELECT r.call_id, route, CAST(CASE route WHEN 'deletion' THEN deletion_score WHEN 'duplication' THEN duplication_score WHEN 'inversion' THEN inv.sc WHEN 'translocation' THEN bnd.sc ELSE ins.sc END AS INTEGER) AS score,
            CASE route WHEN 'deletion' THEN deletion_score >= 2 OR coalesce(kmer_del, FALSE) WHEN 'duplication' THEN duplication_score >= 2 OR coalesce(kmer_dup, FALSE) WHEN 'inversion' THEN coalesce(inv.sc >= 2, FALSE)
                WHEN 'translocation' THEN bnd.sc >= 3 ELSE ins.sc >= 2 END AS is_germline
        FROM routed r JOIN judged USING (call_id) LEFT JOIN km USING (call_id) JOIN inv USING (call_id) JOIN bnd USING (call_id) JOIN ins USING (call_id)
        WHERE route <> 'unknown' AND (route <> 'insertion' OR n_sequences < 21))"""


def _germline_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls of all kinds, reads with letters of which only A and C are bases, and each call's reference sequence."""
    digest = lambda n: F.md5(F.concat(F.lit("r"), (n % 40).cast("string")).cast("binary"))
    notation = F.element_at(F.array(*[F.lit(x) for x in ("+-", "-+", "++", "--", "<INS>")]), (c("call_id") % 5 + 1).cast("int"))
    calls = _some_calls(spark, d).withColumns({"breakpoint_notation": notation, "n_sequences": c("call_id") % 30 + 1})
    reads = v.short_reads(spark, d).withColumn("seq", F.upper(F.substring(F.repeat(digest(c("ord")), F.lit(5)), 1, 120)))
    return calls, reads, calls.select("call_id", F.repeat(digest(c("call_id")), F.lit(2)).alias("sequence"))


@query(f"WITH {_GERMLINE} SELECT * FROM evidence")
def germline_evidence(spark, d):
    return germline.germline_evidence(*_germline_inputs(spark, d), "call_id", 0.2)


@query(f"WITH {_GERMLINE} SELECT call_id, c1 AS start_chr, p1 AS start_loc FROM pl WHERE call_id NOT IN (SELECT call_id FROM evidence WHERE is_germline)")
def germline_filter(spark, d):
    return germline.filter_germline(*_germline_inputs(spark, d), "call_id", 0.2).select("call_id", "start_chr", "start_loc")


@query(f"""WITH {_CALLS}, wide_stats AS ({ORACLES['cluster_stats_full']}), w AS (SELECT start_chr, cluster, COLUMNS(* EXCLUDE (start_chr, cluster)) AS 'start_\\0' FROM wide_stats)
    SELECT calls.call_id, w.* EXCLUDE (start_chr, cluster) FROM calls JOIN w USING (start_chr, cluster)""")
def call_cluster_statistics(spark, d):
    rows = _called(spark, d, "haplotype_start", "haplotype_end", "phase_set_start", "phase_set_end")
    out = calling.reported_calls(rows, _KEYED, wide=True)
    return _keyed(out).select("call_id", *[x for x in out.columns if x not in _KEYED]).withColumn("start_phase_sets_count", c("start_phase_sets_count").cast("bigint"))


# --- similarity and components -----------------------------------------------------------------------------

_EV = """ev AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(struct_pack(s := l_partkey * 100 % 3000, e := l_partkey * 100 % 3000 + CAST(l_quantity AS BIGINT), n := CAST(l_quantity AS BIGINT))))) AS dels
    FROM lineitem GROUP BY l_orderkey)"""


@query(f"""WITH {_EV}, p AS (SELECT a.k AS a, b.k AS b, len(list_filter(a.dels, lambda x: len(list_filter(b.dels, lambda y: abs(x.s - y.s) <= 50 AND abs(x.e - y.e) <= 50 AND greatest(x.n, y.n) > 0 AND least(x.n, y.n) >= greatest(x.n, y.n) * 0.8::DOUBLE)) > 0)) AS m,
        len(a.dels) AS na, len(b.dels) AS nb FROM ev a JOIN ev b ON a.k // 8 = b.k // 8 AND a.k < b.k)
    SELECT a, b, floor(least(1.0, m / ((na + nb) / 2.0::DOUBLE)) * 1000000 + 0.5) / 1000000.0 AS similarity FROM p""")
def cigar_similarity(spark, d):
    # an order stands for a read with its lines as deletions, eight neighbours for a cluster
    q = c("l_quantity").cast("bigint")
    event = F.struct((c("l_partkey") * 100 % 3000).alias("start"), (c("l_partkey") * 100 % 3000 + q).alias("end"), q.alias("len"))
    e = v.table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set(event)).alias("dels")).withColumn("cluster", F.floor(c("k") / 8))
    a, b = e.select("cluster", c("k").alias("a"), c("dels").alias("da")), e.select("cluster", c("k").alias("b"), c("dels").alias("db"))
    none = F.filter(c("da"), lambda _: F.lit(False))
    return a.join(b, "cluster").where("a < b").select("a", "b", _r6(cigar.similarity(c("da"), none, c("db"), none)).alias("similarity"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey AS u, o_orderkey + o_custkey % 2 AS v FROM orders
    ), both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e
    ), walk AS (SELECT u AS node, u AS seen FROM both_ways UNION SELECT walk.node, b.v FROM walk JOIN both_ways b ON walk.seen = b.u)
    SELECT node, min(seen) AS root FROM walk GROUP BY node""")
def connected_components(spark, d):
    from strandloom.operators.components import components

    return components(v.table(spark, d, "orders").select(c("o_orderkey").alias("u"), (c("o_orderkey") + c("o_custkey") % 2).alias("v")).distinct())


# --- variant text ------------------------------------------------------------------------------------------

_ALT1 = """CASE breakpoint_notation WHEN '<INS>' THEN '<INS>' WHEN '++' THEN 'A]' || end_chr || ':' || end_loc || ']' WHEN '+-' THEN 'A[' || end_chr || ':' || end_loc || '[' WHEN '-+' THEN ']' || end_chr || ':' || end_loc || ']A' ELSE '[' || end_chr || ':' || end_loc || '[A' END"""
_ALT2 = """CASE breakpoint_notation WHEN '++' THEN 'C]' || start_chr || ':' || start_loc || ']' WHEN '+-' THEN ']' || start_chr || ':' || start_loc || ']C' WHEN '-+' THEN 'C[' || start_chr || ':' || start_loc || '[' WHEN '--' THEN '[' || start_chr || ':' || start_loc || '[C' END"""


@query(f"WITH {_CALLS} SELECT call_id, {_ALT1} AS alt_1, {_ALT2} AS alt_2 FROM calls")
def vcf_alt(spark, d):
    first, second = variants.alt_alleles(F.lit("A"), F.lit("C"))
    return _calls(spark, d).select("call_id", first.alias("alt_1"), second.alias("alt_2"))


def _info_sql() -> str:
    pair = lambda name, a, b: f"'{name}=' || {a} || ',' || {b}"
    items = ["'SVTYPE=' || CASE breakpoint_notation WHEN '<INS>' THEN 'INS' ELSE 'BND' END"]
    items += [f"'{s.upper()}_{n}_SUPPORT=' || {s}_{f}" for n, f in (("READ", "reads"), ("ALN", "alignments")) for s in ("normal", "tumor")]
    items.append("'SVLEN=' || sv_length")
    items += [pair(f"{s.upper()}_DP_{p.upper()}", f"dp_{s}_{p}_start", f"dp_{s}_{p}_end") for s in ("tumor", "normal") for p in ("before", "at", "after")]
    items += [pair(f"{s.upper()}_AF", f"CAST(af_{s}_start AS DOUBLE)", f"CAST(af_{s}_end AS DOUBLE)") for s in ("tumor", "normal")]
    items += ["'BP_NOTATION=' || breakpoint_notation", "'SOURCE=' || source", "'CLUSTERED_READS_TUMOR=' || clustered_tumor", "'CLUSTERED_READS_NORMAL=' || clustered_normal"]
    items += ["'TUMOR_ALT_HP=0,0,' || tumor_alignments", "'NORMAL_ALT_HP=0,0,' || normal_alignments", "'TUMOR_TOTAL_HP_AT=' || hp_tumor_end", "'NORMAL_TOTAL_HP_AT=' || hp_normal_end"]
    names = ("starts_std_dev", "mapq_mean", "event_size_std_dev", "event_size_median", "event_size_mean")
    items += [f"'{e.upper()}_{n.upper()}=' || CAST({e}_{n} AS DOUBLE)" for e in ("origin", "end") for n in names]
    return f"concat_ws(';', {', '.join(items)})"


@query(f"""WITH {_ANNOTATED}, n AS (SELECT *, row_number() OVER (ORDER BY start_chr, cluster, call_id) - 1 AS count, {_info_sql()} AS info FROM ann
    ), l AS (SELECT count, 1 AS n, start_chr AS chrom, start_loc AS pos, {_ALT1} AS alt, info, normal_reads FROM n UNION ALL SELECT count, 2, end_chr, end_loc, {_ALT2}, info, normal_reads FROM n WHERE breakpoint_notation <> '<INS>')
    SELECT count, n, chrom || chr(9) || pos || chr(9) || 'ID_' || count || '_' || n || chr(9) || CASE n WHEN 1 THEN 'A' ELSE 'C' END || chr(9) || alt || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || info || chr(9) || 'GT' || chr(9) || CASE WHEN normal_reads >= 1 THEN '0/0' ELSE '0/1' END AS line FROM l""")
def vcf_lines(spark, d):
    calls = settle(_annotated(spark, d), "annotated").withColumns({"start_base": F.lit("A"), "end_base": F.lit("C")})
    calls = ordered.numbered(calls, [c("start_chr"), c("cluster"), c("call_id")], "count")
    return variants.variant_lines(variants.variant_records(calls))


_KINDS = ["<INS>", "+", "-", "++", "+-", "-+", "--"]


@query("""WITH a AS (SELECT o_orderkey, ['<INS>', '+', '-', '++', '+-', '-+', '--'][o_orderkey % 7 + 1] AS n, 'chr' || (o_custkey % 24 + 1) AS sc, o_custkey AS sl, 'chr' || (o_custkey % 5 + 1) AS ec, o_orderkey AS el FROM orders)
    SELECT o_orderkey, CASE n WHEN '<INS>' THEN 'INS' WHEN '+' THEN 'SBND' WHEN '-' THEN 'SBND' ELSE 'BND' END AS sv_type,
        CASE n WHEN '<INS>' THEN n WHEN '+' THEN '.C' WHEN '-' THEN '.C' WHEN '++' THEN 'A]' || ec || ':' || el || ']' WHEN '+-' THEN 'A[' || ec || ':' || el || '[' WHEN '-+' THEN ']' || ec || ':' || el || ']A' ELSE '[' || ec || ':' || el || '[A' END AS alt_1,
        CASE n WHEN '++' THEN 'C]' || sc || ':' || sl || ']' WHEN '+-' THEN ']' || sc || ':' || sl || ']C' WHEN '-+' THEN 'C[' || sc || ':' || sl || '[' WHEN '--' THEN '[' || sc || ':' || sl || '[C' END AS alt_2 FROM a""")
def alt_of_all_kinds(spark, d):
    t = v.table(spark, d, "orders")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (c("o_orderkey") % 7 + 1).cast("int"))
    contig = lambda n: F.concat(F.lit("chr"), (c("o_custkey") % n + 1).cast("string"))
    calls = t.select("o_orderkey", kind.alias("breakpoint_notation"), contig(24).alias("start_chr"), c("o_custkey").alias("start_loc"), contig(5).alias("end_chr"), c("o_orderkey").alias("end_loc"))
    first, second = variants.alt_alleles(F.lit("A"), F.lit("C"))
    return calls.select("o_orderkey", variants.variant_type().alias("sv_type"), first.alias("alt_1"), second.alias("alt_2"))


@query("""WITH i AS (SELECT event_id, 'SVTYPE=' || event_type || ';END=' || event_id || ';PRECISE;AF=' || (event_id % 7) || ',' || (event_id % 5) AS info FROM events)
    SELECT event_id, regexp_extract(info, 'SVTYPE=([^;]*)', 1) AS svtype, CAST(regexp_extract(info, 'END=([^;]*)', 1) AS BIGINT) AS end_pos, 'true' AS precise, regexp_extract(info, 'AF=([^;]*)', 1) AS af FROM i""")
def info_parse(spark, d):
    e = v.table(spark, d, "events")
    info = F.concat(F.lit("SVTYPE="), c("event_type"), F.lit(";END="), c("event_id").cast("string"), F.lit(";PRECISE;AF="), (c("event_id") % 7).cast("string"), F.lit(","), (c("event_id") % 5).cast("string"))
    m = e.select("event_id", text.info_map(info).alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    return m.select("event_id", get("SVTYPE").alias("svtype"), get("END").cast("bigint").alias("end_pos"), get("PRECISE").alias("precise"), get("AF").alias("af"))


@query("SELECT contig, unnest(range(0, 300000, 70000)) AS chunk_start, least(unnest(range(0, 300000, 70000)) + 70000, 300000) AS chunk_end FROM (SELECT DISTINCT 'chr' || (n_nationkey % 24 + 1) AS contig FROM nation)")
def contig_chunks(spark, d):
    return text.contig_chunks(v.contigs(spark, d), 70_000)


@query(f"""WITH {_CALLS}, n AS (SELECT *, row_number() OVER (ORDER BY start_chr, cluster, call_id) - 1 AS count FROM calls
    ), own AS (SELECT count AS k, start_chr AS sc, start_loc + count % 4 * 4000 AS sl, end_chr AS ec, end_loc AS el FROM n WHERE count % 2 = 0)
    SELECT call_id FROM n WHERE NOT EXISTS (SELECT 1 FROM own WHERE k = count AND sc = start_chr AND ec = end_chr AND abs(sl - start_loc) <= 10000 AND abs(el - end_loc) <= 10000)""")
def contig_antijoin(spark, d):
    calls = ordered.numbered(_calls(spark, d), [c("start_chr"), c("cluster"), c("call_id")], "count")
    own = calls.where("count % 2 = 0").select(F.concat(F.lit("contig_"), c("count").cast("string"), F.lit("_DEL_0")).alias("read_name"), "start_chr", (c("start_loc") + c("count") % 4 * 4000).alias("start_loc"), "end_chr", "end_loc")
    return assembly.drop_explained(calls, own).select("call_id")


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN 0.0 WHEN p_size >= 40 THEN 1.0 ELSE (p_size - 10) / 30.0::DOUBLE END AS scaled, coalesce(TRY_CAST(p_size || '.7' AS DOUBLE), 0.0) AS as_float, coalesce(CAST(trunc(TRY_CAST(p_name AS DOUBLE)) AS BIGINT), 0) AS as_int FROM part")
def lenient_casts(spark, d):
    t = v.table(spark, d, "part")
    return t.select("p_partkey", x.scale(c("p_size"), 10.0, 40.0).alias("scaled"), x.as_float(F.concat(c("p_size").cast("string"), F.lit(".7"))).alias("as_float"), x.as_int(c("p_name")).alias("as_int"))
