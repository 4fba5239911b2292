"""Genomic views of the driver tables: breakpoints, reads, alignments, known variants, regions.

The same definitions stand in SQL beside them, for the queries' checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
NOTATIONS = ["+-", "-+", "++", "--", "<INS>"]
#: Length of every contig of the views, and their number.
CONTIG_LENGTH, N_CONTIGS = 300_000, 24
GENOME = CONTIG_LENGTH * N_CONTIGS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _contig(number):
    return F.concat(F.lit("chr"), (number % N_CONTIGS + 1).cast("string"))


def breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    quantity = c("l_quantity").cast("bigint")
    insert = c("l_orderkey") % 5 == 4
    notation = F.element_at(F.array(*[F.lit(n) for n in NOTATIONS]), (c("l_orderkey") % 5 + 1).cast("int"))
    start = c("l_partkey") * 100 + c("l_linenumber") * 10
    end = F.when(insert, start).otherwise(start + F.floor(c("l_extendedprice") / 100))
    other = (c("l_orderkey") % 7 == 0) & ~insert
    part = lambda x, n: F.when(x % n == 0, None).otherwise((x % n).cast("int"))
    rows = t.select(
        F.concat(F.lit("r"), c("l_orderkey").cast("string")).alias("read_name"),
        F.when(c("l_returnflag") == "R", "normal").otherwise("tumor").alias("sample"),
        _contig(c("l_suppkey")).alias("start_chr"),
        start.cast("bigint").alias("start_loc"),
        F.when(other, _contig(c("l_suppkey") + 1)).otherwise(_contig(c("l_suppkey"))).alias("end_chr"),
        end.cast("bigint").alias("end_loc"),
        notation.alias("breakpoint_notation"),
        F.when(insert, 50 + quantity * 10).otherwise(F.lit(0)).cast("bigint").alias("insert_length"),
        F.when(insert, F.concat(F.lit("S"), quantity.cast("string"))).alias("inserted_sequence"),
        (10 + quantity).cast("int").alias("mapq"),
        F.when(c("l_linenumber") % 2 == 0, "SUPPLEMENTARY").otherwise("CIGAR").alias("source"),
        part(c("l_linenumber"), 3).alias("haplotype_start"),
        part(c("l_linenumber") + 1, 3).alias("haplotype_end"),
        part(c("l_orderkey"), 4).cast("bigint").alias("phase_set_start"),
        part(c("l_orderkey"), 6).cast("bigint").alias("phase_set_end"),
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("ord"),
    )
    near = (c("start_chr") == c("end_chr")) & (F.abs(c("end_loc") - c("start_loc")) <= 150)
    return rows.withColumn("is_nearby_event", near)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long reads with a CIGAR; the haplotype is none for every third."""
    t = table(spark, sf_dir, "lineitem")
    q = c("l_quantity").cast("bigint")
    text = F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in (c("l_linenumber") * 7, "S", q * 100, "M", c("l_partkey") % 120 + 1, "D", q * 50, "M", c("l_suppkey") % 90 + 1, "I500M")])
    start = c("l_partkey") * 100 + c("l_linenumber") * 10
    return t.select(
        F.concat(F.lit("r"), c("l_orderkey").cast("string")).alias("read_name"),
        F.when(c("l_returnflag") == "R", "normal").otherwise("tumor").alias("sample"),
        _contig(c("l_suppkey")).alias("contig"),
        start.cast("bigint").alias("start"),
        (start + q * 20).cast("bigint").alias("end"),
        F.when(c("l_linenumber") % 3 > 0, c("l_linenumber") % 3).cast("int").alias("haplotype"),
        (c("l_linenumber") * 7 + q * 150 + c("l_suppkey") % 90 + 501).cast("bigint").alias("query_length"),
        text.alias("cigar"),
        (10 + q).cast("int").alias("mapq"),
        (c("l_linestatus") == "F").alias("is_reverse"),
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("ord"),
    )


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of a read: the rows of an order, in query order by line."""
    rows = reads(spark, sf_dir).withColumn("line", c("ord") % 8)
    rows = rows.groupBy("read_name", "line").agg(F.max(F.struct("contig", "start", "end", "mapq", "is_reverse")).alias("a"))
    return rows.select(
        "read_name", F.lit("tumor").alias("sample"), c("a.contig").alias("contig"), c("a.start").alias("ref_start"), c("a.end").alias("ref_end"),
        (c("line") * 1000).cast("bigint").alias("query_start"), (c("line") * 1000 + 900).cast("bigint").alias("query_end"),
        c("a.mapq").alias("mapq"), c("a.is_reverse").alias("is_reverse"), (c("line") == 1).alias("is_primary"), c("line").cast("int").alias("ord"),
    )


def split_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with an SA tag of two alignments."""
    q = c("l_quantity").cast("bigint")
    one = F.concat_ws(",", _contig(c("l_suppkey") + 1), (c("l_partkey") * 100).cast("string"), F.when(c("l_linestatus") == "F", "-").otherwise("+"), F.concat((q * 10).cast("string"), F.lit("S"), (q * 30).cast("string"), F.lit("M")), (q % 60).cast("string"), F.lit("1"))
    two = F.concat_ws(",", F.lit("chrUn"), c("l_partkey").cast("string"), F.lit("+"), F.lit("50M"), F.lit("60"), F.lit("0"))
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("r"), c("l_orderkey").cast("string")).alias("read_name"), F.lit("tumor").alias("sample"), F.concat(one, F.lit(";"), two, F.lit(";")).alias("sa"))


def short_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short reads of the normal sample in pairs, with clips and SA tags."""
    t = table(spark, sf_dir, "lineitem")
    q = c("l_quantity").cast("bigint")
    start = c("l_partkey") * 100 + c("l_linenumber") * 10
    clip = (c("l_linenumber") * 6).cast("string")
    text = F.when(c("l_orderkey") % 3 == 0, F.concat(clip, F.lit("S120M"))).when(c("l_orderkey") % 3 == 1, F.concat(F.lit("120M"), clip, F.lit("S"))).otherwise(F.lit("60M45D60M"))
    span = F.when(c("l_orderkey") % 3 == 2, 165).otherwise(120)
    mate = F.when(c("l_orderkey") % 7 == 0, _contig(c("l_suppkey") + 1)).otherwise(_contig(c("l_suppkey")))
    mate_start = start + F.floor(c("l_extendedprice") / 100) * F.when(c("l_linenumber") % 2 == 0, -1).otherwise(1)
    sa = F.when(c("l_partkey") % 5 == 0, F.concat_ws(",", mate, (mate_start + 1).cast("string"), F.lit("+"), F.lit("30M90S"), (q % 60).cast("string"), F.lit("0")))
    return t.select(
        F.concat(F.lit("s"), c("l_orderkey").cast("string")).alias("read_name"), _contig(c("l_suppkey")).alias("contig"), start.cast("bigint").alias("start"), (start + span).cast("bigint").alias("end"),
        (10 + q).cast("int").alias("mapq"), text.alias("cigar"), mate.alias("mate_contig"), mate_start.cast("bigint").alias("mate_start"), (mate_start - start).cast("bigint").alias("template_length"),
        F.lit("ACGTACGTAC").alias("seq"), F.lit(None).cast("string").alias("qual"), F.lit(120).cast("bigint").alias("query_length"), F.concat(sa, F.lit(";")).alias("sa"), F.when(c("l_suppkey") % 2 == 0, "100M").alias("mc"),
        (c("l_orderkey") % 11 > 0).alias("is_paired"), F.lit(False).alias("is_unmapped"), (c("l_orderkey") % 13 == 0).alias("mate_unmapped"), (c("l_linestatus") == "F").alias("is_reverse"),
        (c("l_returnflag") == "A").alias("mate_reverse"), (c("l_linenumber") % 2 == 1).alias("is_read1"), (c("l_orderkey") % 17 == 0).alias("is_secondary"), (c("l_orderkey") % 19 == 0).alias("is_qcfail"),
        (c("l_orderkey") % 23 == 0).alias("is_duplicate"), (c("l_orderkey") % 29 == 0).alias("is_supplementary"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("ord"),
    )


def known_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of common variants in the form of parsed VCF lines."""
    start = (c("o_orderkey") * 13) % 200_000
    info = F.create_map(F.lit("SVTYPE"), F.lit("DEL"), F.lit("AF"), ((c("o_orderkey") % 100) / 200).cast("string"), F.lit("END"), (start + F.floor(c("o_totalprice") / 500)).cast("bigint").cast("string"))
    return table(spark, sf_dir, "orders").select(_contig(c("o_custkey")).alias("chrom"), start.cast("bigint").alias("pos"), info.alias("info"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = c("p_partkey") * 97 % 200_000
    return table(spark, sf_dir, "part").select(_contig(c("p_partkey")).alias("contig"), start.cast("bigint").alias("start"), (start + c("p_size") * 20).cast("bigint").alias("end"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig, length) of the views, one for each remainder of nation's keys."""
    rows = table(spark, sf_dir, "nation").select(_contig(c("n_nationkey")).alias("contig"), F.lit(CONTIG_LENGTH).cast("bigint").alias("length"))
    return rows.distinct()


# --- the same in SQL ---------------------------------------------------------------------------------------

_CASE = "CASE l_orderkey % 5 WHEN 0 THEN '+-' WHEN 1 THEN '-+' WHEN 2 THEN '++' WHEN 3 THEN '--' ELSE '<INS>' END"
BREAKPOINTS = f"""bp0 AS (
    SELECT 'r' || l_orderkey AS read_name, CASE WHEN l_returnflag = 'R' THEN 'normal' ELSE 'tumor' END AS sample,
           'chr' || (l_suppkey % 24 + 1) AS start_chr, CAST(l_partkey * 100 + l_linenumber * 10 AS BIGINT) AS start_loc,
           CASE WHEN l_orderkey % 7 = 0 AND l_orderkey % 5 <> 4 THEN 'chr' || ((l_suppkey + 1) % 24 + 1) ELSE 'chr' || (l_suppkey % 24 + 1) END AS end_chr,
           CAST(l_partkey * 100 + l_linenumber * 10 + CASE WHEN l_orderkey % 5 = 4 THEN 0 ELSE floor(l_extendedprice / 100) END AS BIGINT) AS end_loc,
           {_CASE} AS breakpoint_notation,
           CASE WHEN l_orderkey % 5 = 4 THEN 50 + CAST(l_quantity AS BIGINT) * 10 ELSE 0 END AS insert_length,
           CASE WHEN l_orderkey % 5 = 4 THEN 'S' || CAST(l_quantity AS BIGINT) END AS inserted_sequence,
           CAST(10 + l_quantity AS INTEGER) AS mapq, CASE WHEN l_linenumber % 2 = 0 THEN 'SUPPLEMENTARY' ELSE 'CIGAR' END AS source,
           nullif(l_linenumber % 3, 0) AS haplotype_start, nullif((l_linenumber + 1) % 3, 0) AS haplotype_end,
           nullif(l_orderkey % 4, 0) AS phase_set_start, nullif(l_orderkey % 6, 0) AS phase_set_end, l_orderkey * 8 + l_linenumber AS ord
    FROM lineitem
), bp AS (SELECT *, start_chr = end_chr AND abs(end_loc - start_loc) <= 150 AS is_nearby_event,
                 CASE WHEN breakpoint_notation IN ('<INS>', '+', '-') THEN insert_length WHEN start_chr = end_chr THEN abs(start_loc - end_loc) ELSE 0 END AS event_size FROM bp0)"""
READS = """reads AS (
    SELECT 'r' || l_orderkey AS read_name, CASE WHEN l_returnflag = 'R' THEN 'normal' ELSE 'tumor' END AS sample, 'chr' || (l_suppkey % 24 + 1) AS contig,
           CAST(l_partkey * 100 + l_linenumber * 10 AS BIGINT) AS start, CAST(l_partkey * 100 + l_linenumber * 10 + l_quantity * 20 AS BIGINT) AS "end",
           nullif(l_linenumber % 3, 0) AS haplotype, CAST(l_linenumber * 7 + l_quantity * 150 + l_suppkey % 90 + 501 AS BIGINT) AS query_length,
           (l_linenumber * 7) || 'S' || CAST(l_quantity * 100 AS BIGINT) || 'M' || (l_partkey % 120 + 1) || 'D' || CAST(l_quantity * 50 AS BIGINT) || 'M' || (l_suppkey % 90 + 1) || 'I500M' AS cigar,
           CAST(10 + l_quantity AS INTEGER) AS mapq, l_linestatus = 'F' AS is_reverse, l_orderkey * 8 + l_linenumber AS ord
    FROM lineitem)"""
ALIGNMENTS = READS + """, al0 AS (
    SELECT read_name, ord % 8 AS line, max((contig, start, "end", mapq, is_reverse)) AS a FROM reads GROUP BY ALL
), al AS (SELECT read_name, 'tumor' AS sample, a[1] AS contig, a[2] AS ref_start, a[3] AS ref_end, CAST(line * 1000 AS BIGINT) AS query_start,
                 CAST(line * 1000 + 900 AS BIGINT) AS query_end, a[4] AS mapq, a[5] AS is_reverse, line = 1 AS is_primary, CAST(line AS INTEGER) AS ord FROM al0)"""
SHORT_READS = """sr AS (
    SELECT 's' || l_orderkey AS read_name, 'chr' || (l_suppkey % 24 + 1) AS contig, CAST(l_partkey * 100 + l_linenumber * 10 AS BIGINT) AS start,
           CAST(l_partkey * 100 + l_linenumber * 10 + CASE WHEN l_orderkey % 3 = 2 THEN 165 ELSE 120 END AS BIGINT) AS "end", CAST(10 + l_quantity AS INTEGER) AS mapq,
           CASE l_orderkey % 3 WHEN 0 THEN (l_linenumber * 6) || 'S120M' WHEN 1 THEN '120M' || (l_linenumber * 6) || 'S' ELSE '60M45D60M' END AS cigar,
           'chr' || ((l_suppkey + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 24 + 1) AS mate_contig,
           CAST(l_partkey * 100 + l_linenumber * 10 + floor(l_extendedprice / 100) * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS BIGINT) AS mate_start,
           CAST(floor(l_extendedprice / 100) * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS BIGINT) AS template_length, 120 AS query_length,
           CASE WHEN l_partkey % 5 = 0 THEN 'chr' || ((l_suppkey + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 24 + 1) END AS sa_contig,
           CAST(l_quantity AS BIGINT) % 60 AS sa_mapq, CASE WHEN l_suppkey % 2 = 0 THEN 100 END AS mate_length, l_linenumber * 6 AS clip, l_orderkey % 3 AS form,
           l_orderkey % 11 > 0 AS is_paired, l_orderkey % 13 = 0 AS mate_unmapped, l_linestatus = 'F' AS is_reverse, l_returnflag = 'A' AS mate_reverse,
           l_linenumber % 2 = 1 AS is_read1, l_orderkey % 17 = 0 AS is_secondary, l_orderkey % 19 = 0 AS is_qcfail, l_orderkey % 23 = 0 AS is_duplicate,
           l_orderkey % 29 = 0 AS is_supplementary, l_orderkey * 8 + l_linenumber AS ord
    FROM lineitem)"""
KNOWN = """pon AS (
    SELECT 'chr' || (o_custkey % 24 + 1) AS chr1, o_orderkey * 13 % 200000 AS start, 'chr' || (o_custkey % 24 + 1) AS chr2,
           CAST(o_orderkey * 13 % 200000 + floor(o_totalprice / 500) AS BIGINT) AS "end", 'DEL' AS svtype, (o_orderkey % 100) / 200.0 AS af FROM orders)"""
REGIONS = """bed AS (SELECT 'chr' || (p_partkey % 24 + 1) AS contig, p_partkey * 97 % 200000 AS start, p_partkey * 97 % 200000 + p_size * 20 AS "end" FROM part)"""
CLUSTERED = BREAKPOINTS + """, flagged AS (
    SELECT *, CASE WHEN coalesce(start_loc - max(CASE WHEN is_nearby_event THEN end_loc ELSE start_loc END) OVER (PARTITION BY start_chr ORDER BY start_loc, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1000000)
                   > CASE WHEN breakpoint_notation = '<INS>' THEN 250 ELSE 200 END THEN 1 ELSE 0 END AS opens FROM bp
), numbered AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY start_chr ORDER BY start_loc, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM flagged
), cl AS (SELECT * FROM numbered WHERE (start_chr, cluster) IN (SELECT (start_chr, cluster) FROM numbered GROUP BY start_chr, cluster HAVING count(DISTINCT read_name) >= 2))"""
