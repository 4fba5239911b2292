"""The jobs as named queries over the given tables, and the SQL that gives their rows.

Each call works in a new folder below spark.checkpoint.dir and leaves its files there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import coverage, kmer_panel
from strandloom.operators.stages import shared_folder


def job1_kmer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/job1_kmer_panel-{uuid.uuid4().hex}"
    for _ in range(2):
        out = kmer_panel.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{folder}/matches")
    return out


def job2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/job2_coverage-{uuid.uuid4().hex}"
    for _ in range(2):
        # a pattern: the table may be a single file, and a stream's plain path must be a folder
        out = coverage.run(spark, f"{sf_dir}/lineitem.parque[t]", f"{folder}/out", f"{folder}/checkpoint")
    return out


QUERIES = {"job1_kmer_panel": job1_kmer_panel, "job2_coverage": job2_coverage}

ORACLES = {
    "job1_kmer_panel": """
        WITH cut AS (SELECT translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS t, CAST(item_id AS VARCHAR) AS target FROM benchmark
        ), known AS (SELECT DISTINCT target, kmer FROM (SELECT target, unnest(list_transform(range(1, greatest(length(t) - 29, 1)), lambda i: substr(t, i, 31))) AS kmer FROM cut) WHERE kmer NOT LIKE '%N%'
        ), reads AS (SELECT source AS library, CAST(doc_id AS VARCHAR) AS id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS t FROM documents
        ), found AS (SELECT library, id, unnest(list_transform(range(1, greatest(length(t) - 29, 1)), lambda i: substr(t, i, 31))) AS kmer FROM reads
        ), kept AS (SELECT * FROM found WHERE kmer IN (SELECT kmer FROM known)
        ), counts AS (SELECT library, kmer, count(*) AS n FROM kept GROUP BY ALL
        ), seen AS (SELECT library, target, count(*) AS n_seen, count(*) FILTER (WHERE n >= 3) AS n_supported FROM counts JOIN known USING (kmer) GROUP BY ALL
        ), holders AS (SELECT library, target, count(DISTINCT id) AS n_reads FROM kept JOIN known USING (kmer) GROUP BY ALL
        ), sizes AS (SELECT target, count(*) AS n_kmers FROM known GROUP BY ALL)
        SELECT s.target, n_kmers, n_seen, n_supported, n_reads, n_supported / n_kmers > 0.85 AS is_match, s.library
        FROM seen s JOIN holders h ON s.library IS NOT DISTINCT FROM h.library AND s.target = h.target JOIN sizes z ON s.target = z.target
    """,
    "job2_coverage": """
        WITH reads AS (
            SELECT CASE WHEN l_returnflag = 'R' THEN 'normal' ELSE 'tumor' END AS sample, 'chr' || CAST(l_suppkey % 24 + 1 AS VARCHAR) AS contig,
                   CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_linenumber % 3 AS INTEGER) END AS haplotype,
                   l_partkey * 100 + l_linenumber * 10 AS low, l_partkey * 100 + l_linenumber * 10 + CAST(l_quantity AS BIGINT) * 20 AS high
            FROM lineitem
        ), touched AS (SELECT sample, contig, haplotype, unnest(range(low // 100, high // 100 + 1)) AS bin FROM reads)
        SELECT sample, haplotype, bin, count(*) AS depth, contig FROM touched GROUP BY ALL
    """,
}
