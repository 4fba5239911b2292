"""Which target sequences does each library of reads support? A screen by k-mers, over whole tables.

    python -m jobs.kmer_panel --reads READS --targets TARGETS --output FOLDER [--config FILE]

Before calls are reported, the sequence of each event's junction (target) is looked for in the reads of every library
that was sequenced: a library whose reads have enough of its k-mers often enough carries the event. The output has a
row for each library and target that share a k-mer, in Parquet partitioned by library:

    library, target, n_kmers (distinct, of the target), n_seen (of these, in the library's reads), n_supported (seen
    at least 'least' times), n_reads (distinct read ids with one of them), is_match (n_supported / n_kmers > share)

A run replaces the whole output, so it can be repeated after a failure and gives the same rows.

Defined cases: null sequences, sequences shorter than k and k-mers with an N have no k-mers; a null target is left out;
reads without a library form one of their own (null); rows of an equal id are one read, reads without an id none.
Hot libraries and k-mers are added up before each shuffle; the targets' k-mers and their seeds are broadcast up to
kmers.BROADCAST_KMERS, else joined.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, load_config, session, write_partitioned
from strandloom.functions import kmers

c = F.col
SCHEMA = "target string, n_kmers bigint, n_seen bigint, n_supported bigint, n_reads bigint, is_match boolean, library string"


def screen(reads: DataFrame, targets: DataFrame, config: dict) -> DataFrame:
    """(library, id, sequence) and (target, sequence) -> a row for each library and target that share a k-mer."""
    k = config["k"]
    known = kmers.reference_kmers(targets.where("target is not null"), ["target"], "sequence", k)
    found = kmers.wanted_rows(reads, ["library", "id"], "sequence", known, k)
    # one row for each k-mer of a read; all further sums start from these, in one pass over the reads
    of_read = found.groupBy("library", "id", "kmer").agg(F.count("*").alias("n"))
    each = F.array(F.struct(F.lit(True).alias("is_kmer"), c("kmer").alias("value"), "n"), F.struct(F.lit(False).alias("is_kmer"), c("id").alias("value"), "n"))
    parts = of_read.join(known, "kmer").select("library", "target", F.explode(each).alias("e")).groupBy("library", "target", "e.is_kmer", "e.value").agg(F.sum("e.n").alias("n"))
    counts = parts.groupBy("library", "target").agg(
        F.count_if("is_kmer").alias("n_seen"), F.count_if(c("is_kmer") & (c("n") >= config["least"])).alias("n_supported"), F.count_if(~c("is_kmer") & c("value").isNotNull()).alias("n_reads")
    )
    out = counts.join(known.groupBy("target").agg(F.count("*").alias("n_kmers")), "target")
    return out.withColumn("is_match", c("n_supported") / c("n_kmers") > config["share"])


def run(spark: SparkSession, reads: str, targets: str, output: str, config: dict | None = None) -> DataFrame:
    """Screen the reads of one Parquet table for the targets of another; the output read back."""
    config = config or load_config("kmer_panel")
    columns = lambda names, **as_: [c(names[key]).cast("string").alias(name) for key, name in as_.items()]
    read = spark.read.parquet(reads).select(*columns(config["reads"], library="library", id="id", sequence="sequence"))
    known = spark.read.parquet(targets).select(*columns(config["targets"], id="target", sequence="sequence"))
    LOG.info("read %d targets of %s, reads of %s", known.count(), targets, reads)
    written = write_partitioned(screen(read, known, config).select("target", "n_kmers", "n_seen", "n_supported", "n_reads", "is_match", "library"), output, ["library"])
    LOG.info("wrote %d rows to %s", written, output)
    return spark.read.schema(SCHEMA).parquet(output)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m jobs.kmer_panel", description="Screen libraries of reads for target sequences")
    for name, text in (("reads", "Parquet table of reads"), ("targets", "Parquet table of target sequences"), ("output", "folder to write")):
        p.add_argument(f"--{name}", required=True, help=text)
    p.add_argument("--config", help="JSON file with entries that differ from jobs/kmer_panel.json")
    a = p.parse_args(args)
    config = load_config("kmer_panel", a.config)
    spark = session("kmer_panel")
    try:
        out = run(spark, a.reads, a.targets, a.output, config)
        LOG.info("%d matches", out.where("is_match").count())
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
