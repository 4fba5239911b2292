"""Coverage of samples by haplotype, kept up to date while files of aligned reads arrive.

    python -m jobs.coverage --reads FOLDER --output FOLDER --checkpoint FOLDER [--config FILE]

Sequencing runs deliver reads over weeks; depth annotation and the choice of filters need the coverage so far. A file
stream with a checkpoint takes the files that no earlier run has taken (availableNow, then it ends). Each batch of
files becomes runs of bins of equal depth, which are added to the depths so far:

    FOLDER/depths/turn=0|1/contig=...  the sums after the last two batches, a row for each run of bins, and the batch
    FOLDER/coverage/contig=...         sample, haplotype, bin, depth: the result, written when the stream has ended

The sums of a batch are written to one turn from those of the other, which stay as they are. So a batch that is run
again after a failure starts from the same sums and writes the same rows: no file counts twice. A run without new
files writes the same result again. What a batch costs grows with its reads and with the number of runs, not with all
reads so far. The number of tasks grows with the rows (TASK_ROWS), so that what a task holds does not.

Defined cases: reads without sample, contig or place are left out, as are those of other haplotypes than 1, 2 and none;
a read given twice counts twice; a table without reads gives no rows. Columns come from the SQL expressions of the
config's 'columns'; all others are ignored. READS is a folder or a pattern of files.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, load_config, session, write_partitioned
from strandloom.operators import coverage

c = F.col
#: Rows that a task sorts, about.
TASK_ROWS = 2_000_000
SUMS = "sample string, haplotype int, bin bigint, next_bin bigint, depth bigint, batch bigint, turn int, contig string"
RESULT = "sample string, haplotype int, bin bigint, depth bigint, contig string"
_TYPES = {"sample": "string", "contig": "string", "haplotype": "int", "start": "bigint", "end": "bigint"}


def tasks(spark: SparkSession, rows: int) -> int | None:
    """Partitions of a shuffle of so many rows; None if the session's number is enough."""
    n = -(-rows // TASK_ROWS)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def depths(rows: DataFrame, config: dict, partitions: int | None = None) -> DataFrame:
    """Rows of the reads' table -> runs (sample, contig, haplotype, bin, next_bin, depth) of these reads alone."""
    reads = rows.select(*[F.expr(config["columns"][name]).cast(type_).alias(name) for name, type_ in _TYPES.items()])
    known = reads.where("sample is not null and contig is not null and start is not null and end is not null")
    return coverage.coverage_by_deltas(known, config["bin"], partitions=partitions)


def _sums(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(SUMS).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def last_runs(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The sums after the last batch (before a given one), as runs of bins; None if there is none yet."""
    sums = _sums(spark, path)
    if sums is None:
        return None
    if before is not None:
        sums = sums.where(c("batch") < before)
    last = sums.agg(F.max("batch")).first()[0]
    return None if last is None else sums.where((c("turn") == last % 2) & (c("batch") == last))


def last_sums(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """last_runs with a row for each bin."""
    runs = last_runs(spark, path, before)
    bins = F.explode(F.sequence("bin", c("next_bin") - 1)).alias("bin")
    return None if runs is None else runs.select("sample", "haplotype", bins, "depth", "batch", "turn", "contig")


def add_batch(rows: DataFrame, batch: int, path: str, config: dict) -> None:
    """Add a batch of reads to the sums at path; the same batch may be added again."""
    spark, n = rows.sparkSession, rows.count()
    sums = depths(rows, config, tasks(spark, 2 * n))
    earlier = last_runs(spark, path, batch) if batch else None
    if earlier is not None:
        of_both = 2 * (2 * n + earlier.count())
        sums = coverage.merge_runs(sums, earlier.select(*sums.columns), partitions=tasks(spark, of_both))
    sums = sums.withColumns({"batch": F.lit(batch).cast("bigint"), "turn": F.lit(batch % 2)})
    written = write_partitioned(sums.select("sample", "haplotype", "bin", "next_bin", "depth", "batch", "turn", "contig"), path, ["turn", "contig"], "dynamic")
    LOG.info("batch %d: %d rows read, %d runs have depth", batch, n, written)


def run(spark: SparkSession, reads: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Add the reads of files that are new since the last run with this checkpoint; the whole coverage read back."""
    config = config or load_config("coverage")
    state = f"{output.rstrip('/')}/depths"
    stream = spark.readStream.schema(spark.read.parquet(reads).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(reads)
    writer = stream.writeStream.foreachBatch(lambda rows, batch: add_batch(rows, batch, state, config))
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    LOG.info("took %d batches of new files of %s", sum(p["numInputRows"] > 0 for p in query.recentProgress), reads)
    runs = last_runs(spark, state)
    if runs is None:
        rows = spark.createDataFrame([], RESULT)
    else:
        # a range of places for each task: its rows are those of few contigs, and no more than it can sort
        n = runs.agg(F.sum(c("next_bin") - c("bin"))).first()[0] or 0
        ranges = runs.repartitionByRange(max(1, -(-n // TASK_ROWS)), "contig", "bin")
        rows = coverage.run_bins(ranges).select("sample", "haplotype", "bin", "depth", "contig")
    written = write_partitioned(rows, f"{output.rstrip('/')}/coverage", ["contig"])
    LOG.info("wrote %d rows to %s", written, output)
    return spark.read.schema(RESULT).parquet(f"{output.rstrip('/')}/coverage")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m jobs.coverage", description="Keep the coverage of samples up to date while reads arrive")
    for name, text in (("reads", "folder in which Parquet files of reads arrive, or a pattern of files"), ("output", "folder of sums and result"), ("checkpoint", "folder of the stream's checkpoint")):
        p.add_argument(f"--{name}", required=True, help=text)
    p.add_argument("--config", help="JSON file with entries that differ from jobs/coverage.json")
    a = p.parse_args(args)
    config = load_config("coverage", a.config)
    spark = session("coverage")
    try:
        run(spark, a.reads, a.output, a.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
