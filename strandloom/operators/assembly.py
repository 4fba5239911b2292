"""Local assembly around calls: reads that speak for a call, contigs from their k-mers, and removal of calls that contigs explain.

Contigs are paths of a de Bruijn graph, built for all calls at once as rows of k-mers: of the k-mers that go on from a
place only the most frequent is followed, and only if none leads to the same place more often, so errors and the lesser
side of a bubble fall away and what is left are paths without branches. Places in a path come from pointers that double
their reach each round, so its length costs rounds in proportion to its logarithm. The rows of a call are never put
together in one task, until a path's letters are joined to its contig.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import kmers
from strandloom.operators.shortreads import evidence_spans, mate_spans, mates_of, supporting_reads
from strandloom.operators.stages import settle

c = F.col
#: A call shorter than this is searched as one span.
SMALL = 10_000
#: Lengths of k-mers that are tried, the contigs kept of a call's side, and how often a k-mer must occur.
KS, MOST_CONTIGS, LEAST = (35, 45, 55, 65, 75), 10, 2
#: Letters of a seed that places contigs, seeds that a line must have, and the least shift between two lines.
SEED, SEEDS, SHIFT = 25, 10, 30


def evidence_kind() -> Column:
    """Which reads a call is assembled from, or null."""
    one, n = c("start_chr") == c("end_chr"), c("breakpoint_notation")
    size = F.abs(c("end_loc") - c("start_loc"))
    return F.when(~one, "bnd").when(n.isin("+-", "-+", "++", "--"), F.when(size < SMALL, "small").otherwise("large"))


def _margin(kind: str) -> int | Column:
    size = F.abs(c("end_loc") - c("start_loc"))
    return F.when(size < 500, 500).otherwise(size + 500) if kind == "small" else 1000


def read_spans(calls: DataFrame, key: str) -> DataFrame:
    """(contig, low, high): where the reads of calls lie."""
    parts = [evidence_spans(calls.where(evidence_kind() == kind), key, kind, _margin(kind)) for kind in ("small", "large", "bnd")]
    spans = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return spans.select(c("span_contig").alias("contig"), c("lo").alias("low"), c("hi").alias("high"))


def assembly_reads(calls: DataFrame, reads: DataFrame, key: str, least_mapq: int = 0, mates: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, side, seq) of the reads that speak for a call, each call by its kind, and of the mates of the discordant ones.

    mates: gives the reads at spans (contig, low, high), where mates may lie; without it they are looked for in reads.
    """
    found = None
    for kind in ("small", "large", "bnd"):
        part = supporting_reads(calls.where(evidence_kind() == kind), reads, key, kind, _margin(kind), least_mapq, 500 if kind == "small" else 750)
        part = part.select("call_key", "side", "read_name", "evidence", "seq", "is_read1", "mate_contig", "mate_start")
        found = part if found is None else found.unionByName(part)
    found = settle(found, "assembly-reads")
    more = mates_of(found, reads if mates is None else mates(mate_spans(found)))
    return found.select("call_key", "side", "seq").unionByName(more.select("call_key", "side", "seq")).withColumnRenamed("call_key", key)


def _best_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (keys, kmer, n, tail, head) that are the most frequent from their tail and to their head; ties: the least."""
    order = [c("n").desc(), "kmer"]
    ranked = edges.withColumn("out", F.row_number().over(Window.partitionBy(*keys, "tail").orderBy(*order)))
    ranked = ranked.withColumn("into", F.row_number().over(Window.partitionBy(*keys, "head").orderBy(*order)))
    return ranked.where("out = 1 and into = 1").drop("out", "into")


def _ranked(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kmer, before) -> (keys, kmer, first, place): where the chain of 'before' begins, and how far back that is.

    A chain without a beginning (a cycle) begins at its least k-mer.
    """
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    rows = settle(links.select(*keys, "kmer", c("before").alias("to"), F.when(c("before").isNull(), c("kmer")).alias("first"), F.when(c("before").isNull(), 0).otherwise(1).alias("place"), c("kmer").alias("least")), "chains")
    open_, reach = rows.where("first is null").count(), 1
    longest = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while open_ and reach < longest:
        b = rows.select(*keys, "kmer", c("to").alias("next"), c("first").alias("found"), c("place").alias("more"), c("least").alias("low"))
        met = rows.alias("a").join(b.alias("b"), [*same, c("a.to") == c("b.kmer")], "left")
        rows = settle(met.select(*[c(f"a.{k}") for k in keys], c("a.kmer"), c("next").alias("to"), F.coalesce("first", "found").alias("first"), (c("place") + F.coalesce("more", F.lit(0))).alias("place"), F.least("least", "low").alias("least")), "chains")
        open_, reach = rows.where("first is null").count(), reach * 2
    if not open_:
        return rows.select(*keys, "kmer", "first", "place")
    # what is left are cycles, and every k-mer of one knows its least: it is cut there
    cycles = rows.where("first is null").select(*keys, "kmer", c("least").alias("cut"))
    back = links.join(cycles, [*keys, "kmer"]).select(*keys, "kmer", F.when(c("kmer") != c("cut"), c("before")).alias("before"))
    return rows.where("first is not null").select(*keys, "kmer", "first", "place").unionByName(_ranked(back, keys))


def paths(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kmer, n) -> (keys, sequence, depth): the sequences of unbranched paths of k-mers and their mean count."""
    size = F.length("kmer")
    edges = counts.select(*keys, "kmer", "n", F.substring("kmer", F.lit(1), size - 1).alias("tail"), F.substring("kmer", F.lit(2), size - 1).alias("head"))
    edges = settle(_best_edges(edges, keys), "edges")
    into = edges.select(*keys, c("head").alias("tail"), c("kmer").alias("before"))
    links = settle(edges.join(into, [*keys, "tail"], "left").select(*keys, "kmer", "before"), "links")
    placed = edges.join(_ranked(links, keys), [*keys, "kmer"])
    letters = F.array_sort(F.collect_list(F.struct("place", F.substring("kmer", F.length("kmer"), F.lit(1)).alias("letter"))))
    out = placed.groupBy(*keys, "first").agg(letters.alias("letters"), F.avg("n").alias("depth"))
    tail = F.array_join(F.transform("letters", lambda x: x["letter"]), "")
    return out.select(*keys, F.concat(F.substring("first", F.lit(1), F.length("first") - 1), tail).alias("sequence"), "depth")


def assemble(reads: DataFrame, keys: list[str], ks: tuple[int, ...] = KS, most: int = MOST_CONTIGS, least: int = LEAST) -> DataFrame:
    """(keys, seq) -> (keys, number, sequence, k, depth): contigs of each group of reads, longest first, at most so many.

    Of the lengths of k-mers the one counts that gives the group's longest contig (ties: the longest k-mers). Reads are
    taken in the direction in which they are given. Groups without a k-mer that occurs often enough give no contig.
    """
    counted = None
    for k in ks:
        part = kmers.kmer_counts(reads, keys, "seq", k).where(c("n") >= least).withColumn("k", F.lit(k))
        counted = part if counted is None else counted.unionByName(part)
    found = paths(settle(counted, "kmers"), [*keys, "k"])
    sized = settle(found.withColumn("size", F.length("sequence")), "contigs")
    best = sized.groupBy(*keys).agg(F.max(F.struct("size", "k"))["k"].alias("k"))
    order = Window.partitionBy(*keys).orderBy(c("size").desc(), "sequence")
    ranked = sized.join(best, [*keys, "k"]).withColumn("number", F.row_number().over(order) - 1)
    return ranked.where(c("number") < most).select(*keys, "number", "sequence", "k", "depth")


def named(contigs: DataFrame, key: str) -> DataFrame:
    """Contigs of (key, side) with contig_name, in which the call's number stands."""
    return contigs.withColumn("contig_name", F.concat_ws("_", F.lit("contig"), key, "side", "number"))


def call_windows(calls: DataFrame, key: str, margin: int = 1000) -> DataFrame:
    """(key, contig, low, high): the surroundings of each call's ends, half-open; one window if they would meet."""
    at = lambda contig, low, high: F.struct(contig.alias("contig"), F.greatest(F.lit(0), low - margin).cast("bigint").alias("low"), (high + margin).cast("bigint").alias("high"))
    low, high = F.least("start_loc", "end_loc"), F.greatest("start_loc", "end_loc")
    near = (c("start_chr") == c("end_chr")) & (high - low <= 2 * margin)
    both = F.array(at(c("start_chr"), c("start_loc"), c("start_loc")), at(c("end_chr"), c("end_loc"), c("end_loc")))
    return calls.select(key, F.explode(F.when(near, F.array(at(c("start_chr"), low, high))).otherwise(both)).alias("w")).select(key, "w.*")


def _complement(sequence: Column) -> Column:
    return F.reverse(F.translate(F.upper(sequence), "ACGT", "TGCA"))


def _seeds(rows: DataFrame, columns: list[str], seed: int) -> DataFrame:
    """Rows with a sequence -> (columns, at, kmer) of each place of it."""
    cut = rows.where(F.length("sequence") >= seed).select(*columns, F.upper("sequence").alias("s"), F.explode(F.sequence(F.lit(1), F.length("sequence") - seed + 1)).alias("i"))
    return cut.select(*columns, (c("i") - 1).cast("bigint").alias("at"), F.substring("s", c("i"), F.lit(seed)).alias("kmer")).where(~F.contains("kmer", F.lit("N")))


def contig_breakpoints(contigs: DataFrame, reference: DataFrame, key: str, seed: int = SEED, least: int = SEEDS) -> DataFrame:
    """(read_name, start_chr, start_loc, end_chr, end_loc): where a contig goes from one line of the reference to another.

    contigs: (key, contig_name, sequence). reference: (key, contig, offset, sequence), the surroundings of each call's
    ends; windows of a call do not overlap. Seeds that occur at one place only tie a contig to lines: to a contig, a
    strand and a shift. Lines with enough seeds that follow each other along the contig make a breakpoint; each end lies
    where the line's last or first seed does.
    """
    forward = _seeds(reference, [key, "contig", "offset"], seed).select(key, "kmer", "contig", (c("offset") + c("at")).alias("place"), F.lit(1).alias("strand"))
    turned = reference.withColumns({"sequence": _complement(c("sequence")), "last": c("offset") + F.length("sequence") - 1})
    # a place on the reverse strand counts down
    backward = _seeds(turned, [key, "contig", "last"], seed).select(key, "kmer", "contig", (c("last") - c("at")).alias("place"), F.lit(-1).alias("strand"))
    places = forward.unionByName(backward)
    single = places.groupBy(key, "kmer").agg(F.count("*").alias("n"), F.first(F.struct("contig", "place", "strand")).alias("p")).where("n = 1").select(key, "kmer", "p.*")
    met = _seeds(contigs, [key, "contig_name"], seed).join(single, [key, "kmer"])
    lines = met.groupBy("contig_name", "contig", "strand", (c("place") - c("strand") * c("at")).alias("shift")).agg(F.count("*").alias("n"), F.min(F.struct("at", "place")).alias("begin"), F.max(F.struct("at", "place")).alias("end")).where(c("n") >= least)
    order = Window.partitionBy("contig_name").orderBy("begin.at", "end.at", "contig", "strand", "shift")
    follow = lambda name: F.lag(name).over(order)
    pairs = lines.withColumns({"before": follow("contig"), "before_strand": follow("strand"), "before_shift": follow("shift"), "left": follow("end.place")})
    moved = (c("contig") != c("before")) | (c("strand") != c("before_strand")) | (F.abs(c("shift") - c("before_shift")) >= SHIFT)
    ends = pairs.where(c("before").isNotNull() & moved).select("contig_name", F.struct(c("before").alias("chr"), (c("left") + F.when(c("before_strand") > 0, seed).otherwise(-seed)).alias("loc")).alias("a"), F.struct(c("contig").alias("chr"), c("begin.place").alias("loc")).alias("b"))
    # both orders: calls name their ends in canonical order
    both = ends.select("contig_name", "a", "b").unionByName(ends.select("contig_name", c("b").alias("a"), c("a").alias("b")))
    return both.select(c("contig_name").alias("read_name"), c("a.chr").alias("start_chr"), c("a.loc").alias("start_loc"), c("b.chr").alias("end_chr"), c("b.loc").alias("end_loc"))


def fastq_lines(contigs: DataFrame) -> DataFrame:
    """(value): a FASTQ record of each contig, with constant quality."""
    return contigs.select(F.concat_ws("\n", F.concat(F.lit("@"), "contig_name"), "sequence", F.lit("+"), F.expr("repeat('I', length(sequence))")).alias("value"))


def align_contigs(fastq: str, reference: str, output: str, aligner: str = "minimap2", sorter: str = "samtools", preset: str = "asm5") -> str:
    """Align a FASTQ file of contigs by outside programs to a sorted, indexed alignment file, whose path is returned."""
    for program in (aligner, sorter):
        if shutil.which(program) is None:
            raise FileNotFoundError(f"{program} is not installed")
    aligned = subprocess.Popen([aligner, "-ax", preset, reference, fastq], stdout=subprocess.PIPE)
    path = f"{output}.sorted.bam"
    subprocess.run([sorter, "sort", "-o", path, "-"], stdin=aligned.stdout, check=True)
    if aligned.wait():
        raise RuntimeError(f"{aligner} ended with {aligned.returncode}")
    subprocess.run([sorter, "index", path], check=True)
    return path


def drop_explained(calls: DataFrame, contig_breakpoints: DataFrame, key: str = "count", distance: int = 10_000) -> DataFrame:
    """calls without those for which a breakpoint of their own contigs lies near at both ends.

    The call's number stands in the contig's name.
    """
    number = F.regexp_extract("read_name", r"contig_(\d+)_", 1)
    own = contig_breakpoints.where(number != "").select(number.cast("bigint").alias("__n"), F.col("start_chr").alias("__sc"), F.col("start_loc").alias("__sl"), F.col("end_chr").alias("__ec"), F.col("end_loc").alias("__el"))
    near = (F.abs(F.col("start_loc") - F.col("__sl")) <= distance) & (F.abs(F.col("end_loc") - F.col("__el")) <= distance)
    return calls.join(own, (F.col(key) == F.col("__n")) & (F.col("start_chr") == F.col("__sc")) & (F.col("end_chr") == F.col("__ec")) & near, "left_anti")
