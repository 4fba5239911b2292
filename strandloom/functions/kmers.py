"""k-mers of sequences as column expressions and counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bases in the small, middle and large pieces of a sequence: places in a string are found by walking it, so long ones are cut first.
PIECE, MIDDLE, LONG = 128, 1024, 16_384
#: Distinct k-mers that are broadcast at most.
BROADCAST_KMERS = 1_000_000
#: Letters from one seed of a sequence to the next, if k is not small.
SEED_STEP = 8


def upper(sequence: Column) -> Column:
    """Letters a to z in upper case; other characters stay as they are."""
    return F.translate(sequence, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pieces(letters: Column, size: int, k: int) -> Column:
    """A sequence cut to pieces that start every size letters and overlap by k - 1."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(letters) - (k - 1)), F.lit(size))
    return F.transform(starts, lambda i: F.substring(letters, i, F.lit(size + k - 1)))


def kmers(sequence: Column, k: int, distinct: bool = True, amount: str = "N") -> Column:
    """All k-mers of the upper-case sequence without the letter of unknown bases; empty if it is shorter."""

    def inside(p: Column) -> Column:
        places = F.when(F.length(p) >= k, F.sequence(F.lit(1), F.length(p) - (k - 1))).otherwise(F.array().cast("array<int>"))
        every = F.transform(places, lambda i: F.substring(p, i, F.lit(k)))
        return F.when(F.contains(p, F.lit(amount)), F.filter(every, lambda x: ~F.contains(x, F.lit(amount)))).otherwise(every)

    def cut(letters: Column) -> Column:
        return F.flatten(F.transform(_pieces(letters, LONG, k), lambda p: F.flatten(F.transform(_pieces(p, PIECE, k), inside))))

    found = F.coalesce(_once(upper(sequence), cut), F.array().cast("array<string>"))
    return F.array_distinct(found) if distinct else found


def kmer_rows(rows: DataFrame, keys: list[str], sequence: str, k: int, amount: str = "N") -> DataFrame:
    """(keys, kmer): a row for each occurrence in a group's sequences, cut in generated code."""
    short, cut = _cut_pieces(rows, keys, sequence, k)
    placed = short.select(*keys, "__piece", "__bytes", F.explode(F.sequence(F.lit(1), F.length("__piece") - (k - 1))).alias("__at"))
    return placed.select(*keys, cut(k).alias("kmer")).where(~F.contains("kmer", F.lit(amount)))


def _single(letters: Column) -> Column:
    return F.octet_length(letters) == F.length(letters)


def _cut_pieces(rows: DataFrame, keys: list[str], sequence: str, k: int) -> tuple[DataFrame, Callable[[int], Column]]:
    """(keys, __piece, __bytes), pieces that hold each k-mer once, and the letters of a piece from __at on."""
    # single-byte letters have no others in upper case, and upper is the faster one
    letters = F.when(_single(F.col(sequence)), F.upper(sequence)).otherwise(upper(F.col(sequence)))
    letters = rows.select(*keys, letters.alias("__letters")).where(F.length(sequence) >= k)
    long_ = letters.select(*keys, F.explode(_pieces(F.col("__letters"), LONG, k)).alias("__long"))
    # in a piece of single-byte letters a place in bytes is the place in letters, and nothing is walked or cut further
    small = F.flatten(F.transform(_pieces(F.col("__long"), MIDDLE, k), lambda p: _pieces(p, PIECE, k)))
    short = long_.select(*keys, F.explode(F.when(_single(F.col("__long")), F.array("__long")).otherwise(small)).alias("__piece")).where(F.length("__piece") >= k)
    single = F.when(_single(F.col("__piece")), F.col("__piece").cast("binary"))
    of = lambda piece, n: F.substring(F.col(piece), F.col("__at"), F.lit(n)).cast("string")
    return short.withColumn("__bytes", single), lambda n: F.when(F.col("__bytes").isNotNull(), of("__bytes", n)).otherwise(of("__piece", n))


def wanted_rows(rows: DataFrame, keys: list[str], sequence: str, wanted: DataFrame, k: int, amount: str = "N") -> DataFrame:
    """(keys, kmer): a row for each occurrence of a wanted (kmer) k-mer, as kmer_rows met with the wanted ones.

    Up to BROADCAST_KMERS are broadcast with their seeds, the parts of k - step + 1 letters. A k-mer holds exactly one
    of the seeds that start at every step-th letter of a piece, so only one place in step is looked up, and k-mers
    are cut around the seeds found.
    """
    step = max(1, min(SEED_STEP, k // 3))
    seed = k - step + 1
    wanted = wanted.select("kmer").distinct()
    if wanted.limit(BROADCAST_KMERS + 1).count() > BROADCAST_KMERS:
        return kmer_rows(rows, keys, sequence, k, amount).join(wanted, "kmer", "left_semi")
    seeds = wanted.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(step)), lambda i: F.substring(F.col("kmer"), i, F.lit(seed)))).alias("__seed")).distinct()
    if seeds.limit(BROADCAST_KMERS + 1).count() > BROADCAST_KMERS:
        return kmer_rows(rows, keys, sequence, k, amount).join(F.broadcast(wanted), "kmer", "left_semi")
    short, cut = _cut_pieces(rows, keys, sequence, k)
    placed = short.withColumn("__at", F.explode(F.sequence(F.lit(1), F.length("__piece") - (seed - 1), F.lit(step))))
    met = placed.withColumn("__seed", cut(seed)).join(F.broadcast(seeds), "__seed", "left_semi")
    first, last = F.greatest(F.lit(1), F.col("__at") - (step - 1)), F.least("__at", F.length("__piece") - (k - 1))
    around = met.where(first <= last).select(*keys, "__piece", "__bytes", F.explode(F.sequence(first, last)).alias("__at"))
    out = around.select(*keys, cut(k).alias("kmer")).where(~F.contains("kmer", F.lit(amount)))
    return out.join(F.broadcast(wanted), "kmer", "left_semi")


def shares_kmer(a: Column, b_kmers: Column, k: int) -> Column:
    """Whether a sequence has one of the k-mers."""
    return F.coalesce(F.arrays_overlap(kmers(a, k), b_kmers), F.lit(False))


def kmer_counts(rows: DataFrame, keys: list[str], sequence: str, k: int, wanted: DataFrame | None = None) -> DataFrame:
    """(keys, kmer, n): occurrences over all sequences of a group.

    wanted (keys, kmer): only these are counted. They are met before the shuffle if there are at most
    BROADCAST_KMERS, else the occurrences of each task are added up first.
    """
    found = kmer_rows(rows, keys, sequence, k)
    if wanted is None:
        return found.groupBy(*keys, "kmer").agg(F.count("*").alias("n"))
    wanted = wanted.select(*keys, "kmer").distinct()
    if wanted.limit(BROADCAST_KMERS + 1).count() <= BROADCAST_KMERS:
        return found.join(F.broadcast(wanted), [*keys, "kmer"], "left_semi").groupBy(*keys, "kmer").agg(F.count("*").alias("n"))
    return found.groupBy(*keys, "kmer").agg(F.count("*").alias("n")).join(wanted, [*keys, "kmer"], "left_semi")


def reference_kmers(rows: DataFrame, keys: list[str], sequence: str, k: int) -> DataFrame:
    """(keys, kmer): distinct k-mers of a group's sequences."""
    return kmer_rows(rows, keys, sequence, k).distinct()


def shared_kmers(rows: DataFrame, keys: list[str], sequence: str, known: DataFrame, k: int) -> DataFrame:
    """(keys, n_shared): how many of the known k-mers (kmer) a group's sequences have; groups without any are left out."""
    known = known.select("kmer").distinct()
    if known.limit(BROADCAST_KMERS + 1).count() <= BROADCAST_KMERS:
        known = F.broadcast(known)
    found = kmer_rows(rows, keys, sequence, k).join(known, "kmer", "left_semi")
    return found.distinct().groupBy(*keys).agg(F.count("*").alias("n_shared"))


def match(reference: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Reference k-mers with their counts among the reads, 0 where there are none."""
    return reference.join(counts, [*keys, "kmer"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def deletion_support(matched: DataFrame, keys: list[str], least: int = 3, share: float = 0.85) -> DataFrame:
    """(keys, n_kmers, n_supported, is_match): enough of the reference k-mers occur often enough among reads."""
    out = matched.groupBy(*keys).agg(F.count("*").alias("n_kmers"), F.count_if(F.col("n") >= least).alias("n_supported"))
    return out.withColumn("is_match", F.col("n_supported") / F.col("n_kmers") > share)


def duplication_support(matched: DataFrame, reads: DataFrame, keys: list[str], factor: float = 1.5, share: float = 0.3) -> DataFrame:
    """(keys, n_kmers, n_frequent, is_match): enough k-mers are more frequent than the reads let expect.

    reads: (keys, n_reads).
    """
    total = matched.groupBy(*keys).agg(F.count("*").alias("n_kmers"))
    limit = F.col("n_reads") / F.greatest(F.lit(100), F.col("n_kmers")) * F.lit(factor)
    rows = matched.join(total.join(reads, keys), keys)
    out = rows.groupBy(*keys, "n_kmers").agg(F.count_if(F.col("n") > limit).alias("n_frequent"))
    return out.withColumn("is_match", F.col("n_frequent") / F.col("n_kmers") > share)
