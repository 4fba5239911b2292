"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with share w of the mix and n of the N documents has the mean repetition rate w * N * epochs / n.
Each document draws its number of copies by inverting the Poisson distribution of that mean at a uniform
number hashed from the seed and the document, so the draw does not depend on partitioning or on lost and
repeated tasks. Means above SPLIT are drawn as sums of independent parts of at most SPLIT. Copies are
dealt to partitions by range and sorted by a hash of seed, document and copy: a global shuffle.

The table of rates has one row a source. It is broadcast if it has at most BROADCAST_SOURCES rows; else
documents and rates are joined by source and a salt, so that a hot source is spread over SALTS tasks.

Defined cases: a null source is a source of its own (its weight is under the key None); sources without a
weight get none and leave the mix; weights given twice for a source add up, weights of sources that the
documents do not have count for nothing; rows that repeat an id draw the same number of copies each; rows
without an id are seeded by their text. Copies of a row stream out one at a time, however many there are.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import materialize

SPLIT = 64.0
BROADCAST_SOURCES = 4000
SALTS = 32
#: Exponent of the default target weights: a source's weight is its number of documents to this power.
ALPHA = 0.5


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of an MD5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def document_key(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def poisson_cdf(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... up to where they no longer differ from 1."""
    last = F.ceil(mean + F.lit(12.0) * F.sqrt(mean) + F.lit(30.0)).cast("int")
    start = F.struct(F.array(F.exp(-mean)).alias("cdf"), (-mean).alias("log_p"))

    def step(a: Column, k: Column) -> Column:
        log_p = a["log_p"] + F.ln(mean) - F.ln(k.cast("double"))
        return F.struct(F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + F.exp(log_p))).alias("cdf"), log_p.alias("log_p"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]


def weight_table(spark: SparkSession, weights: dict[str | None, float]) -> DataFrame:
    """(source, weight) of a dict, read by the JVM from one JSON literal: any number of sources, no Python on executors."""
    text = json.dumps([{"source": k, "weight": float(v)} for k, v in weights.items()])
    rows = F.explode(F.from_json(F.lit(text), "array<struct<source:string,weight:double>>")).alias("r")
    return spark.range(1).select(rows).select("r.*")


def rates(docs: DataFrame, weights: DataFrame | dict[str | None, float] | None, epochs: float, source: str) -> DataFrame:
    """(source, rate, parts, cdf): the mean of each source, and the distribution of one part of it."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(ALPHA)))
    else:
        given = weight_table(docs.sparkSession, weights) if isinstance(weights, dict) else weights
        given = given.groupBy(F.col("source").alias("given")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        weighed = counts.join(given, F.col("source").eqNullSafe(F.col("given")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weighed = materialize(weighed, "mixing-sources")
    total = weighed.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    if not total.n or not total.weight:
        return weighed.where("false").select("source", F.lit(0.0).alias("rate"), F.lit(1).alias("parts"), F.array(F.lit(1.0)).alias("cdf"))
    rate = F.col("weight") / F.lit(float(total.weight)) * F.lit(float(total.n) * epochs) / F.col("n")
    out = weighed.where("weight > 0").select("source", rate.alias("rate"))
    out = out.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / SPLIT)).cast("int"))
    return out.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))


def mix(docs: DataFrame, weights: DataFrame | dict[str | None, float] | None = None, epochs: float = 1.0, seed: int = 20240501, source: str = "source", text: str = "text") -> DataFrame:
    """docs replicated to the target weights, with copy (from 1) and mix_order, in the order of mix_order.

    weights: source -> share of the mix, in any unit, as a dict or as a table (source, weight); by default
    sources count with their size to the power ALPHA. epochs: expected documents of the result, in multiples of the input's. Input columns named copy
    or mix_order are replaced.
    """
    columns = [c for c in docs.columns if c not in ("copy", "mix_order")]
    table = materialize(rates(docs, weights, epochs, source), "mixing-rates").select(F.col("source").alias("__source"), "parts", "cdf")
    key = document_key(F.col("doc_id"), F.col(text))
    held = docs.select(*columns, key.alias("__key"))
    same = F.col(source).eqNullSafe(F.col("__source"))
    if table.count() <= BROADCAST_SOURCES:
        joined = held.join(F.broadcast(table), same)
    else:
        salted = table.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = held.withColumn("__salt", F.pmod(F.xxhash64("__key"), F.lit(SALTS)).cast("int"))
        joined = held.join(salted, same & (F.col("__salt") == F.col("__salt_r")))
    drawn = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda part: uniform(F.lit(seed), F.lit("copies"), F.col("__key"), part))
    n = F.aggregate(F.col("__drawn"), F.lit(0), lambda a, u: a + F.size(F.filter("cdf", lambda c: c <= u)))
    copies = joined.withColumn("__drawn", drawn).withColumn("__n", n).where("__n > 0").select(*columns, "__key", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy"))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col("__key"), F.col("copy").cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    # mix_order is even in [0, 2^60): equal ranges of it are equal shares, and no sample is needed to cut them
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.shiftright(F.shiftright("mix_order", 30) * F.lit(n_parts).cast("bigint"), 30).cast("int")
    return copies.withColumn("mix_order", order).drop("__key").repartitionById(n_parts, part).sortWithinPartitions("mix_order")
