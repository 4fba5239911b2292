"""Exact quantiles of large groups: ranks are found by counts over ranges of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions and lengths in a range: values below 2^28 (no contig is longer) have at most 2^14 ranges.
POSITIONS = 1 << 14
#: Rows of a group from which its quantiles are found by ranges; a smaller group fits the buffer of an aggregate.
LARGE = 1 << 17

Measures = list[tuple[Column, float, dict[str, float]]]


def quantiles(rows: DataFrame, keys: list[str], measures: Measures) -> DataFrame:
    """(keys, name, value): the quantiles of each group, interpolated between the two neighbours of a rank.

    A measure is (value, width, {name: share}). Equal values become one row with their number; the numbers
    of each range of width give the ranges that hold the wanted ranks, and only the values of those are put in
    order. So no task or buffer holds more than the ranges of a group or the distinct values of a range,
    however many rows a group has. The value is the one that percentile gives.

    Defined cases: null values count in no measure; a group without values has no row for that measure; keys
    must not be null and values must be finite.
    """
    entry = lambda i, x: F.struct(F.lit(i).alias("m"), x.cast("double").alias("x"))
    entries = F.array(*[entry(i, x) for i, (x, _, _) in enumerate(measures)])
    flat = rows.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.m", "e.x").where("x is not null")
    width, asked = F.lit(None).cast("double"), F.lit(None)
    for i, (_, w, names) in enumerate(measures):
        width = F.when(F.col("m") == i, F.lit(float(w))).otherwise(width)
        asked = F.when(F.col("m") == i, F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(s)).alias("share")) for n, s in names.items()])).otherwise(asked)
    counted = flat.groupBy(*keys, "m", "x").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("x") / width))

    whole = Window.partitionBy(*keys, "m")
    earlier = lambda w, order: F.coalesce(F.sum("n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counted.groupBy(*keys, "m", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.withColumns({"before": earlier(whole, "range"), "place": F.sum("n").over(whole) - 1})
    ranges = ranges.withColumn("a", F.explode(asked)).select(*keys, "m", "range", "before", "n", "a.name", (F.col("place") * F.col("a.share")).alias("place"))
    low, high = F.floor("place"), F.ceil("place")
    held = ranges.where((F.col("before") <= high) & (F.col("before") + F.col("n") > low)).drop("n")

    values = counted.join(held, [*keys, "m", "range"])
    values = values.withColumn("at", F.col("before") + earlier(Window.partitionBy(*keys, "m", "range", "name"), "x"))
    on = lambda rank: F.max(F.when((F.col("at") <= rank) & (rank < F.col("at") + F.col("n")), F.col("x")))
    found = values.groupBy(*keys, "name", "place").agg(on(low).alias("below"), on(high).alias("above"))
    between = (high - F.col("place")) * F.col("below") + (F.col("place") - low) * F.col("above")
    return found.select(*keys, "name", F.when(F.col("below") == F.col("above"), F.col("below")).otherwise(between).alias("value"))


def wide_quantiles(rows: DataFrame, keys: list[str], measures: Measures) -> DataFrame:
    """quantiles with one column for each name; null where a group has no values."""
    names = [n for _, _, asked in measures for n in asked]
    return quantiles(rows, keys, measures).groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def has_large(rows: DataFrame, keys: list[str], large: int = LARGE) -> bool:
    """Does any group have so many rows? Groups of more keys are then not large either. Runs a count of the groups."""
    return not _large_groups(rows, keys, large).isEmpty()


def _large_groups(rows: DataFrame, keys: list[str], large: int) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= large).drop("__n")


def aggregated(rows: DataFrame, keys: list[str], sums: list[Column], measures: Measures, large: int | None = LARGE) -> DataFrame:
    """One row for each group: sums (aggregates), and the quantiles of measures as doubles.

    Groups of fewer than large rows take one aggregate, whose buffer their rows bound; the quantiles of the
    others are found by ranges. The results are the same. rows is read several times, first by a count of the
    groups: settle what is costly. With large None the caller has found that no group is large (has_large).
    """
    direct = [F.percentile(x.cast("double"), F.lit(share)).alias(n) for x, _, names in measures for n, share in names.items()]
    if large is None or not has_large(rows, keys, large):
        return rows.groupBy(*keys).agg(*sums, *direct)
    big = _large_groups(rows, keys, large)
    small = rows.join(big, keys, "left_anti").groupBy(*keys).agg(*sums, *direct)
    rest = rows.join(big, keys, "left_semi")
    return small.unionByName(rest.groupBy(*keys).agg(*sums).join(wide_quantiles(rest, keys, measures), keys))
