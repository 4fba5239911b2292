"""Ordered operators that stay parallel inside a contig: gap islands, running values, interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.stages import settle

#: Chunks whose summary rows are broadcast at most.
CHUNKS = 100_000


def islands(rows: DataFrame, keys: list[str], position: Column, end: Column, extension: Column, order: list[Column], chunk: int, name: str = "island") -> DataFrame:
    """Number the islands of rows along a position, from 1 within keys.

    A row opens an island if its position is more than extension beyond the furthest end of all rows before
    it. Rows are ordered within chunks of the position only; what a chunk takes over from those before it
    (the furthest end, the number of islands) comes from one summary row a chunk, so a large contig is
    spread over its chunks. order must begin with the position.
    """
    by = [*keys, "__chunk"]
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by).orderBy(*order)
    chunked = rows.withColumn("__chunk", F.floor(position / chunk))
    ends = chunked.groupBy(*by).agg(F.max(end).alias("__last")).withColumn("__reach", F.max("__last").over(earlier)).drop("__last")
    # the only shuffle of the rows: windows and the join with the ends take it as it is, the numbering reads what is written
    held = chunked.repartition(*by).withColumn("__before", F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1))).join(ends, by)
    reach = F.greatest("__before", "__reach")
    held = held.withColumn("__opens", F.when(reach.isNull() | (position - reach > extension), 1).otherwise(0))
    held = held.withColumn("__count", F.sum("__opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    held = settle(held.drop("__before", "__reach", "__opens"), "islands")
    opened = held.groupBy(*by).agg(F.max("__count").alias("__n")).withColumn("__offset", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    if opened.limit(CHUNKS + 1).count() <= CHUNKS:
        opened = F.broadcast(opened)
    return held.join(opened, by).withColumn(name, (F.col("__count") + F.col("__offset")).cast("bigint")).drop("__chunk", "__count", "__offset")


def number_segments(rows: DataFrame, keys: list[str], marker: Column, name: str = "island", stage: str = "islands") -> DataFrame:
    """rows whose islands are numbered from 1 within a segment, with the number of the island from 1 within keys.

    A marker row a segment has the number of its islands; there are no more segments than a broadcast holds. The rows are written once;
    markers and the segment are left out of the result.
    """
    held = settle(rows, stage)
    earlier = Window.partitionBy(*keys).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.where(marker).select(*keys, "segment", F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias("__offset"))
    placed = held.where(~marker).join(F.broadcast(offsets), [*keys, "segment"])
    return placed.withColumn(name, F.col(name) + F.col("__offset")).drop("__offset", "segment")


def with_bins(rows: DataFrame, low: Column, high: Column, width: int, name: str = "bin") -> DataFrame:
    """One row for each bin of width that [low, high] touches."""
    return rows.withColumn(name, F.explode(F.sequence(F.floor(low / width).cast("bigint"), F.floor(high / width).cast("bigint"))))


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[tuple[str, str]], at: Column, low: Column, high: Column, width: int) -> DataFrame:
    """Inner join of points with the intervals [low, high] that hold them: an equi-join on key and bin.

    A point is in one bin, so no pair is found twice. Column names of the sides must differ.
    """
    left = points.withColumn("__bin", F.floor(at / width).cast("bigint")).withColumn("__at", at)
    right = with_bins(intervals.withColumns({"__low": low, "__high": high}), F.col("__low"), F.col("__high"), width, "__right_bin")
    condition = F.col("__bin") == F.col("__right_bin")
    for a, b in keys:
        condition &= F.col(a) == F.col(b)
    found = left.join(right, condition & F.col("__at").between(F.col("__low"), F.col("__high")))
    return found.drop("__bin", "__at", "__low", "__high", "__right_bin")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: int) -> DataFrame:
    """Inner join of overlapping closed spans; each pair is found once, in the first bin that both touch."""
    a = with_bins(left.withColumns({"__al": left_span[0], "__ah": left_span[1]}), F.col("__al"), F.col("__ah"), width, "__abin")
    b = with_bins(right.withColumns({"__bl": right_span[0], "__bh": right_span[1]}), F.col("__bl"), F.col("__bh"), width, "__bbin")
    condition = (F.col("__abin") == F.col("__bbin")) & (F.col("__al") <= F.col("__bh")) & (F.col("__bl") <= F.col("__ah"))
    condition &= F.col("__abin") == F.floor(F.greatest("__al", "__bl") / width)
    for x, y in keys:
        condition &= F.col(x) == F.col(y)
    return a.join(b, condition).drop("__al", "__ah", "__bl", "__bh", "__abin", "__bbin")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place (from 0) in a total order; each task numbers a range, and ranges start where those before end."""
    ranged = settle(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a range: as many as there are shuffle partitions
    starts = sizes.select("__range", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__place", inside).join(F.broadcast(starts), "__range").withColumn(name, (F.col("__place") + F.col("__before") - 1).cast("bigint")).drop("__range", "__place", "__before")
