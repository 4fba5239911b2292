"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INSERTION = "<INS>"
SINGLE = ("+", "-")


def insertion_like(notation: Column) -> Column:
    return notation.isin(INSERTION, *SINGLE)


def round3(x: Column) -> Column:
    """Three decimals, half up, by the same arithmetic in every engine."""
    return F.floor(x * 1000 + F.lit(0.5)) / F.lit(1000.0)


def as_float(x: Column) -> Column:
    """Lenient cast: what is no number counts as 0."""
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def as_int(x: Column) -> Column:
    """Lenient cast by truncation."""
    return F.coalesce(x.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def ordered(start: Column, end: Column) -> tuple[Column, Column]:
    return F.least(start, end), F.greatest(start, end)


def nearby(start_chr: Column, start: Column, end_chr: Column, end: Column, distance: int) -> Column:
    return (start_chr == end_chr) & (F.abs(start - end) <= distance)


def event_size(notation: Column, start_chr: Column, start: Column, end_chr: Column, end: Column, insert_length: Column) -> Column:
    """Insert length of insertions and single ends, distance within a contig, 0 between contigs."""
    return F.when(insertion_like(notation), insert_length).when(start_chr == end_chr, F.abs(start - end)).otherwise(F.lit(0)).cast("bigint")


def first_reason(*tests: tuple[Column, str]) -> Column:
    """The reason of the first test that holds; null if none does. A null test does not hold."""
    out = F.lit(None).cast("string")
    for test, reason in reversed(tests):
        out = F.when(test, F.lit(reason)).otherwise(out)
    return out


def points(*ladder: tuple[Column, int]) -> Column:
    """The points of the first condition that holds, else 0."""
    out = F.lit(0)
    for test, value in reversed(ladder):
        out = F.when(test, F.lit(value)).otherwise(out)
    return out


def scale(size: Column, least: Column | float, most: Column | float) -> Column:
    """Linear position of size between least and most, clamped to 0..1."""
    low, high = F.lit(least) if not isinstance(least, Column) else least, F.lit(most) if not isinstance(most, Column) else most
    return F.when(size <= low, F.lit(0.0)).when(size >= high, F.lit(1.0)).otherwise((size - low) / (high - low))
