"""CIGAR text as column expressions: summaries, events, merged intervals, flanks, similarity.

A CIGAR is brought to an array of (len, op); everything else is folds and filters over it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"(\d+)([MIDNSHP=X])"
MATCH, ON_REFERENCE, ON_QUERY = ("M", "=", "X"), ("M", "D", "=", "X"), ("M", "I", "S", "=", "X")


def operations(cigar: Column) -> Column:
    """array<struct<len bigint, op string>>"""
    return F.transform(F.regexp_extract_all(cigar, F.lit(PATTERN), F.lit(0)), lambda x: F.struct(F.left(x, F.length(x) - 1).cast("bigint").alias("len"), F.right(x, F.lit(1)).alias("op")))


def total(ops: Column, kinds: tuple[str, ...]) -> Column:
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin(*kinds)), F.lit(0).cast("bigint"), lambda a, x: a + x["len"])


def summary(cigar: Column, ref_start: Column, is_reverse: Column | None = None, skips: bool = False, last_clip_only: bool = False) -> Column:
    """Clips, totals and spans of an alignment, as a struct.

    For reverse alignments the operations are turned round first. A soft clip at the first operation is the
    left one; of the others the last counts as the right one, or with last_clip_only only one at the end.
    skips: whether N moves along the reference. Without a CIGAR the sums are null and the clips 0.
    """
    ops = operations(cigar)
    if is_reverse is not None:
        ops = F.when(F.coalesce(is_reverse, F.lit(False)), F.reverse(ops)).otherwise(ops)
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    sums = {"match": ("M", "="), "insert": ("I",), "delete": ("D",), "mismatch": ("X",), "reference": (*ON_REFERENCE, "N") if skips else ON_REFERENCE, "query": ON_QUERY}
    names = ("left", "last", *sums)

    def step(a: Column, x: Column) -> Column:
        clip = x["op"] == "S"
        left = F.when(a["first"] & clip, x["len"]).otherwise(a["left"])
        last = F.when(~a["first"] & clip, x["len"]).otherwise(zero if last_clip_only else a["last"])
        added = [F.when(x["op"].isin(*kinds), a[n] + x["len"]).otherwise(a[n]).alias(n) for n, kinds in sums.items()]
        return F.struct(left.alias("left"), last.alias("last"), *added, F.lit(False).alias("first"))

    def finish(a: dict[str, Column] | Column) -> Column:
        return F.struct(
            a["left"].alias("softclip_left"),
            a["last"].alias("softclip_right"),
            a["match"].alias("match_length"),
            a["insert"].alias("insert_length"),
            a["delete"].alias("delete_length"),
            a["mismatch"].alias("mismatch_length"),
            ref_start.cast("bigint").alias("ref_start"),
            (ref_start + a["reference"]).cast("bigint").alias("ref_end"),
            a["left"].alias("query_start"),
            (a["query"] - a["last"]).cast("bigint").alias("query_end"),
        )

    # one walk keeps all sums: the text is parsed once, however many of them are asked
    start = F.struct(*[zero.alias(n) for n in names], F.lit(True).alias("first"))
    unknown = {n: zero if n in ("left", "last") else none for n in names}
    return F.when(cigar.isNotNull(), F.aggregate(ops, start, step, finish)).otherwise(finish(unknown))


def events(ops: Column, ref_start: Column, kind: str, least: Column | int, clips_move: bool = True) -> Column:
    """Deletions ('D') or insertions ('I') of at least so many bases: array<struct<start, end, len, query>>.

    query is the offset of an insertion in the read's sequence. clips_move: whether soft clips move along
    the sequence; without it, offsets behind a leading clip are too small by its length.
    """
    event = F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("len"), F.lit(0).cast("bigint").alias("query"))
    start = F.struct(ref_start.cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("q"), F.filter(F.array(event), lambda _: F.lit(False)).alias("out"))
    on_query = ("M", "=", "X", "I", "S") if clips_move else ("M", "=", "X", "I")

    def step(a: Column, x: Column) -> Column:
        end = a["r"] + x["len"] if kind == "D" else a["r"]
        found = F.struct(a["r"].alias("start"), end.alias("end"), x["len"].alias("len"), a["q"].alias("query"))
        return F.struct(
            (a["r"] + F.when(x["op"].isin(*ON_REFERENCE), x["len"]).otherwise(F.lit(0))).alias("r"),
            (a["q"] + F.when(x["op"].isin(*on_query), x["len"]).otherwise(F.lit(0))).alias("q"),
            F.when((x["op"] == kind) & (x["len"] >= least), F.concat(a["out"], F.array(found))).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(ops, start, step)["out"]


def in_window(found: Column, low: Column, high: Column) -> Column:
    """Events that touch the closed window."""
    return F.filter(found, lambda x: (low <= x["end"]) & (high >= x["start"]))


def insert_sequence(sequence: Column, found: Column) -> Column:
    """The inserted bases of each event: array<struct<start, end, len, seq>>"""
    return F.transform(found, lambda x: F.struct(x["start"], x["end"], x["len"], F.substring(sequence, (x["query"] + 1).cast("int"), x["len"].cast("int")).alias("seq")))


def merge(found: Column, gap: Column | int, sequences: bool = False) -> Column:
    """Events in order of start, joined where one starts at most gap behind the end before: ends are the
    furthest, lengths and sequences are put together."""

    def step(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        joined = [last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), (last["len"] + x["len"]).alias("len")]
        joined.append(F.concat(last["seq"], x["seq"]).alias("seq") if sequences else last["query"].alias("query"))
        return F.when((F.size(a) > 0) & (x["start"] <= last["end"] + gap), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(*joined)))).otherwise(F.concat(a, F.array(x)))

    # found is worked out once, for the fold and for the type of its start
    return F.element_at(F.transform(F.array(F.array_sort(found)), lambda ordered: F.aggregate(ordered, F.slice(ordered, 1, 0), step)), 1)


def flanks(ops: Column, at: Column) -> tuple[Column, Column]:
    """Matched bases that directly precede and follow the operation at a place (from 0)."""
    def run(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & x["op"].isin(*MATCH), x["len"]).otherwise(F.lit(0))).alias("n"), (a["on"] & x["op"].isin(*MATCH)).alias("on")))["n"]

    before = F.reverse(F.slice(ops, 1, at))
    return run(before), run(F.slice(ops, at + 2, F.greatest(F.size(ops), F.lit(1))))


def has_large(found: Column, least: int = 30) -> Column:
    return F.exists(found, lambda x: x["len"] >= least)


def matched(a: Column, b: Column, tolerance: int = 50, ratio: float = 0.8) -> Column:
    """Events of a with one of b near at both ends and of like size."""
    near = lambda x: lambda y: (F.abs(x["start"] - y["start"]) <= tolerance) & (F.abs(x["end"] - y["end"]) <= tolerance) & (F.greatest(x["len"], y["len"]) > 0) & (F.least(x["len"], y["len"]) >= F.greatest(x["len"], y["len"]) * F.lit(ratio))
    return F.size(F.filter(a, lambda x: F.exists(b, near(x))))


def similarity(del_a: Column, ins_a: Column, del_b: Column, ins_b: Column, tolerance: int = 50, capped: bool = True) -> Column:
    """Matched events over the mean number of events; 1 if neither has any, 0 if one has none."""
    n_a, n_b = F.size(del_a) + F.size(ins_a), F.size(del_b) + F.size(ins_b)
    value = (matched(del_a, del_b, tolerance) + matched(ins_a, ins_b, tolerance)) / ((n_a + n_b) / F.lit(2.0))
    return F.when((n_a == 0) & (n_b == 0), F.lit(1.0)).when((n_a == 0) | (n_b == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), value) if capped else value)
