"""Evidence of structural variants in single short reads: split, discordant, indel and semi-aligned reads.

Reads are rows of the read schema. Breakends are (contig, begin, end, state) in flat columns bp1_* and bp2_*.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.config import CONTIGS
from strandloom.functions import cigar
from strandloom.functions.columns import points
from strandloom.operators.ordered import overlap_join

c = F.col
RIGHT, LEFT, COMPLEX, UNKNOWN = "SVBEND_RIGHT_OPEN", "SVBEND_LEFT_OPEN", "SVBEND_COMPLEX", "SVBEND_UNKNOWN"
#: Kinds of evidence in the order of their counters.
EVIDENCE = ["unknown", "cigar", "pair", "split", "semi", "shadow", "local_pair"]
#: Letters of an edge that are compared first; where they hold no run of matches, the whole is compared.
NEAR = 64


def evidence(kind: str | None) -> Column:
    """Counters of the kinds of evidence, with one of the given kind."""
    return F.array(*[F.lit(int(e == kind)) for e in EVIDENCE])


def filtered(least_mapq: int = 20) -> Column:
    """Whether a read is left out of evidence."""
    return c("is_unmapped") | c("is_duplicate") | c("is_qcfail") | c("is_secondary") | c("is_supplementary") | (c("mapq") < least_mapq)


def reference_length(text: Column) -> Column:
    return cigar.total(cigar.operations(text), ("M", "D", "N", "=", "X"))


def pair_orientation() -> Column:
    """FF, RR, FR or RF of a read and its mate; by position where their strands differ."""
    forward, mate_forward = ~c("is_reverse"), ~c("mate_reverse")
    return (
        F.when(forward & mate_forward, "FF")
        .when(~forward & ~mate_forward, "RR")
        .when(forward, F.when(c("start") < c("mate_start"), "FR").otherwise("RF"))
        .otherwise(F.when(c("start") > c("mate_start"), "RF").otherwise("FR"))
    )


def is_discordant(least: int = 50, most: int = 100_000) -> Column:
    """Pairs on two contigs, of odd size, on one strand, or in the wrong order. Only primary mapped pairs."""
    usable = c("is_paired") & ~(c("is_unmapped") | c("mate_unmapped") | c("is_secondary") | c("is_supplementary"))
    size = F.abs("template_length")
    ahead, behind = c("start") >= c("mate_start"), c("start") <= c("mate_start")
    # on the forward strand read 1 comes first, on the reverse read 2
    wrong = F.when(c("is_read1") == c("is_reverse"), behind).otherwise(ahead)
    other = F.coalesce(c("contig") != c("mate_contig"), F.lit(True))
    return usable & (other | ~size.between(least, most) | (c("is_reverse") == c("mate_reverse")) | wrong)


def pair_type() -> Column:
    """Event that a discordant pair suggests."""
    way = pair_orientation()
    return (
        F.when(F.coalesce(c("contig") != c("mate_contig"), F.lit(True)), "TRA")
        .when(F.abs("template_length") > 1000, "DEL")
        .when(way.isin("RR", "FF"), "INV")
        .when((way == "RF") & (c("start") < c("mate_start")), "DUP")
        .otherwise("UNK")
    )


def is_overlapping() -> Column:
    """Whether the mates overlap on the reference; the mate's end is that of its CIGAR (mc), if known."""
    usable = c("is_paired") & ~c("is_unmapped") & ~c("mate_unmapped") & (c("contig") == c("mate_contig"))
    mate_end = c("mate_start") + reference_length(c("mc"))
    known = (c("start") < mate_end) & (c("mate_start") < c("end"))
    guess = (c("mate_start") >= c("start")) & (c("mate_start") < c("end")) | (c("mate_start") <= c("start")) & (c("start") < c("mate_start") + c("query_length"))
    return F.coalesce(usable & F.when(c("mc").isNotNull(), known).otherwise(guess), F.lit(False))


def alignment(prefix: str = "") -> Column:
    """Summary of a read's own alignment; skips move along the reference."""
    return cigar.summary(c(f"{prefix}cigar"), c(f"{prefix}start"), skips=True)


def split_alignments(reads: DataFrame, least_mapq: int = 20, contigs: list[str] = CONTIGS) -> DataFrame:
    """reads with an alignment 'a' of their own and a valid one 's' from the SA tag, on contig split_contig.

    Positions of the tag become 0-based; the pair counts with the read's own mapping quality.
    """
    part = F.split("sa_part", ",")
    rows = reads.where("sa is not null").withColumn("a", alignment())
    rows = rows.withColumn("sa_part", F.explode(F.filter(F.split("sa", ";"), lambda x: x != "")))
    rows = rows.withColumns({"split_contig": F.get(part, F.lit(0)), "split_reverse": F.get(part, F.lit(2)) == "-", "split_mapq": F.get(part, F.lit(4)).try_cast("int"), "s": cigar.summary(F.get(part, F.lit(3)), F.get(part, F.lit(1)).try_cast("bigint") - 1, skips=True)})
    return rows.where(c("split_contig").isin(contigs) & (c("split_mapq") >= least_mapq) & is_valid_split()).drop("sa_part")


def is_valid_split(aligned: int = 20, overlap: int = 20, gap: int = 20, slop: int = 10, excess: int = 30, clip: int = 8, far: int = 1000) -> Column:
    """Whether two alignments (a, s) make a plausible split read: enough bases, adjacent in the read, not
    more than the read, and clipped if the event is near."""
    bases = lambda x: c(f"{x}.match_length") + c(f"{x}.mismatch_length")
    one, two = F.abs(c("a.query_end") - c("s.query_start")), F.abs(c("s.query_end") - c("a.query_start"))
    shared = F.least("a.query_end", "s.query_end") - F.greatest("a.query_start", "s.query_start")
    adjacent = (one <= slop) | (two <= slop) | ((shared <= overlap) & (-shared <= gap))
    covered = (c("a.query_end") - c("a.query_start")) + (c("s.query_end") - c("s.query_start"))
    length = F.when(c("query_length") > 0, c("query_length")).otherwise(F.greatest("a.query_end", "s.query_end") - F.least("a.query_start", "s.query_start"))
    apart = F.greatest(F.lit(0), F.greatest("a.ref_start", "s.ref_start") - F.least("a.ref_end", "s.ref_end"))
    near = (c("contig") == c("split_contig")) & (apart <= far)
    # any side may show the clip: the joined one, or else another
    clipped = F.greatest("a.softclip_left", "a.softclip_right", "s.softclip_left", "s.softclip_right") >= clip
    return (bases("a") >= aligned) & (bases("s") >= aligned) & adjacent & (covered <= length + excess) & (~near | clipped)


def opens_downstream(prefix: str) -> Column:
    """Whether the larger clip is on the right."""
    return c(f"{prefix}.softclip_left") < c(f"{prefix}.softclip_right")


def breakend(rows: DataFrame, name: str, contig: Column, at: Column, state: Column, lengths: DataFrame, before: int, after: int, upto: Column | None = None) -> DataFrame:
    """rows with name_contig, name_begin, name_end, name_state: the interval around at, within the contig."""
    limit = lengths.select(c("contig").alias("__contig"), c("length").alias("__length"))
    out = rows.withColumns({f"{name}_contig": contig, f"{name}_state": state, "__at": at, "__to": upto if upto is not None else at})
    out = out.join(limit, c(f"{name}_contig") == c("__contig"), "left")
    end = c("__to") + after
    return out.withColumns({f"{name}_begin": F.greatest(F.lit(0), c("__at") - before), f"{name}_end": F.least(end, F.coalesce("__length", end))}).drop("__contig", "__length", "__at", "__to")


def _end_of(prefix: str) -> tuple[Column, Column]:
    down = opens_downstream(prefix)
    return F.when(down, c(f"{prefix}.ref_end")).otherwise(c(f"{prefix}.ref_start")), F.when(down, RIGHT).otherwise(LEFT)


def split_candidates(reads: DataFrame, lengths: DataFrame, least_mapq: int = 20, offset: int = 100) -> DataFrame:
    rows = split_alignments(reads, least_mapq)
    (at1, state1), (at2, state2) = _end_of("a"), _end_of("s")
    rows = breakend(rows, "bp1", c("contig"), at1, state1, lengths, offset, offset)
    rows = breakend(rows, "bp2", c("split_contig"), at2, state2, lengths, offset, offset)
    return rows.withColumns({"evidence_type": F.lit("SPLIT"), "evidence": evidence("split")})


def discordant_candidates(reads: DataFrame, lengths: DataFrame, least: int = 500, most: int = 10_000, offset: int = 500) -> DataFrame:
    """Candidates of the first reads of discordant pairs."""
    rows = reads.where(c("is_read1") & is_discordant(least, most))
    mate_end = c("mate_start") + F.when(c("mc").isNotNull(), reference_length(c("mc"))).otherwise(c("query_length"))
    state = lambda reverse: F.when(c(reverse), LEFT).otherwise(RIGHT)
    rows = rows.withColumns({"insert_size": F.abs(F.coalesce("template_length", F.lit(0))), "orientation": pair_orientation(), "evidence_type": pair_type(), "evidence": evidence("pair")})
    rows = breakend(rows, "bp1", c("contig"), F.when(c("is_reverse"), c("start")).otherwise(c("end")), state("is_reverse"), lengths, offset, offset)
    return breakend(rows, "bp2", F.coalesce("mate_contig", "contig"), F.when(c("mate_reverse"), c("mate_start")).otherwise(mate_end), state("mate_reverse"), lengths, offset, offset)


def flanked_events(kind: str, least: int = 40, flank: int = 5) -> Column:
    """Events of a read with enough matched bases on both sides.

    An event that is large enough but lacks a flank moves neither along the reference nor along the read.
    """
    ops = cigar.operations(c("cigar"))
    marked = F.transform(ops, lambda x, i: F.struct(x["len"].alias("len"), x["op"].alias("op"), F.when(x["op"].isin("I", "D") & (x["len"] >= least), _flanked(ops, i, flank)).otherwise(F.lit(True)).alias("ok")))
    return cigar.events(F.filter(marked, lambda x: x["ok"]), c("start"), kind, least, clips_move=False)


def _flanked(ops: Column, at: Column, flank: int) -> Column:
    before, after = cigar.flanks(ops, at)
    return (before >= flank) & (after >= flank)


def indel_candidates(reads: DataFrame, lengths: DataFrame, low: Column, high: Column, least: int = 50, gap: int = 150, offset: int = 100) -> DataFrame:
    """Candidates of large indels inside reads that touch the window."""
    deletions = cigar.merge(cigar.in_window(flanked_events("D", least), low, high), gap)
    inserts = cigar.merge(cigar.insert_sequence(c("seq"), cigar.in_window(flanked_events("I", least), low, high)), gap, sequences=True)
    as_event = lambda kind, x, seq: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["len"].alias("len"), seq.alias("seq"))
    found = F.concat(F.transform(deletions, lambda x: as_event("DEL", x, F.lit(None).cast("string"))), F.transform(inserts, lambda x: as_event("INS", x, x["seq"])))
    rows = reads.withColumn("e", F.explode(found))
    rows = rows.withColumns({"evidence_type": c("e.kind"), "insert_seq": c("e.seq"), "evidence": evidence("cigar")})
    end = F.when(c("e.kind") == "DEL", c("e.end")).otherwise(c("e.start"))
    rows = breakend(rows, "bp1", c("contig"), c("e.start"), F.lit(RIGHT), lengths, offset, offset)
    return breakend(rows, "bp2", c("contig"), end, F.lit(LEFT), lengths, offset, offset).drop("e")


def bases_match(a: Column, b: Column) -> Column:
    """Equal bases in any case; N matches everything."""
    return (a == b) | (a == "N") | (b == "N") | (F.upper(a) == F.upper(b))


def matchify(ops: Column) -> Column:
    """Soft clips at the edges taken as matches."""
    n = F.size(ops)
    return F.transform(ops, lambda x, i: F.struct(x["len"].alias("len"), F.when((x["op"] == "S") & ((i == 0) | (i == n - 1)), "M").otherwise(x["op"]).alias("op")))


def _letters(text: Column) -> Column:
    """The letters of a text as an array: a place in a string is found by walking it, so a string is taken apart once."""
    return F.split(text, "")


def edge_mismatch(sequence: Column, reference: Column, contiguous: int = 5) -> Column:
    """Bases before the first run of so many matches, or -1: how far a read disagrees from its left edge.

    Both strings start at the edge; for the right edge give them reversed.
    """
    n = F.least(F.length(sequence), F.length(reference))

    def step(found: Column, size: Column) -> Column:
        upto = F.least(size, n)
        same = F.zip_with(_letters(F.left(sequence, upto)), _letters(F.left(reference, upto)), lambda a, b: F.when(bases_match(a, b), "=").otherwise("x"))
        return F.when(found > 0, found).otherwise(F.instr(F.array_join(same, ""), "=" * contiguous))

    return F.coalesce(F.when(n > 0, F.aggregate(F.array(F.lit(NEAR), n), F.lit(0), step) - 1), F.lit(-1))


def good_share(qualities: Column, n: Column, least: int = 20, share: float = 0.8) -> Column:
    """Whether enough of the first n quality characters reach a quality; reads without qualities do."""
    good = F.filter(_letters(F.left(qualities, F.greatest(F.lit(1), n))), lambda q: F.ascii(q) - 33 >= least)
    return qualities.isNull() | (F.size(good) >= n * share)


def semi_aligned(reads: DataFrame, lengths: DataFrame, least: int = 30, offset: int = 100) -> DataFrame:
    """Candidates of reads without split alignments whose clipped edge disagrees with the reference.

    reads also has left_reference and right_reference: the reference from the clipped left edge on, and
    reversed from the clipped right edge on.
    """
    free = ~is_overlapping() | c("is_supplementary")

    def walked(a: Column) -> Column:
        # only clipped edges can disagree
        left = F.when(a["softclip_left"] > 0, F.greatest(F.lit(0), edge_mismatch(c("seq"), c("left_reference")))).otherwise(F.lit(0))
        right = F.when(a["softclip_right"] > 0, F.greatest(F.lit(0), edge_mismatch(F.reverse("seq"), c("right_reference")))).otherwise(F.lit(0))
        return F.struct(a.alias("a"), left.alias("leading"), right.alias("trailing"))

    def edges(w: Column) -> Column:
        leading = (w["leading"] >= least) & (free | ~c("is_reverse")) & good_share(c("qual"), w["leading"])
        trailing = (w["trailing"] >= least) & (free | c("is_reverse")) & good_share(F.reverse("qual"), w["trailing"])
        first = c("start") - w["a"]["softclip_left"] + w["leading"]
        last = c("end") + w["a"]["softclip_right"] - w["trailing"]
        edge = lambda name, at: F.struct(F.lit(name).alias("edge"), at.cast("bigint").alias("at"), w.alias("w"))
        found = F.array(F.when(leading, edge("leading", first)), F.when(trailing, edge("trailing", last)))
        return F.when(w["leading"] + w["trailing"] < F.length("seq"), F.array_compact(found))

    # one expression: a CIGAR is parsed once, an edge is compared once, and no rows are written between
    alone = F.array(cigar.summary(c("cigar"), c("start"), skips=True, last_clip_only=True))
    found = F.flatten(F.transform(F.transform(alone, walked), edges))
    rows = reads.where("sa is null and seq is not null and not is_unmapped and contains(cigar, 'S')").withColumn("e", F.explode(found))
    rows = rows.withColumns({"a": c("e.w.a"), "leading": c("e.w.leading"), "trailing": c("e.w.trailing"), "evidence_type": F.lit("SEMI"), "evidence": evidence("semi"), "edge": c("e.edge")})
    rows = breakend(rows, "bp1", c("contig"), c("e.at"), F.lit(COMPLEX), lengths, offset, offset)
    return breakend(rows, "bp2", c("contig"), c("e.at"), F.lit(UNKNOWN), lengths, offset, offset).drop("e")


def evidence_class(kinds: list[tuple[str, Column]]) -> Column:
    """The first kind of evidence that a read has."""
    out = F.lit(None).cast("string")
    for name, test in reversed(kinds):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def clipped(least: int = 15) -> Column:
    return F.exists(cigar.operations(c("cigar")), lambda x: (x["op"] == "S") & (x["len"] >= least))


def has_split(least_mapq: int = 20) -> Column:
    """Whether the SA tag names an alignment on a known contig that maps well (without the read-level checks)."""
    parts = F.filter(F.split(F.coalesce("sa", F.lit("")), ";"), lambda x: x != "")
    return F.exists(parts, lambda x: F.get(F.split(x, ","), F.lit(0)).isin(CONTIGS) & (F.get(F.split(x, ","), F.lit(4)).try_cast("int") >= least_mapq))


def supporting_reads(calls: DataFrame, reads: DataFrame, key: str, kind: str, margin: int | Column = 1000, least_mapq: int = 0, least_size: int = 750, most_size: int = 1_000_000) -> DataFrame:
    """Rows of reads near calls that speak for an event, with call_key, side and evidence.

    kind: 'small' takes the whole span, 'large' and 'bnd' a window around each end. Each read counts with its first
    evidence.
    """
    spans = evidence_spans(calls, key, kind, margin)
    used = reads.where(~filtered(least_mapq) & c("seq").isNotNull())
    met = overlap_join(used, spans, [("contig", "span_contig")], (c("start"), c("end") - 1), (c("lo"), c("hi") - 1), 2000)
    discordant = c("is_read1") & is_discordant(least_size, most_size)
    large_indel = F.exists(cigar.operations(c("cigar")), lambda x: x["op"].isin("I", "D") & (x["len"] >= 40))
    split = ("split", has_split(least_mapq))
    order = {
        "small": [split, ("discordant", discordant), ("indel", large_indel), ("semi", clipped(20))],
        "large": [("clip", clipped()), split, ("discordant", discordant)],
        "bnd": [("clip", clipped()), ("discordant", c("is_paired") & ~c("mate_unmapped") & (c("contig") != c("mate_contig"))), split],
    }[kind]
    return met.withColumn("evidence", evidence_class(order)).where("evidence is not null")


def evidence_spans(calls: DataFrame, key: str, kind: str, margin: int | Column = 1000) -> DataFrame:
    """(call_key, side, span_contig, lo, hi): the half-open windows in which a call's evidence is looked for."""
    low, high = F.least("start_loc", "end_loc"), F.greatest("start_loc", "end_loc")
    side = lambda name, contig, a, b: F.struct(F.lit(name).alias("side"), contig.alias("contig"), F.greatest(F.lit(0), a).alias("lo"), b.alias("hi"))
    if kind == "small":
        sides = F.array(side("span", c("start_chr"), low - margin, high + margin))
    else:
        both = [side("start", c("start_chr"), c("start_loc") - margin, c("start_loc") + margin), side("end", c("end_chr"), c("end_loc") - margin, c("end_loc") + margin)]
        sides = F.array(*both)
    return calls.select(c(key).alias("call_key"), F.explode(sides).alias("s")).select("call_key", "s.side", c("s.contig").alias("span_contig"), c("s.lo").alias("lo"), c("s.hi").alias("hi"))


def mates_of(found: DataFrame, reads: DataFrame) -> DataFrame:
    """(call_key, side, read_name, seq): mates, among reads, of the discordant ones of supporting_reads."""
    wanted = found.where("evidence = 'discordant'").select("call_key", "side", c("read_name").alias("wanted"), c("is_read1").alias("wanted_first"), c("mate_contig").alias("wanted_contig"))
    mates = reads.join(wanted, (c("read_name") == c("wanted")) & (c("contig") == c("wanted_contig")) & (c("is_read1") != c("wanted_first")) & c("seq").isNotNull())
    return mates.select("call_key", "side", "read_name", "seq")


def mate_spans(found: DataFrame, reach: int = 100) -> DataFrame:
    """(contig, low, high): where the mates of the discordant reads of supporting_reads lie."""
    wanted = found.where("evidence = 'discordant' and mate_contig is not null and mate_start >= 0")
    return wanted.select(c("mate_contig").alias("contig"), F.greatest(F.lit(0), c("mate_start") - reach).alias("low"), (c("mate_start") + reach).alias("high"))


def collect_evidence(calls: DataFrame, reads: DataFrame, key: str, kind: str, margin: int | Column = 1000, least_mapq: int = 0, least_size: int = 750, most_size: int = 1_000_000) -> DataFrame:
    """(key, side, read_name, evidence, seq) of supporting_reads and the mates of the discordant ones."""
    found = supporting_reads(calls, reads, key, kind, margin, least_mapq, least_size, most_size)
    own = found.select(c("call_key").alias(key), "side", "read_name", "evidence", "seq")
    return own.unionByName(mates_of(found, reads).select(c("call_key").alias(key), "side", "read_name", F.lit("mate").alias("evidence"), "seq"))


def evidence_points() -> Column:
    """How strong a class of evidence is, for ordering reads of a call."""
    return points((c("evidence") == "split", 4), (c("evidence") == "discordant", 3), (c("evidence") == "indel", 2), (c("evidence").isin("clip", "semi"), 1))
