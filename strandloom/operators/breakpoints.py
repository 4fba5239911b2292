"""Breakpoints from reads: events inside alignments and junctions between the alignments of a read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import CONTIGS, DEFAULT, Config
from strandloom.functions import cigar
from strandloom.functions.columns import INSERTION, nearby

COLUMNS = [
    "start_chr", "start_loc", "end_chr", "end_loc", "is_nearby_event", "inserted_sequence", "insert_length", "source",
    "read_name", "mapq", "sample", "breakpoint_notation", "haplotype_start", "haplotype_end", "phase_set_start", "phase_set_end",
]


def contig_ordinal(contig: Column) -> Column:
    """Place of a contig in the canonical order, from 1; 0 for others."""
    return F.array_position(F.array(*[F.lit(x) for x in CONTIGS]), contig)


def build(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Complete breakpoint rows; the insert's length is that of its sequence unless given."""
    out = rows
    if "insert_length" not in rows.columns:
        out = out.withColumn("insert_length", F.coalesce(F.length("inserted_sequence"), F.lit(0)).cast("bigint"))
    near = nearby(F.col("start_chr"), F.col("start_loc"), F.col("end_chr"), F.col("end_loc"), config.nearby)
    return out.withColumn("is_nearby_event", F.coalesce(near, F.lit(False))).select(*COLUMNS)


def phasing(reads: DataFrame) -> DataFrame:
    """haplotype and phase_set from the HP and PS tags of primary alignments."""
    primary = ~(F.col("is_supplementary") | F.col("is_secondary"))
    return reads.withColumns({"haplotype": F.when(primary, F.col("hp")), "phase_set": F.when(primary, F.col("ps"))})


def indel_breakpoints(reads: DataFrame, least: Column, config: Config = DEFAULT) -> DataFrame:
    """One row for each merged deletion (+-) or insertion of a read, of at least so many bases.

    reads: read_name, contig, start, mapq, sample, cigar, seq, haplotype, phase_set.
    """
    ops = cigar.operations(F.col("cigar"))
    deletions = cigar.merge(cigar.events(ops, F.col("start"), "D", least), config.cigar_gap)
    inserts = cigar.merge(cigar.insert_sequence(F.col("seq"), cigar.events(ops, F.col("start"), "I", least)), config.cigar_gap, sequences=True)
    base = ["read_name", "contig", "mapq", "sample", "haplotype", "phase_set"]
    deleted = reads.select(*base, F.explode(deletions).alias("e")).select(*base, F.lit("+-").alias("breakpoint_notation"), F.col("e.start").alias("start_loc"), F.col("e.end").alias("end_loc"), F.lit(None).cast("string").alias("inserted_sequence"), F.lit(0).cast("bigint").alias("insert_length"))
    inserted = reads.select(*base, F.explode(inserts).alias("e")).select(*base, F.lit(INSERTION).alias("breakpoint_notation"), F.col("e.start").alias("start_loc"), F.col("e.start").alias("end_loc"), F.col("e.seq").alias("inserted_sequence"), F.col("e.len").alias("insert_length"))
    rows = deleted.unionByName(inserted)
    both = {f"{name}_{end}": F.col(name) for name in ("haplotype", "phase_set") for end in ("start", "end")}
    return build(rows.withColumns({"start_chr": F.col("contig"), "end_chr": F.col("contig"), "source": F.lit("CIGAR"), **both}), config)


def split_alignments(reads: DataFrame, least_mapq: Column | int) -> DataFrame:
    """One row for each alignment in the SA tag with mapping quality above the limit on a known contig."""
    part = F.split(F.col("sa_part"), ",")
    rows = reads.select("read_name", "sample", F.explode(F.filter(F.split("sa", ";"), lambda x: x != "")).alias("sa_part"))
    rows = rows.select("read_name", "sample", F.get(part, F.lit(0)).alias("contig"), F.get(part, F.lit(1)).try_cast("bigint").alias("ref_start"), (F.get(part, F.lit(2)) == "-").alias("is_reverse"), F.get(part, F.lit(3)).alias("cigar"), F.get(part, F.lit(4)).try_cast("int").alias("mapq"))
    return rows.where((F.col("mapq") > least_mapq) & (contig_ordinal(F.col("contig")) > 0))


def all_alignments(reads: DataFrame, least_mapq: Column | int) -> DataFrame:
    """Primary and split alignments of reads with an SA tag, with their place ord in the read.

    ref_start of a split alignment is the position as it stands in the tag.
    """
    split = split_alignments(reads.where("sa is not null"), least_mapq).withColumn("is_primary", F.lit(False))
    primary = reads.where("sa is not null").select("read_name", "sample", "contig", F.col("start").alias("ref_start"), "is_reverse", "cigar", "mapq", F.lit(True).alias("is_primary"))
    rows = split.unionByName(primary).withColumn("a", cigar.summary(F.col("cigar"), F.col("ref_start"), F.col("is_reverse")))
    rows = rows.select("read_name", "sample", "contig", "is_reverse", "mapq", "is_primary", F.col("a.ref_start").alias("ref_start"), F.col("a.ref_end").alias("ref_end"), F.col("a.query_start").alias("query_start"), F.col("a.query_end").alias("query_end"))
    return order_alignments(rows)


def in_read() -> Window:
    return Window.partitionBy("sample", "read_name").orderBy("query_start", "query_end", "is_primary", "contig", "ref_start", "is_reverse")


def order_alignments(rows: DataFrame) -> DataFrame:
    """Alignments of a read in query order; the split ones come before the primary where spans are equal."""
    return rows.withColumn("ord", F.row_number().over(in_read()))


def breakpoint_pairs(alignments: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Both ends of each junction between neighbouring alignments of a read.

    An end is where its alignment leaves the junction: the reference end on the forward strand and the start
    on the reverse for the first, the other way round for the second. Reliable ends map well to a known contig.
    """
    order = in_read()
    second = {x: F.lead(x).over(order) for x in ("contig", "ref_start", "ref_end", "is_reverse", "mapq", "is_primary", "query_start", "query_end")}
    rows = alignments.withColumns({f"next_{k}": v for k, v in second.items()}).where("next_contig is not null")
    reliable = lambda mapq, contig: (F.col(mapq) >= config.reliable_mapq) & (contig_ordinal(F.col(contig)) > 0)
    return rows.select(
        "sample", "read_name", "ord",
        F.col("contig").alias("first_chr"),
        F.when(F.col("is_reverse"), F.col("ref_start")).otherwise(F.col("ref_end")).alias("first_loc"),
        F.when(F.col("is_reverse"), F.lit("-")).otherwise(F.lit("+")).alias("first_sign"),
        reliable("mapq", "contig").alias("first_reliable"),
        F.col("is_primary").alias("first_primary"),
        F.col("query_start").alias("first_query_start"),
        F.col("query_end").alias("first_query_end"),
        F.col("next_contig").alias("second_chr"),
        F.when(F.col("next_is_reverse"), F.col("next_ref_end")).otherwise(F.col("next_ref_start")).alias("second_loc"),
        F.when(F.col("next_is_reverse"), F.lit("+")).otherwise(F.lit("-")).alias("second_sign"),
        reliable("next_mapq", "next_contig").alias("second_reliable"),
        F.col("next_is_primary").alias("second_primary"),
        F.col("next_query_start").alias("second_query_start"),
        F.col("next_query_end").alias("second_query_end"),
        F.least("mapq", "next_mapq").alias("mapq"),
    )


def canonical_junctions(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Reliable junctions with their ends in genome order; a short -+ on one contig is an insertion.

    phased_end tells which end is that of the primary alignment; query_from and query_to span the insert.
    """
    same = F.col("first_chr") == F.col("second_chr")
    swap = F.when(same, F.col("first_loc") > F.col("second_loc")).otherwise(contig_ordinal(F.col("first_chr")) > contig_ordinal(F.col("second_chr")))
    rows = pairs.where("first_reliable and second_reliable").withColumn("swap", swap)
    pick = lambda a, b: F.when(F.col("swap"), F.col(b)).otherwise(F.col(a))
    rows = rows.select(
        "sample", "read_name", "ord", "mapq",
        pick("first_chr", "second_chr").alias("start_chr"),
        pick("first_loc", "second_loc").alias("start_loc"),
        pick("second_chr", "first_chr").alias("end_chr"),
        pick("second_loc", "first_loc").alias("end_loc"),
        F.concat(pick("first_sign", "second_sign"), pick("second_sign", "first_sign")).alias("sign"),
        F.when(pick("first_primary", "second_primary"), F.lit("start")).otherwise(F.lit("end")).alias("phased_end"),
        pick("first_query_start", "second_query_start").alias("query_from"),
        pick("second_query_end", "first_query_end").alias("query_to"),
    )
    insert = (F.col("start_chr") == F.col("end_chr")) & (F.col("sign") == "-+") & (F.col("end_loc") - F.col("start_loc") < config.split_insert_span)
    rows = rows.withColumn("breakpoint_notation", F.when(insert, F.lit(INSERTION)).otherwise(F.col("sign")))
    return rows.withColumn("end_loc", F.when(insert, F.col("start_loc")).otherwise(F.col("end_loc"))).drop("sign")


def tandem_duplications(alignments: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Pairs of alignments of a read that overlap on the reference in the same direction: -+ on the overlap."""
    a, b = alignments.alias("a"), alignments.alias("b")
    one_read = (F.col("a.sample") == F.col("b.sample")) & (F.col("a.read_name") == F.col("b.read_name"))
    alike = (F.col("a.contig") == F.col("b.contig")) & (F.col("a.is_reverse") == F.col("b.is_reverse")) & (F.col("a.ord") < F.col("b.ord"))
    low, high = F.greatest("a.ref_start", "b.ref_start"), F.least("a.ref_end", "b.ref_end")
    rows = a.join(b, one_read & alike & (high - low >= config.tandem_overlap))
    return rows.select(
        F.col("a.sample").alias("sample"), F.col("a.read_name").alias("read_name"), F.least("a.mapq", "b.mapq").alias("mapq"),
        F.col("a.contig").alias("start_chr"), low.alias("start_loc"), F.col("a.contig").alias("end_chr"), high.alias("end_loc"),
        F.lit("-+").alias("breakpoint_notation"), F.when(F.col("a.is_primary"), F.lit("start")).otherwise(F.lit("end")).alias("phased_end"),
    )


def split_breakpoints(reads: DataFrame, least_mapq: Column | int, config: Config = DEFAULT) -> DataFrame:
    """Breakpoints from the split alignments of primary reads: tandem duplications and junctions."""
    primary = reads.where("not is_supplementary and not is_secondary and sa is not null")
    alignments = all_alignments(primary, least_mapq)
    junctions = canonical_junctions(breakpoint_pairs(alignments, config), config).drop("ord")
    duplications = tandem_duplications(alignments, config).withColumns({"query_from": F.lit(None).cast("bigint"), "query_to": F.lit(None).cast("bigint")})
    found = junctions.unionByName(duplications)
    facts = primary.select("sample", "read_name", "seq", "haplotype", "phase_set").dropDuplicates(["sample", "read_name"])
    rows = found.join(facts, ["sample", "read_name"])
    insert = F.when(F.col("breakpoint_notation") == INSERTION, F.substring(F.col("seq"), (F.col("query_from") + 1).cast("int"), F.greatest(F.lit(0), F.col("query_to") - F.col("query_from")).cast("int")))
    ends = {f"{name}_{end}": F.when(F.col("phased_end") == end, F.col(name)) for name in ("haplotype", "phase_set") for end in ("start", "end")}
    return build(rows.withColumns({"source": F.lit("SUPPLEMENTARY"), "inserted_sequence": insert, **ends}), config)


def extract_breakpoints(reads: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """All breakpoints of usable reads of both samples; limits depend on the sample."""
    by_sample = lambda f: F.when(F.col("sample") == "normal", F.lit(f("normal"))).otherwise(F.lit(f("tumor")))
    least, mapq = by_sample(config.sample_length), by_sample(config.sample_mapq)
    used = phasing(reads.where("not is_unmapped"))
    if config.platform == "HIFI":
        used = used.where(~F.col("is_secondary") & (F.col("mapq") >= mapq))
    indels = indel_breakpoints(used, least, config)
    return indels.unionByName(split_breakpoints(used.where(F.col("mapq") >= mapq), mapq, config))


def contig_breakpoints(alignments: DataFrame, least: int, least_mapq: int, config: Config = DEFAULT) -> DataFrame:
    """Breakpoints of assembled contigs: as of reads, without phasing, on known contigs, in genome order."""
    bare = alignments.withColumns({"hp": F.lit(None).cast("int"), "ps": F.lit(None).cast("bigint")})
    used = phasing(bare.where("not is_unmapped and not is_secondary").where(F.col("mapq") >= least_mapq))
    rows = indel_breakpoints(used, F.lit(least), config).unionByName(split_breakpoints(used, F.lit(least_mapq), config))
    return rows.where(contig_ordinal(F.col("start_chr")) > 0).orderBy(contig_ordinal(F.col("start_chr")), "start_loc")
