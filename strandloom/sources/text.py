"""Text sources: sequence index and sequences, variant records, regions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.config import CONTIGS
from strandloom.operators.stages import settle
from strandloom.sources.bgzf import open_input

#: Bases that a task reads at a time from an indexed FASTA file.
RANGE = 4_000_000
_INDEX = "contig string, length bigint, place bigint, bases int, width int"


def contig_index(spark: SparkSession, path: str) -> DataFrame:
    """(contig, length) of a sequence index (.fai)."""
    return spark.read.schema(_INDEX).csv(path, sep="\t").select("contig", "length")


def known_contigs(lengths: DataFrame) -> DataFrame:
    """The contigs of the analysis among those of an index."""
    return lengths.where(F.col("contig").isin(CONTIGS))


def contig_chunks(lengths: DataFrame, size: int) -> DataFrame:
    """(contig, chunk_start, chunk_end): half-open pieces of at most size."""
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint")))
    rows = lengths.where("length > 0").select("contig", "length", starts.alias("chunk_start"))
    return rows.select("contig", "chunk_start", F.least(F.col("chunk_start") + size, F.col("length")).alias("chunk_end"))


def sequence_chunks(spark: SparkSession, path: str, size: int = 10_000, span: int = RANGE) -> DataFrame:
    """(contig, chunk, sequence): FASTA files without an index cut to chunks of so many bases.

    Tasks read spans of bytes and give the bases of each record in them; one row a span tells which record
    the next one goes on with and at which base, so a record of any length is spread over many tasks. Only a
    line belongs to one task, which reads it in pieces. A compressed file is read whole, a record a row.

    Defined cases: white space in sequences is left out; a record without bases is one empty chunk; records
    of one name stay apart; bases before the first header are an error.
    """
    if path.endswith((".gz", ".bz2", ".zst")):
        return _whole_records(spark, path, size)
    spans = spark.read.format("binaryFile").load(path).select("path", F.explode(F.expr(f"sequence(0L, greatest(length - 1, 0L), {int(span)}L)")).alias("from"))
    n = spans.count()
    dealt = spans.repartition(max(1, min(n, 10_000)), "path", "from")
    pieces = settle(dealt.mapInArrow(_pieces(span, size), "path string, `from` bigint, piece bigint, contig string, bases string"), "sequence-pieces")

    # places are counted in bases from the start of the file; start: that of the record's first base
    record = lambda x: F.struct(F.col(f"{x}.contig").alias("contig"), (F.col("before") + F.col(f"{x}.at")).alias("start"), F.col("from").alias("span"), F.col(f"{x}.piece").alias("piece"))
    inside = Window.partitionBy("path", "from").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lengths = pieces.select("path", "from", "piece", "contig", F.length("bases").cast("bigint").alias("n"))
    lengths = lengths.withColumn("at", F.sum("n").over(inside) - F.col("n"))
    header = F.when(F.col("contig").isNotNull(), F.struct("contig", "at", "piece"))
    lengths = lengths.withColumn("own", F.last(header, ignorenulls=True).over(inside))
    earlier = Window.partitionBy("path").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)
    totals = lengths.groupBy("path", "from").agg(F.sum("n").alias("n"), F.max_by("own", "piece").alias("last"))
    totals = totals.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    opened = F.when(F.col("last").isNotNull(), record("last"))
    totals = totals.withColumn("carried", F.last(opened, ignorenulls=True).over(earlier)).select("path", "from", "before", "carried")
    own = F.when(F.col("own").isNotNull(), record("own"))
    placed = lengths.join(totals, ["path", "from"]).withColumn("record", F.coalesce(own, "carried"))
    placed = placed.select("path", "from", "piece", "record", (F.col("before") + F.col("at") - F.col("record.start")).alias("at"))
    cut = pieces.select("path", "from", "piece", "bases").join(placed, ["path", "from", "piece"])
    first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + F.greatest(F.length("bases"), F.lit(1)) - 1) / size)
    cut = cut.withColumn("chunk", F.explode(F.sequence(first, last)))
    low = F.greatest(F.lit(0), F.col("chunk") * size - F.col("at"))
    part = F.substring("bases", (low + 1).cast("int"), ((F.col("chunk") + 1) * size - F.col("at") - low).cast("int"))
    parts = cut.groupBy("path", "record", "chunk").agg(F.array_sort(F.collect_list(F.struct("from", "piece", part.alias("s")))).alias("parts"))
    return parts.select("record.contig", "chunk", F.array_join(F.col("parts.s"), "").alias("sequence"))


def _pieces(span: int, size: int):
    """Reader of spans of bytes: rows of at most size bases of the records in the lines that start there."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = 0
                with open_input(r["path"]) as file:
                    for i, (contig, bases) in enumerate(_span_records(file, r["from"], r["from"] + span)):
                        if contig is None and r["from"] == i == 0:
                            raise ValueError(f"{r['path']} has bases before its first header")
                        cut = [bases[j : j + size].decode("latin-1") for j in range(0, max(len(bases), 1), size)]
                        whole = {"path": [r["path"]] * len(cut), "from": pa.array([r["from"]] * len(cut), pa.int64()), "piece": pa.array(range(n, n + len(cut)), pa.int64())}
                        yield pa.RecordBatch.from_pydict(whole | {"contig": pa.array([contig] + [None] * (len(cut) - 1), pa.string()), "bases": cut})
                        n += len(cut)

    return read


def _span_records(file, low: int, high: int) -> Iterator[tuple[str | None, bytes]]:
    """(name of a record that starts here, or None where one goes on; bases) of the lines that start in bytes low to high."""
    bare = lambda text: text.translate(None, b" \t\r\n\v\f")
    begin = max(low - 1, 0)
    file.seek(begin)
    data = bytes(file.read(high - begin))
    if low > 0:  # a line that starts before belongs to the span before
        data = data[data.find(b"\n") + 1 :] if b"\n" in data else b""
    if not data:
        return

    def rest() -> Iterator[bytes]:
        while block := bytes(file.read(1 << 20)):
            line, newline, _ = block.partition(b"\n")
            yield line
            if newline:
                return

    is_open = not data.endswith(b"\n")
    starts = [m.start() for m in re.finditer(rb"^>", data, re.M)]
    if bases := bare(data[: starts[0]] if starts else data):
        yield None, bases
    for start, end in zip(starts, [*starts[1:], len(data)]):
        title, newline, sequence = data[start + 1 : end].partition(b"\n")
        if not newline and is_open:  # the last line is a header that ends beyond the span
            title, is_open = title + b"".join(rest()), False
        yield re.split(rb"\s", title, maxsplit=1)[0].decode("latin-1"), bare(sequence)
    if is_open:
        yield from ((None, bases) for line in rest() if (bases := bare(line)))


def _whole_records(spark: SparkSession, path: str, size: int) -> DataFrame:
    records = spark.read.text(path, lineSep=">").where("length(trim(value)) > 0")
    name = F.split(F.substring_index("value", "\n", 1), r"\s")[0]
    body = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "")
    rows = records.select(name.alias("contig"), body.alias("bases"))
    # one pass over the record: places in a string are found by walking it
    pieces = F.when(F.col("bases") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("bases", F.lit(f".{{1,{size}}}"), F.lit(0)))
    return rows.select("contig", F.posexplode(pieces).alias("chunk", "sequence")).select("contig", F.col("chunk").cast("bigint").alias("chunk"), "sequence")


def indexed_chunks(spark: SparkSession, path: str, contigs: list[str] | None = None, size: int = 10_000) -> DataFrame:
    """The chunks of sequence_chunks for the given contigs (or all), read by the byte ranges that path.fai gives.

    Every task reads RANGE bases of a contig, whatever the contig's length.
    """
    index = spark.read.schema(_INDEX).csv(path + ".fai", sep="\t").where("length > 0 and bases > 0")
    if contigs is not None:
        index = index.where(F.col("contig").isin(contigs))
    step = max(1, RANGE // size) * size
    ranges = index.withColumn("from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(step).cast("bigint"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open_input(path) as file:
            for batch in batches:
                for r in batch.to_pylist():
                    low, high = r["from"], min(r["from"] + step, r["length"])
                    byte = lambda i: r["place"] + i // r["bases"] * r["width"] + i % r["bases"]  # noqa: B023, E731
                    file.seek(byte(low))
                    raw = bytes(file.read(byte(high - 1) + 1 - byte(low)))
                    sequence = raw.translate(None, b"\r\n\t ").decode("latin-1")
                    if len(sequence) != high - low:
                        raise ValueError(f"the index of {path} does not fit {r['contig']}")
                    starts = range(0, len(sequence), size)
                    yield pa.RecordBatch.from_pydict({"contig": pa.array([r["contig"]] * len(starts)), "chunk": pa.array([(low + i) // size for i in starts], pa.int64()), "sequence": pa.array([sequence[i : i + size] for i in starts])})

    n = ranges.count()
    dealt = ranges.repartition(max(1, min(n, 10_000)), "contig", "from")
    return dealt.mapInArrow(read, "contig string, chunk bigint, sequence string")


def bases_at(rows: DataFrame, chunks: DataFrame, contig: str, position: str, name: str, size: int = 10_000) -> DataFrame:
    """rows with the base at a 1-based position; N beyond the sequence and for unknown letters."""
    at = chunks.select(F.col("contig").alias("__contig"), F.col("chunk").alias("__chunk"), F.col("sequence").alias("__sequence"))
    same = (F.col(contig) == F.col("__contig")) & (F.floor((F.col(position) - 1) / size) == F.col("__chunk"))
    base = F.substring("__sequence", F.pmod(F.col(position) - 1, F.lit(size)).cast("int") + 1, F.lit(1))
    known = F.when(F.upper(base).isin("A", "C", "G", "T", "N"), base)
    return rows.join(at, same, "left").withColumn(name, F.coalesce(known, F.lit("N"))).drop("__contig", "__chunk", "__sequence")


def spans(rows: DataFrame, chunks: DataFrame, key: str, contig: str, low: str, high: str, size: int = 10_000) -> DataFrame:
    """(key, sequence) of the half-open, 0-based spans."""
    wide = rows.select(key, F.col(contig).alias("contig"), F.col(low).alias("lo"), F.col(high).alias("hi")).where("hi > lo")
    wide = wide.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    met = wide.join(chunks, ["contig", "chunk"])
    begin = F.greatest(F.lit(0), F.col("lo") - F.col("chunk") * size)
    part = F.substring("sequence", (begin + 1).cast("int"), (F.least(F.lit(size), F.col("hi") - F.col("chunk") * size) - begin).cast("int"))
    pieces = met.select(key, F.struct("chunk", part.alias("s")).alias("p")).groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return pieces.select(key, F.array_join(F.transform("ps", lambda p: p["s"]), "").alias("sequence"))


def info_map(info: Column) -> Column:
    """INFO text as a map; a flag has the value 'true'."""
    parts = F.filter(F.split(F.when(info != ".", info), ";"), lambda x: x != "")
    entry = lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise(F.lit("true")).alias("value"))
    # of repeated keys the last counts
    entries = F.transform(parts, entry)
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(F.coalesce(last, F.array().cast("array<struct<key:string,value:string>>")))


def info_fields(spark: SparkSession, path: str) -> list[str]:
    """Names of the declared INFO fields, in order (of the header only)."""
    lines = spark.read.text(path).where(F.col("value").startswith("##INFO="))
    return [r.id for r in lines.select(F.regexp_extract("value", r"ID=([^,>]+)", 1).alias("id")).collect()]


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variant records (chrom, pos, id, ref, alt, qual, filter, info map, info_text, format, sample)."""
    part = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).where(F.size(part) >= 8)
    names = ["chrom", "pos", "id", "ref", "alt", "qual", "filter"]
    fixed = [F.get(part, F.lit(i)).alias(n) if n != "pos" else F.get(part, F.lit(i)).cast("bigint").alias(n) for i, n in enumerate(names)]
    return rows.select(*fixed, info_map(F.get(part, F.lit(7))).alias("info"), F.get(part, F.lit(7)).alias("info_text"), F.try_element_at(part, F.lit(9)).alias("format"), F.try_element_at(part, F.lit(10)).alias("sample"))


def sample_names(spark: SparkSession, path: str) -> list[str]:
    lines = spark.read.text(path).where(F.col("value").startswith("#CHROM")).take(1)
    return lines[0].value.split("\t")[9:] if lines else []


def read_single_sample(spark: SparkSession, path: str) -> DataFrame:
    """One row a variant with the INFO fields that the header declares as columns; exactly one sample."""
    samples = sample_names(spark, path)
    if len(samples) != 1:
        raise ValueError(f"one sample per file: {len(samples)} in {path}")
    info = lambda k: F.try_element_at("info", F.lit(k))
    rows = read_vcf(spark, path)
    base = {
        "sample_name": F.lit(samples[0]),
        "chr2": F.coalesce(info("CHR2"), F.col("chrom")),
        "end_pos": F.coalesce(info("END").try_cast("bigint"), F.col("pos")),
        "svlen": F.coalesce(info("SVLEN").try_cast("bigint"), F.lit(0)),
        "svtype": F.coalesce(info("SVTYPE"), F.lit("")),
    }
    return rows.withColumns(base).select(*rows.columns, *base, *[info(f).alias(f"INFO_{f}") for f in info_fields(spark, path)])


def shape_features(rows: DataFrame) -> DataFrame:
    """Rows of read_single_sample with pairs taken apart (_0, _1), spread ratios and a number for the type."""
    out = {}
    pairs = [f"INFO_{s}_{f}" for s in ("TUMOR", "NORMAL") for f in ("DP_BEFORE", "DP_AT", "DP_AFTER", "AF")]
    for name in (p for p in pairs if p in rows.columns):
        parts = F.split(F.when(F.col(name) != "", F.col(name)), ",")
        first = F.coalesce(F.get(parts, F.lit(0)), F.lit("0"))
        second = F.when(F.size(parts) > 1, F.when(F.get(parts, F.lit(1)) != "", F.get(parts, F.lit(1))))
        clean = lambda x: F.when(x.isin("inf", "-inf"), F.lit("-1")).otherwise(x)
        out |= {f"{name[5:]}_0": clean(first), f"{name[5:]}_1": clean(F.coalesce(second, first))}
    for end in ("ORIGIN", "END"):
        std, mean = f"INFO_{end}_STARTS_STD_DEV", f"INFO_{end}_EVENT_SIZE_MEAN"
        known = std in rows.columns and mean in rows.columns
        out[f"{end}_STD_MEAN_RATIO"] = F.coalesce(F.col(std).try_cast("double") / (F.col(mean).try_cast("double") + 1.0), F.lit(0.0)) if known else F.lit(0.0)
    codes = F.create_map(F.lit("BND"), F.lit(0), F.lit("INS"), F.lit(1), F.lit("SBND"), F.lit(2))
    out["SVTYPE_NUM"] = F.coalesce(F.try_element_at(codes, F.col("svtype")), F.lit(-1))
    return rows.withColumns(out)


def numbers_in(values: Column) -> Column:
    """The items of a comma-separated list, without empty ones."""
    return F.filter(F.split(values, ","), lambda v: v != "")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Known regions of at least eleven columns; comment and short lines are left out."""
    names = ["cluster_size int", "mean_pos double", "std_dev double", "mean_quality double", "support_reads_tumor int", "support_reads_normal int", "strand_ratio_tumor double", "strand_ratio_normal double"]
    part = F.split(F.trim("value"), "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).where(F.size(part) >= 11)
    typed = [F.get(part, F.lit(i + 3)).cast(n.split()[1]).alias(n.split()[0]) for i, n in enumerate(names)]
    return rows.select(F.get(part, F.lit(0)).alias("contig"), F.get(part, F.lit(1)).cast("bigint").alias("start"), F.get(part, F.lit(2)).cast("bigint").alias("end"), *typed)
