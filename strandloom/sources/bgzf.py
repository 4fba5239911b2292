"""Alignment files: blocks, records, a Python data source with splits, and a writer for tests and exports."""

from __future__ import annotations

import bisect
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

# Fixed values of the format: operation letters, base letters, flag bits.
OPERATIONS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
FLAGS = {"is_paired": 0x1, "is_unmapped": 0x4, "mate_unmapped": 0x8, "is_reverse": 0x10, "mate_reverse": 0x20, "is_read1": 0x40, "is_secondary": 0x100, "is_qcfail": 0x200, "is_duplicate": 0x400, "is_supplementary": 0x800}
TAG_SIZES = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
#: A base is four bits, so a hexadecimal digit; qualities are written from 33 on.
_LETTERS, _SHIFTED = str.maketrans("0123456789abcdef", BASES), bytes((i + 33) & 0xFF for i in range(256))
_ON_REFERENCE, _ON_QUERY = {0, 2, 3, 7, 8}, {0, 1, 4, 7, 8}

SCHEMA = (
    "read_name string, flag int, contig string, start bigint, end bigint, mapq int, cigar string, mate_contig string, mate_start bigint, "
    "template_length bigint, seq string, qual string, query_length bigint, hp int, ps bigint, sa string, mc string, "
    + ", ".join(f"{f} boolean" for f in FLAGS)
)
_ARROW = pa.schema(
    [(n, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))]
)


def open_input(path: str):
    """A seekable stream of a local or remote file."""
    if "://" not in path or path.startswith("file:"):
        return open("/" + path[5:].lstrip("/") if path.startswith("file:") else path, "rb")
    import pyarrow.fs as fs

    store, plain = fs.FileSystem.from_uri(path)
    return store.open_input_file(plain)


#: Merged regions that are read by the index; with more, nearly every block would be wanted and the file is read whole.
MOST_REGIONS = 200_000
#: The bin of a .bai file that holds counts, and the first bin of each level with the bits of a position that a bin covers.
_COUNTS, _LEVELS = 37450, ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))


@dataclass(frozen=True)
class ContigIndex:
    """What a .bai file says of a contig: offsets of records are virtual (block and place in it)."""

    linear: list[int]
    bins: dict[int, list[tuple[int, int]]]
    #: First bin of each level and the bits of a position that its bins cover.
    levels: tuple[tuple[int, int], ...] = _LEVELS

    @property
    def begin(self) -> int:
        known = [x for x in self.linear if x]
        return min([a for chunks in self.bins.values() for a, _ in chunks] or known or [0])

    @property
    def end(self) -> int:
        known = any(self.linear)
        return max([b for chunks in self.bins.values() for _, b in chunks] or [1 << 62 if known else 0])

    def chunks(self, low: int, high: int) -> list[tuple[int, int]]:
        """Ranges of offsets that hold every record that overlaps [low, high)."""
        low, high = max(0, low), min(high, 1 << self.levels[0][1])
        if high <= low:
            return []
        if not self.bins:
            return [(self.begin, self.end)] if any(self.linear) else []
        window = low >> 14
        if self.linear and window >= len(self.linear):
            return []  # no record reaches that far
        # records before the first that overlaps the window end before it
        least = self.linear[window] if self.linear else 0
        wanted = [n for first, bits in self.levels for n in range(first + (low >> bits), first + ((high - 1) >> bits) + 1) if n in self.bins]
        return [(max(a, least), b) for n in wanted for a, b in self.bins[n] if b > least]


def read_index(data: bytes) -> list[ContigIndex]:
    """Of each contig in a .bai file: the linear index (a virtual offset for each 2^14 bases) and the chunks of each bin."""
    if data[:4] != b"BAI\x01":
        raise ValueError("not an index")
    out, at = [], 8
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        n_bins = struct.unpack_from("<i", data, at)[0]
        at += 4
        bins = {}
        for _ in range(n_bins):
            number, n = struct.unpack_from("<Ii", data, at)
            if number != _COUNTS:
                bins[number] = [struct.unpack_from("<QQ", data, at + 8 + 16 * i) for i in range(n)]
            at += 8 + 16 * n
        windows = struct.unpack_from("<i", data, at)[0]
        out.append(ContigIndex(list(struct.unpack_from(f"<{windows}Q", data, at + 4)), bins))
        at += 4 + 8 * windows
    return out


def read_wide_index(data: bytes) -> list[ContigIndex]:
    """The same from a .csi file (its plain bytes), whose bins can cover longer contigs; it has no linear index."""
    if data[:4] != b"CSI\x01":
        raise ValueError("not an index")
    shift, depth, extra = struct.unpack_from("<iii", data, 4)
    levels = tuple((((1 << 3 * level) - 1) // 7, shift + 3 * (depth - level)) for level in range(depth + 1))
    counts, out, at = ((1 << 3 * (depth + 1)) - 1) // 7 + 1, [], 16 + extra
    n_contigs = struct.unpack_from("<i", data, at)[0]
    at += 4
    for _ in range(n_contigs):
        n_bins = struct.unpack_from("<i", data, at)[0]
        at += 4
        bins = {}
        for _ in range(n_bins):
            number, _, n = struct.unpack_from("<IQi", data, at)
            if number != counts:
                bins[number] = [struct.unpack_from("<QQ", data, at + 16 + 16 * i) for i in range(n)]
            at += 16 + 16 * n
        out.append(ContigIndex([], bins, levels))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans of which none overlap or touch."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def index_offsets(data: bytes) -> list[int]:
    """Virtual offsets of records in the linear indexes of a .bai file, sorted."""
    return sorted({x for contig in read_index(data) for x in contig.linear if x})


def wanted_ranges(index: list[ContigIndex], numbers: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Ranges of virtual offsets that hold all records of the contigs that start in [low, high)."""
    out = []
    for i in numbers:
        linear, begin, end = index[i].linear, index[i].begin, index[i].end
        if end <= begin or high <= 0:
            continue
        # records that start at low or later lie at or behind the first that overlaps its window
        window = max(0, low) >> 14
        later = [x for x in linear[window : window + 1] if x] or [x for x in linear[window:] if x][:1]
        if window < len(linear) or not linear:
            out.append((max(begin, later[0]) if later else begin, end))
    return sorted(out)


class Blocks:
    """Decompressed bytes of a blocked gzip file from a block's offset on."""

    def __init__(self, file, at: int = 0):
        self.file, self.next, self.data, self.place, self.block_at = file, at, b"", 0, at

    def _load(self) -> bool:
        self.file.seek(self.next)
        head = self.file.read(18)
        if len(head) < 18:
            return False
        if head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("no block at this offset")
        n_extra, size, at = struct.unpack_from("<H", head, 10)[0], None, 12
        extra = head[12:18] + self.file.read(max(0, n_extra - 6))
        x = 0
        while x + 4 <= n_extra:
            length = struct.unpack_from("<H", extra, x + 2)[0]
            if extra[x : x + 2] == b"BC":
                size = struct.unpack_from("<H", extra, x + 4)[0] + 1
            x += 4 + length
        if size is None:
            raise ValueError("a block without its size")
        body = self.file.read(size - at - n_extra)
        self.block_at, self.next, self.data, self.place = self.next, self.next + size, zlib.decompress(body[:-8], -15), 0
        return True

    def read(self, n: int) -> bytes:
        out = self.data[self.place : self.place + n]
        self.place += len(out)
        if len(out) == n:
            return out
        parts, left = [out], n - len(out)
        while left:
            if self.place >= len(self.data) and not self._load():
                break
            part = self.data[self.place : self.place + left]
            self.place += len(part)
            left -= len(part)
            parts.append(part)
        return b"".join(parts)

    def tell(self) -> tuple[int, int]:
        """Block and place in it of the next byte."""
        while self.place >= len(self.data):
            if not self._load():
                return self.next, 0
        return self.block_at, self.place


def _plain_blocks(file) -> Iterator[bytes]:
    blocks = Blocks(file)
    while blocks._load():
        yield blocks.data


def first_block(file, begin: int, end: int) -> int | None:
    """The first block that starts in [begin, end): a header behind whose length the next header or the file's end lies."""
    file.seek(0, 2)
    size, step = file.tell(), 1 << 17
    is_head = lambda data, i: data[i : i + 4] == b"\x1f\x8b\x08\x04" and data[i + 12 : i + 16] == b"BC\x02\x00"
    at = begin
    while at < end:
        file.seek(at)
        data = bytes(file.read(step + 18))
        i = data.find(b"\x1f\x8b\x08\x04")
        while 0 <= i < step and at + i < end:
            if is_head(data, i):
                follow = at + i + struct.unpack_from("<H", data, i + 16)[0] + 1
                file.seek(follow)
                if follow == size or is_head(bytes(file.read(18)), 0):
                    return at + i
            i = data.find(b"\x1f\x8b\x08\x04", i + 1)
        at += step
    return None


def _plausible(data: bytes, at: int, n_contigs: int) -> int | None:
    """The length of what may be a record at a place, with its length field; None if it is none."""
    size, ref, pos, n_name, _, _, n_ops, _, n_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (-1 <= ref < n_contigs and -1 <= mate < n_contigs and pos >= -1 and mate_pos >= -1 and n_name and n_seq >= 0):
        return None
    if 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq > size:
        return None
    name = data[at + 36 : at + 36 + n_name]
    return size + 4 if name[-1:] in (b"\0", b"") and all(33 <= x <= 126 for x in name[:-1]) else None


def first_record(file, begin: int, end: int, n_contigs: int, chain: int = 8) -> int | None:
    """Virtual offset of the first record that starts in a block of [begin, end); None if there is none.

    A place counts as a record's start if as many plausible records follow each other from it, or all to the file's end.
    """
    block = first_block(file, begin, end)
    if block is None:
        return None
    reach = 1 << 18
    while True:
        blocks = Blocks(file, block)
        data = blocks.read(reach)
        last = len(data) < reach
        for at in range(max(0, len(data) - 36)):
            place, n = at, 0
            while n < chain and place + 36 <= len(data):
                size = _plausible(data, place, n_contigs)
                if size is None:
                    break
                place, n = place + size, n + 1
            if n == chain or (n and last and place == len(data)):
                blocks = Blocks(file, block)
                blocks.read(at)
                found, spot = blocks.tell()
                return (found << 16) | spot
        if last:
            return None
        reach *= 4  # records longer than what was read


def read_header(blocks: Blocks) -> tuple[str, list[tuple[str, int]]]:
    """Header text and (contig, length) in the order of the file."""
    if blocks.read(4) != b"BAM\x01":
        raise ValueError("not an alignment file")
    text = blocks.read(struct.unpack("<i", blocks.read(4))[0]).decode().rstrip("\0")
    contigs = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        contigs.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return text, contigs


def _tags(data: bytes) -> dict[str, object]:
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            out[name], at = data[at:end].decode(), end + 1
        elif kind == "B":
            size = struct.calcsize(TAG_SIZES[chr(data[at])])
            at += 5 + size * struct.unpack_from("<i", data, at + 1)[0]
        else:
            out[name] = struct.unpack_from("<" + TAG_SIZES[kind], data, at)[0]
            at += struct.calcsize(TAG_SIZES[kind])
    return out


def reference_length(data: bytes) -> int:
    """Bases of the reference that a record covers, at least one."""
    n_name, n_ops = data[8], struct.unpack_from("<H", data, 12)[0]
    ops = struct.unpack_from(f"<{n_ops}I", data, 32 + n_name)
    return max(1, sum(x >> 4 for x in ops if x & 15 in _ON_REFERENCE))


def decode(data: bytes, contigs: list[tuple[str, int]], with_bases: bool = True) -> dict:
    """One record as a row of SCHEMA; bases and qualities are only decoded on demand."""
    ref, pos, n_name, mapq, _, n_ops, flag, n_seq, mate_ref, mate_pos, template = struct.unpack_from("<iiBBHHHiiii", data, 0)
    at = 32 + n_name
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    at += 4 * n_ops
    n_packed = (n_seq + 1) // 2
    row = {
        "read_name": data[32 : 32 + n_name - 1].decode(),
        "flag": flag,
        "contig": contigs[ref][0] if ref >= 0 else None,
        "start": pos,
        "end": pos + reference_length(data),
        "mapq": mapq,
        "cigar": "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in ops) or None,
        "mate_contig": contigs[mate_ref][0] if mate_ref >= 0 else None,
        "mate_start": mate_pos if mate_ref >= 0 else None,
        "template_length": template,
        "query_length": n_seq or sum(x >> 4 for x in ops if x & 15 in _ON_QUERY),
        "seq": None,
        "qual": None,
    }
    if with_bases and n_seq:
        row["seq"] = data[at : at + n_packed].hex().translate(_LETTERS)[:n_seq]
        qualities = data[at + n_packed : at + n_packed + n_seq]
        row["qual"] = None if qualities[:1] == b"\xff" else qualities.translate(_SHIFTED).decode("latin-1")
    tags = _tags(data[at + n_packed + n_seq :])
    row |= {"hp": tags.get("HP"), "ps": tags.get("PS"), "sa": tags.get("SA"), "mc": tags.get("MC")}
    return row | {name: bool(flag & bit) for name, bit in FLAGS.items()}


class Ranges(InputPartition):
    """Ranges of virtual offsets of a file, in order; records that start in them."""

    def __init__(self, path: str, spans: list[tuple[int, int]]):
        super().__init__((path, spans[0]))
        self.path, self.spans = path, spans


class Stretch(InputPartition):
    """Bytes of a file without an index: records that start in blocks that start in [begin, end)."""

    def __init__(self, path: str, begin: int, end: int):
        super().__init__((path, begin))
        self.path, self.begin, self.end = path, begin, end


@dataclass
class Chunk(InputPartition):
    """A range of a file's blocks: records that start in blocks from begin to end (exclusive)."""

    path: str
    begin: int
    place: int
    end: int
    ordered: bool

    def __init__(self, path: str, begin: int, place: int, end: int, ordered: bool = False):
        super().__init__((begin, place, end))
        self.path, self.begin, self.place, self.end, self.ordered = path, begin, place, end, ordered


class AlignmentReader(DataSourceReader):
    """Reads alignments in splits of whole records; contig and start predicates end or skip records early."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", 64_000_000))
        self.with_bases = options.get("bases", "true").lower() != "false"
        self.contigs: set[str] | None = None
        self.low, self.high = -1, 1 << 62
        # contig -> merged [low, high), sorted: only records that overlap one of them are rows
        self.regions: dict[str, list[list[int]]] | None = json.loads(options["regions"]) if "regions" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("contig",):
                self.contigs = ({f.value} if self.contigs is None else self.contigs & {f.value})
            elif isinstance(f, In) and f.attribute == ("contig",):
                self.contigs = (set(f.value) if self.contigs is None else self.contigs & set(f.value))
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("start",):
                self.low = max(self.low, f.value)
            elif isinstance(f, LessThan) and f.attribute == ("start",):
                self.high = min(self.high, f.value)
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("start",):
                self.high = min(self.high, f.value + 1)
            else:
                yield f

    def partitions(self) -> list[Chunk | Ranges | Stretch]:
        """Splits of at least the split size that begin at a record.

        Their places come from the file's index (path.bai or path.csi). Without one, splits are stretches of bytes, in
        which tasks find the first block and the first record themselves. With regions, the index gives the blocks that each of them can lie in, and blocks of several regions are read once.
        """
        with open_input(self.path) as file:
            blocks = Blocks(file)
            _, contigs = read_header(blocks)
            cuts = [blocks.tell()]
            if (index := self._indexed()) is not None:
                known = sorted({x for contig in index for x in contig.linear if x} or {x for contig in index for spans in contig.bins.values() for x, _ in spans})
                if self.regions is not None:
                    return self._dealt([x for i, (name, _) in enumerate(contigs[: len(index)]) if self._asked(name) for low, high in self.regions.get(name, []) for x in index[i].chunks(low, high)], known)
                if self.contigs is not None:
                    numbers = [i for i, (name, _) in enumerate(contigs) if name in self.contigs and i < len(index)]
                    ranges = wanted_ranges(index, numbers, self.low, self.high)
                    return [chunk for begin, end in ranges for chunk in self._cut(begin, end, known)] or [Chunk(self.path, 0, 0, 0, True)]
                for at in known:
                    if (at >> 16) - cuts[-1][0] >= self.split:
                        cuts.append((at >> 16, at & 0xFFFF))
                return self._chunks(cuts)
            file.seek(0, 2)
            size = file.tell()
        # without an index: the first split begins behind the header, the others at the first record that they find
        begin, place = cuts[0]
        ends = [*range(begin + self.split, size, self.split), size]
        return [Chunk(self.path, begin, place, ends[0] << 16), *[Stretch(self.path, a, b) for a, b in zip(ends, ends[1:])]]

    def _asked(self, name: str | None) -> bool:
        return self.contigs is None or name in self.contigs

    def _dealt(self, spans: list[tuple[int, int]], known: list[int]) -> list[Chunk | Ranges]:
        """Ranges of offsets, overlaps merged, in splits of about the split size; long ranges are cut at known records."""
        out, held, size = [], [], 0
        pieces = [(c.begin << 16 | c.place, c.end) for begin, end in merged([x for x in spans if x[0] < x[1]]) for c in self._cut(begin, end, known)]
        for begin, end in pieces:
            held.append((begin, end))
            size += (end >> 16) - (begin >> 16) + 1
            if size >= self.split:
                out.append(Ranges(self.path, held))
                held, size = [], 0
        return [*out, Ranges(self.path, held)] if held else out or [Chunk(self.path, 0, 0, 0, True)]

    def _cut(self, begin: int, end: int, known: list[int]) -> list[Chunk]:
        """A range of virtual offsets in splits that begin at records."""
        cuts = [begin]
        for at in known[bisect.bisect_right(known, begin) : bisect.bisect_left(known, end)]:
            if (at >> 16) - (cuts[-1] >> 16) >= self.split:
                cuts.append(at)
        return [Chunk(self.path, a >> 16, a & 0xFFFF, b, True) for a, b in zip(cuts, [*cuts[1:], end], strict=True)]

    def _indexed(self) -> list[tuple[list[int], int, int]] | None:
        try:
            with open_input(self.path + ".bai") as file:
                return read_index(bytes(file.read()))
        except FileNotFoundError:
            pass
        try:
            with open_input(self.path + ".csi") as file:
                return read_wide_index(b"".join(_plain_blocks(file)))
        except FileNotFoundError:
            return None

    def _chunks(self, cuts: list[tuple[int, int]]) -> list[Chunk]:
        ends = [*cuts[1:], (1 << 46, 0)]
        return [Chunk(self.path, begin, place, (end << 16) | spot) for (begin, place), (end, spot) in zip(cuts, ends, strict=True)]

    def _overlaps(self, name: str | None, data: bytes, pos: int) -> bool:
        """Whether a record meets one of the regions."""
        spans = self.regions.get(name, [])
        at = bisect.bisect_right(spans, [pos, 1 << 62])
        if at and spans[at - 1][1] > pos:
            return True
        return at < len(spans) and spans[at][0] < pos + reference_length(data)

    def _wanted(self, partition: Chunk | Ranges | Stretch, file, contigs: list[tuple[str, int]]) -> Iterator[bytes]:
        """Records of a split that the predicates and regions let through."""
        if isinstance(partition, Stretch):
            first = first_record(file, partition.begin, partition.end, len(contigs))
            spans = [(first, partition.end << 16)] if first is not None else []
        else:
            spans = partition.spans if isinstance(partition, Ranges) else [((partition.begin << 16) | partition.place, partition.end)]
        blocks = None
        for begin, end in spans:
            if blocks is None or blocks.block_at != begin >> 16:
                blocks = Blocks(file, begin >> 16)
                blocks.read(begin & 0xFFFF)
            else:
                blocks.place = begin & 0xFFFF  # the block of the last range, still at hand
            while True:
                block, spot = blocks.tell()
                if (block << 16) | spot >= end:
                    break
                head = blocks.read(4)
                if len(head) < 4:
                    break
                data = blocks.read(struct.unpack("<i", head)[0])
                ref, pos = struct.unpack_from("<ii", data, 0)
                name = contigs[ref][0] if ref >= 0 else None
                if isinstance(partition, Chunk) and self.contigs is not None and len(self.contigs) == 1 and pos >= self.high and name in self.contigs and partition.ordered:
                    break  # the file is sorted, as its index shows: no later record of this contig starts before
                if self._asked(name) and self.low <= pos < self.high and (self.regions is None or self._overlaps(name, data, pos)):
                    yield data

    def read(self, partition: Chunk | Ranges | Stretch) -> Iterator[pa.RecordBatch]:
        with open_input(partition.path) as file:
            _, contigs = read_header(Blocks(file))
            rows = []
            for data in self._wanted(partition, file, contigs):
                rows.append(decode(data, contigs, self.with_bases))
                if len(rows) == 2000:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)


class AlignmentSource(DataSource):
    """spark.read.format("alignments").load(path): options splitbytes, bases (false leaves seq and qual null), regions.

    regions: JSON of contig -> merged [low, high), sorted; see near_regions.
    """

    @classmethod
    def name(cls) -> str:
        return "alignments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AlignmentReader:
        return AlignmentReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(AlignmentSource)
    # predicates on contig and start reach the reader
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def near_regions(spark: SparkSession, path: str, spans: DataFrame, gap: int = 1000, most: int = MOST_REGIONS) -> DataFrame:
    """Alignments of a file that overlap one of the spans (contig, low, high; half-open), read by its index.

    Spans of a contig that lie within gap of each other are one region: merged in Spark, they are at most as many as
    the spans. They go to the reader as an option, up to most of them; beyond that the file is read whole, and a
    join with the spans leaves the same rows. Rows of a merged region that meet none of its spans can come along.
    """
    register(spark)
    earlier = Window.partitionBy("contig").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    known = spans.where("contig is not null and low is not null and high is not null").select("contig", F.greatest(F.lit(0), "low").cast("bigint").alias("low"), F.col("high").cast("bigint").alias("high")).where("high > low").distinct()
    opens = known.withColumn("before", F.max("high").over(earlier)).withColumn("opens", F.when(F.col("before").isNull() | (F.col("low") > F.col("before") + gap), 1).otherwise(0))
    numbered = opens.withColumn("region", F.sum("opens").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy("contig", "region").agg(F.min("low").alias("low"), F.max("high").alias("high")).limit(most + 1).collect()
    reader = spark.read.format("alignments")
    if len(found) <= most:
        regions: dict[str, list[list[int]]] = {}
        for r in sorted(found, key=lambda r: (r.contig, r.low)):
            regions.setdefault(r.contig, []).append([r.low, r.high])
        reader = reader.option("regions", json.dumps(regions))
    return reader.load(path)


def contig_lengths(path: str) -> list[tuple[str, int]]:
    """(contig, length) of a file's header."""
    with open_input(path) as file:
        return read_header(Blocks(file))[1]


def _block(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    return struct.pack("<4sIBBH2sHH", b"\x1f\x8b\x08\x04", 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_alignments(path: str, contigs: list[tuple[str, int]], rows: list[dict], block: int = 60_000) -> None:
    """Write rows (read_name, flag, contig, start, mapq, cigar, seq, qual, mate_*, template_length, tags) to a file."""
    text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in contigs)
    out = b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs))
    for n, size in contigs:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    number = {n: i for i, (n, _) in enumerate(contigs)}
    for r in rows:
        name, seq = r["read_name"].encode() + b"\0", r.get("seq") or ""
        ops, count = [], ""
        for ch in r.get("cigar") or "":
            if ch.isdigit():
                count += ch
            else:
                ops.append(int(count) << 4 | OPERATIONS.index(ch))
                count = ""
        codes = [BASES.index(b) for b in seq] + [0] * (len(seq) % 2)
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
        qual = bytes(ord(q) - 33 for q in r["qual"]) if r.get("qual") else b"\xff" * len(seq)
        tags = b"".join(k.encode() + (b"Z" + v.encode() + b"\0" if isinstance(v, str) else b"i" + struct.pack("<i", v)) for k, v in (r.get("tags") or {}).items())
        mate = number.get(r.get("mate_contig"), -1)
        data = struct.pack("<iiBBHHHiiii", number.get(r.get("contig"), -1), r.get("start", -1), len(name), r.get("mapq", 0), 4680, len(ops), r.get("flag", 0), len(seq), mate, r.get("mate_start", -1), r.get("template_length", 0))
        data += name + struct.pack(f"<{len(ops)}I", *ops) + packed + qual + tags
        out += struct.pack("<i", len(data)) + data
    with open(path, "wb") as file:
        for at in range(0, len(out), block):
            file.write(_block(out[at : at + block]))
        file.write(_block(b""))


def write_index(path: str) -> None:
    """Write path.bai for a sorted file: bins with their chunks, and the linear index."""
    with open_input(path) as file:
        blocks = Blocks(file)
        _, contigs = read_header(blocks)
        bins: list[dict[int, list[list[int]]]] = [{} for _ in contigs]
        linear: list[dict[int, int]] = [{} for _ in contigs]
        while True:
            block, place = blocks.tell()
            head = blocks.read(4)
            if len(head) < 4:
                break
            data = blocks.read(struct.unpack("<i", head)[0])
            begin, (block, place) = (block << 16) | place, blocks.tell()
            ref, pos = struct.unpack_from("<ii", data, 0)
            if ref < 0 or pos < 0:
                continue
            last = pos + reference_length(data) - 1
            number = next(first + (pos >> bits) for first, bits in reversed(_LEVELS) if pos >> bits == last >> bits)
            chunks = bins[ref].setdefault(number, [])
            if chunks and chunks[-1][1] == begin:
                chunks[-1][1] = (block << 16) | place
            else:
                chunks.append([begin, (block << 16) | place])
            for window in range(pos >> 14, (last >> 14) + 1):
                linear[ref].setdefault(window, begin)
    out = b"BAI\x01" + struct.pack("<i", len(contigs))
    for of_bins, windows in zip(bins, linear, strict=True):
        out += struct.pack("<i", len(of_bins))
        for number, chunks in sorted(of_bins.items()):
            out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *x) for x in chunks)
        filled, last = [], 0
        for window in range(max(windows, default=-1) + 1):
            last = windows.get(window, last)
            filled.append(last)
        out += struct.pack(f"<i{len(filled)}Q", len(filled), *filled)
    with open(path + ".bai", "wb") as f:
        f.write(out)
