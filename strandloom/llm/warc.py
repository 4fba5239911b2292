"""WARC records in ZIP-packaged archives: a writer, and a reader by byte ranges.

An archive is a ZIP file whose members are stored, not deflated: archive/*.warc.gz (each record a gzip
member of its own), indexes/index.cdxj (sorted lines of SURT key, 14-digit time, and place in a member) and
datapackage.json with the members' digests. The reader fetches the end of the file, follows the ZIP64 locator
if there is one, parses the central directory, finds the members' data by their local headers, and range-reads
the index and then runs of records; nothing is extracted.

The reader takes archives of other writers too: numbers or strings as offsets, gzipped indexes, members that
are not compressed inside, members that no index names (these are read through once, a piece at a time), all
record types, responses without Content-Length or in chunks, digests in base 32 or hexadecimal.

Archives are written by tasks, one a partition, to a folder that driver and executors share. A task that
runs again writes the same archive under another name and only then takes the final name, so lost
executors leave no half archives behind. Readers work on runs of at most RUN_BYTES, dealt to tasks by the
bytes that they point to.

Deduplication: of records with equal payloads of at least LEAST_REVISIT bytes, that with the largest
page_id is a response and the others are revisits of it. The digests are found and compared without moving
payloads. The list of revisits is broadcast up to BROADCAST_REVISITS rows; beyond, pages are dealt once by
digest to meet it.

Defined cases: a null html is an empty payload; a null url leaves the record without a target; line breaks
in a url are percent-encoded; records without a page_id never are referred to unless all of their group
lack one, and then all are responses; rows that repeat the largest page_id are all responses; record ids of
rows without a page_id or with a repeated one end in the place of the row, so each is used once; an empty
table gives no archives and no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import filesystem, materialize, shared_path, short_batches

LEAST_REVISIT = 1000
MEMBER_BYTES = 16_000_000
#: Packed bytes of a member without an index that are unpacked at a time.
FEED_BYTES = 16_384
RUN_BYTES = 4_000_000
#: Bytes of records that a reading task takes, about; pages of revisits that are broadcast at most.
TASK_BYTES, BROADCAST_REVISITS = 16_000_000, 500_000
DATE = "2024-01-01T00:00:00Z"
STAMP = "".join(c for c in DATE if c.isdigit())
RECORD_ID = "urn:strandloom:page:"

# Signatures and sizes of the ZIP format.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF


# --- ZIP -------------------------------------------------------------------------------------------------


class ZipWriter:
    """Writes stored members to a stream that cannot seek; with ZIP64 records throughout."""

    def __init__(self, stream):
        self.stream, self.at, self.members = stream, 0, []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        encoded, crc, start = name.encode(), zlib.crc32(data), self.at
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        self._put(_LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 33, crc, _MAX32, _MAX32, len(encoded), len(extra)) + encoded + extra)
        self._put(data)
        self.members.append((encoded, crc, len(data), start))

    def finish(self) -> None:
        start = self.at
        for name, crc, size, offset in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            self._put(_CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 33, crc, _MAX32, _MAX32, len(name), len(extra), 0, 0, 0, 0, _MAX32) + name + extra)
        size, end, n = self.at - start, self.at, len(self.members)
        self._put(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(_LOCATOR64 + struct.pack("<IQI", 0, end, 1))
        self._put(_END + struct.pack("<HHHHIIH", 0, 0, min(n, _MAX16), min(n, _MAX16), _MAX32, _MAX32, 0))


class ZipReader:
    """The members of a ZIP file, read by ranges: name -> (offset of the data, size)."""

    def __init__(self, file):
        """file: random access, with size() and read_at(n, offset)."""
        self.file = file
        size = file.size()
        tail_at = max(0, size - 22 - _MAX16)
        tail = self._read(size - tail_at, tail_at)
        at = tail.rfind(_END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(_END, 0, at)  # the signature may stand in the archive's comment
        if at < 0:
            raise ValueError("no end of central directory")
        n, directory_size, directory_at = struct.unpack_from("<HII", tail, at + 10)
        if _MAX16 == n or _MAX32 in (directory_size, directory_at):
            locator = self._read(20, tail_at + at - 20)
            if locator[:4] != _LOCATOR64:
                raise ValueError("no ZIP64 locator")
            record = self._read(56, struct.unpack_from("<Q", locator, 8)[0])
            if record[:4] != _END64:
                raise ValueError("no ZIP64 end of central directory")
            n, directory_size, directory_at = struct.unpack_from("<QQQ", record, 32)
        self.members = self._directory(self._read(directory_size, directory_at), n)

    def _read(self, n: int, at: int) -> bytes:
        data = self.file.read_at(n, at)
        data = data.to_pybytes() if hasattr(data, "to_pybytes") else bytes(data)
        if len(data) != n:
            raise ValueError("the file ends early")
        return data

    @staticmethod
    def _directory(data: bytes, n: int) -> dict[str, tuple[int, int, int]]:
        out, at = {}, 0
        for _ in range(n):
            if data[at : at + 4] != _CENTRAL:
                raise ValueError("bad central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
            (offset,) = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, x = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while x + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, x)
                if kind == 1:  # only the fields that did not fit are there, in this order
                    wide = list(struct.unpack_from(f"<{length // 8}Q", extra, x + 4))
                    size = wide.pop(0) if size == _MAX32 else size
                    packed = wide.pop(0) if packed == _MAX32 else packed
                    offset = wide.pop(0) if offset == _MAX32 else offset
                x += 4 + length
            out[name] = (offset, packed, method)
            at += 46 + n_name + n_extra + n_comment
        return out

    def locate(self, name: str) -> tuple[int, int]:
        """Offset and size of a stored member's data."""
        offset, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed: it cannot be read by ranges")
        header = self._read(30, offset)
        if header[:4] != _LOCAL:
            raise ValueError(f"bad local header of {name}")
        n_name, n_extra = struct.unpack_from("<HH", header, 26)
        return offset + 30 + n_name + n_extra, size

    def read(self, name: str) -> bytes:
        at, size = self.locate(name)
        return self._read(size, at)


# --- records ---------------------------------------------------------------------------------------------


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _urn(page_id: int | None, place: str = "") -> str:
    return f"<{RECORD_ID}{'none' if page_id is None else page_id}{place and ':' + place}>"


def surt(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels in reverse, then the path."""
    if not url:
        return "-"
    scheme, mark, rest = url.partition("://")
    if not mark:
        return "".join(url.split()).lower() or "-"
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, _, port = rest[:cut].rpartition("@")[2].lower().partition(":")
    path = rest[cut:].partition("#")[0] or "/"
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + "%20".join(path.lower().split())


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, place: str = "") -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, place)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{_base32(sha1)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = data.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _page_id(urn: str | None) -> int | None:
    text = (urn or "").strip("<>")
    number = text.removeprefix(RECORD_ID).partition(":")[0]
    return int(number) if text.startswith(RECORD_ID) and number.lstrip("-").isdigit() else None


def _hex(digest: str | None) -> str | None:
    """A digest field of SHA-1 in hexadecimal, whichever way it is written; None for another kind."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def _unchunked(body: bytes) -> bytes | None:
    """The data of a body in chunks; None if it is not well formed."""
    out, at = bytearray(), 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        try:
            n = int(size, 16)
        except ValueError:
            return None
        if n == 0:
            return bytes(out)
        out += body[end + 2 : end + 2 + n]
        at = end + 2 + n + 2
        if at > len(body):
            return None


def parse(data: bytes, strict: bool = True) -> dict:
    """A record's fields, with the payload of a response, resource or conversion; intact: it has its digest.

    strict: raise if a payload is not that of its digest or length.
    """
    head, _, rest = data.lstrip(b"\r\n").partition(b"\r\n\r\n")
    version, fields = _headers(head)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = rest[: int(fields["content-length"])]
    kind, said = fields.get("warc-type"), _hex(fields.get("warc-payload-digest"))
    payload, declared, intact = None, None, None
    if kind in ("response", "revisit") and block.startswith(b"HTTP/"):
        http, _, payload = block.partition(b"\r\n\r\n")
        names = _headers(http)[1]
        declared = int(names["content-length"]) if names.get("content-length", "").isdigit() else None
        if "chunked" in names.get("transfer-encoding", "").lower():
            payload, declared = _unchunked(payload) or payload, None
        raw = block.partition(b"\r\n\r\n")[2]
        if said and kind == "response":
            intact = said in (hashlib.sha1(payload).hexdigest(), hashlib.sha1(raw).hexdigest())
    elif kind in ("response", "resource", "conversion"):
        payload = block
        intact = hashlib.sha1(payload).hexdigest() == said if said else None
    if kind == "revisit":
        payload = None
    elif payload is not None and declared is not None and declared != len(payload):
        intact = False
    if strict and intact is False:
        raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
    return {
        "page_id": _page_id(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "payload": payload,
        "payload_bytes": declared if payload is None else len(payload),
        "payload_digest": said or (hashlib.sha1(payload).hexdigest() if payload is not None else None),
        "record_type": kind,
        "refers_to": _page_id(fields.get("warc-refers-to")),
        "intact": intact,
    }


# --- Spark -----------------------------------------------------------------------------------------------


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, sha1, refers_to) of the records that are to be revisits; payloads do not leave the scan."""
    html = F.coalesce(F.col("html"), F.lit(""))
    light = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("n"))
    light = materialize(light.where(F.col("n") >= LEAST_REVISIT).groupBy("page_id", "sha1").agg(F.count("*").alias("rows")), "warc-digests")
    groups = light.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("ids")).where("ids > 1").drop("ids")
    joined = light.join(materialize(groups, "warc-groups"), "sha1")
    return joined.where("refers_to is not null and not (page_id <=> refers_to)").select("page_id", "sha1", "refers_to")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html) as archives under folder, which all executors reach; returns (path, records)."""
    short_batches(pages.sparkSession)
    known = materialize(revisits(pages), "warc-revisits").select(F.col("page_id").alias("r_id"), F.col("sha1").alias("r_sha1"), "refers_to")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("payload")).withColumn("sha1", F.sha1("payload"))
    known = F.broadcast(known) if known.count() <= BROADCAST_REVISITS else known.hint("shuffle_hash")
    rows = rows.join(known, (F.col("sha1") == F.col("r_sha1")) & F.col("page_id").eqNullSafe(F.col("r_id")), "left")
    # ids that several rows have are rare; they are found from the ids alone
    again = pages.select(F.col("page_id").cast("bigint").alias("again")).groupBy("again").count().where("again is not null and count > 1").select("again")
    again = materialize(again, "warc-repeated")
    again = F.broadcast(again) if again.count() <= BROADCAST_REVISITS else again.hint("shuffle_hash")
    rows = rows.join(again, F.col("page_id") == F.col("again"), "left").withColumn("alone", F.col("page_id").isNotNull() & F.col("again").isNull())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        final, fs, stream, archive = f"{folder}/part-{part:06d}.wacz", None, None, None
        held, lines, members, n, temporary = bytearray(), [], 0, 0, f"{folder}/.{part}-{uuid.uuid4().hex}"
        resources: list[dict] = []

        def put(name: str, data: bytes) -> None:
            archive.add(name, data)
            resources.append({"name": name.rpartition("/")[2], "path": name, "hash": f"sha256:{hashlib.sha256(data).hexdigest()}", "bytes": len(data)})

        def member() -> None:
            nonlocal members
            put(f"archive/data-{members:05d}.warc.gz", bytes(held))
            held.clear()
            members += 1

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to", "alone")]
            for page_id, url, payload, sha1, refers_to, alone in zip(*columns, strict=True):
                if archive is None:
                    fs, _ = filesystem(folder)
                    fs.create_dir(filesystem(folder)[1], recursive=True)
                    stream = fs.open_output_stream(filesystem(temporary)[1])
                    archive = ZipWriter(stream)
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = pack.compress(record(page_id, url, payload, sha1, refers_to, "" if alone else f"{part}.{n}")) + pack.flush()
                place = {"url": url or "", "mime": "text/html" if refers_to is None else "warc/revisit", "status": "200", "digest": f"sha1:{_base32(sha1)}", "length": str(len(data)), "offset": str(len(held)), "filename": f"data-{members:05d}.warc.gz"}
                lines.append(f"{surt(url)} {STAMP} {json.dumps(place)}")
                held += data
                n += 1
                if len(held) >= MEMBER_BYTES:
                    member()
        if archive is None:
            return
        if held:
            member()
        put("indexes/index.cdxj", "".join(f"{line}\n" for line in sorted(lines)).encode())
        archive.add("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "created": DATE, "records": n, "resources": resources}).encode())
        archive.finish()
        stream.close()
        fs.move(filesystem(temporary)[1], filesystem(final)[1])
        yield pa.RecordBatch.from_pydict({"path": [final], "records": pa.array([n], pa.int64())})

    out = rows.select("page_id", "url", "payload", "sha1", "refers_to", "alone").mapInArrow(write, "path string, records bigint")
    return materialize(out, "warc-archives")


def _index(archive: ZipReader) -> dict[str, list[tuple[int, int]]]:
    """Member name -> (offset, length) of its records, from all CDXJ indexes of an archive."""
    places: dict[str, set[tuple[int, int]]] = {}
    for name in sorted(archive.members):
        if name.startswith("indexes/") and name.removesuffix(".gz").endswith((".cdxj", ".cdx")):
            data = archive.read(name)
            text = (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode()
            for line in text.splitlines():
                if "{" not in line or line.startswith("!"):
                    continue
                place = json.loads(line[line.index("{") :])
                if {"filename", "offset", "length"} <= place.keys():
                    places.setdefault(place["filename"].rpartition("/")[2], set()).add((int(place["offset"]), int(place["length"])))
    return {k: sorted(v) for k, v in places.items()}


def _runs(path: str) -> Iterator[tuple[int, int, list[int]]]:
    """Runs of neighbouring records of an archive: offset, length, lengths of the records (none: not indexed)."""
    fs, plain = filesystem(path)
    with fs.open_input_file(plain) as file:
        archive = ZipReader(file)
        places = _index(archive)
        for name in sorted(archive.members):
            if not (name.startswith("archive/") and name.endswith((".warc", ".warc.gz"))):
                continue
            start, size = archive.locate(name)
            filename = name.rpartition("/")[2]
            if filename not in places:
                yield start, size, []
                continue
            first, lengths, end = None, [], None
            for offset, length in places[filename]:
                if offset + length > size:
                    raise ValueError(f"the index of {path} points beyond {filename}")
                if first is not None and (offset != end or end - first + length > RUN_BYTES):
                    yield start + first, end - first, lengths
                    first, lengths = None, []
                if first is None:
                    first = offset
                lengths.append(length)
                end = offset + length
            if first is not None:
                yield start + first, end - first, lengths


def _unpacked(data: bytes) -> bytes:
    return zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data


def _pieces(file, start: int, size: int) -> Iterator[bytes]:
    """The plain bytes of a member, a piece at a time, whether its records are gzipped or not."""
    at, end, unpack = start, start + size, None
    packed = bytes(file.read_at(min(2, size), start)) == b"\x1f\x8b"
    while at < end:
        data = memoryview(file.read_at(min(RUN_BYTES, end - at), at))
        at += len(data)
        if not packed:
            yield bytes(data)
            continue
        place = 0
        while place < len(data):
            # a short stretch at a time: what a record leaves of it is copied
            stretch = data[place : place + FEED_BYTES]
            unpack = unpack or zlib.decompressobj(31)
            yield unpack.decompress(stretch)
            place += len(stretch) - len(unpack.unused_data)
            if unpack.eof:
                unpack = None
    if unpack is not None:
        raise ValueError("a record ends early")


def _read_through(file, start: int, size: int) -> Iterator[bytes]:
    """The records of a member that no index names, one after the other."""
    held, place, wanted = bytearray(), 0, 0
    for piece in _pieces(file, start, size):
        held += piece
        if len(held) - place < wanted:
            continue  # a long record
        while True:
            while place < len(held) and held[place] in b"\r\n":
                place += 1
            end = held.find(b"\r\n\r\n", place)
            wanted = 0
            if end < 0:
                break
            wanted = end + 4 - place + int(_headers(bytes(held[place:end]))[1]["content-length"])
            if len(held) - place < wanted:
                break
            yield bytes(held[place : place + wanted])
            place += wanted
        if place > RUN_BYTES or place == len(held):
            del held[:place]
            place = 0
    if bytes(held[place:]).strip():
        raise ValueError("a record ends early")


RECORD_SCHEMA = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, intact boolean"


def read_archives(paths: DataFrame, strict: bool = False) -> DataFrame:
    """Records of the archives in paths (path); each run of records is one range request.

    intact: whether a payload has the digest that its record states (null if it states none); strict: fail if one
    has not.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for offset, length, lengths in _runs(path):
                    yield pa.RecordBatch.from_pydict({"path": [path], "offset": pa.array([offset], pa.int64()), "length": pa.array([length], pa.int64()), "lengths": pa.array([lengths], pa.list_(pa.int64()))})

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])

    def read(path: str, offset: int, length: int, lengths: list[int]) -> Iterator[bytes]:
        fs, plain = filesystem(path)
        with fs.open_input_file(plain) as file:
            if not lengths:
                yield from _read_through(file, offset, length)
                return
            data, at = file.read_at(length, offset), 0
            for n in lengths:
                yield _unpacked(data[at : at + n])
                at += n

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in zip(*[batch.column(c).to_pylist() for c in ("path", "offset", "length", "lengths")], strict=True):
                rows, held = [], 0
                for data in read(*run):
                    rows.append(parse(data, strict))
                    held += len(data)
                    if held >= RUN_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    runs = materialize(paths.select("path").mapInArrow(index, "path string, offset bigint, length bigint, lengths array<bigint>"), "warc-runs")
    size = runs.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    # the rows of runs are small: tasks are counted by what they point to
    tasks = max(1, -(-size.bytes // TASK_BYTES), min(size.n, paths.sparkSession.sparkContext.defaultParallelism))
    return runs.repartition(tasks, "path", "offset").mapInArrow(records, RECORD_SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read the records back."""
    return read_archives(write_archives(pages, shared_path(spark, "warc")), strict=True)
