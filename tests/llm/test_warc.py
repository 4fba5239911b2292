import gzip
import hashlib
import io
import json
import re
import zipfile

import pytest

from strandloom.llm import warc

SCHEMA = "page_id bigint, url string, html string, sha1 int"


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def expect(rows):
    best, out = {}, []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and page_id is not None:
            best[data] = max(page_id, best.get(data, page_id))
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        to = best.get(data)
        to = None if to == page_id else to
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    return out


def result(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip_and_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN_BYTES", 3000)
    big, other = "é" * 700, "z" * 1000
    rows = [(1, "http://a/\r\nb", big, 0), (2, None, big, 0), (3, "http://c/", "é" * 10, 0), (4, "x", "é" * 10, 0), (5, "x", None, 0), (6, "x", "", 0)]
    rows += [(7, "x", other, 0), (7, "x", other, 0), (8, "x", other, 0), (8, "y", other, 0), (None, "x", other, 0), (None, "x", "q" * 2000, 0), (None, "x", "q" * 2000, 0), (9, "x", "w" * 300_000, 0)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = warc.round_trip(spark, pages).cache()
    assert result(out) == sorted(expect(rows), key=str)
    got = {r.page_id: r for r in out.collect()}
    assert bytes(got[2].payload) == big.encode() and got[1].payload is None and got[1].url == "http://a/%0D%0Ab" and got[2].url is None
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_driver_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    out = warc.round_trip(spark, pages).cache()
    assert result(out) == sorted(expect(rows), key=str)
    html = {r[0]: r[2] for r in rows}
    assert all(bytes(r.payload).decode() == html[r.page_id] for r in out.collect() if r.record_type == "response")


def test_members_in_parts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 5000)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert warc.round_trip(spark, pages).count() == pages.count()


@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 in a comment"])
def test_reads_other_zip_files(comment):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("archive/a.warc.gz", b"12345")
        z.writestr("naïve.txt", b"x" * 100, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = comment
    r = warc.ZipReader(Bytes(buffer.getvalue()))
    assert r.read("archive/a.warc.gz") == b"12345"
    with pytest.raises(ValueError):
        r.read("naïve.txt")
    with pytest.raises(ValueError):
        warc.ZipReader(Bytes(b"no archive"))


def test_writer_is_readable_elsewhere():
    buffer = io.BytesIO()
    w = warc.ZipWriter(buffer)
    w.add("archive/a", b"abc")
    w.add("b", b"")
    w.finish()
    with zipfile.ZipFile(io.BytesIO(buffer.getvalue())) as z:
        assert z.testzip() is None and z.read("archive/a") == b"abc" and z.namelist() == ["archive/a", "b"]
    assert warc.ZipReader(Bytes(buffer.getvalue())).read("archive/a") == b"abc"


def warc_record(kind, block, more=()):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0>", "WARC-Target-URI: http://other.org/x", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def foreign_archive(path, index, packed):
    body = b"hello " * 300
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"4;x=1\r\nWiki\r\n5\r\npedia\r\n0\r\n\r\n"
    sha = lambda data: f"WARC-Payload-Digest: sha1:{hashlib.sha1(data).hexdigest().upper()}"
    records = [
        warc_record("warcinfo", b"software: other\r\n"),
        warc_record("response", http + body, [sha(body)]),
        warc_record("response", chunked, [sha(b"Wikipedia")]),
        warc_record("response", http + b"bad", [sha(b"good")]),
        warc_record("request", b"GET / HTTP/1.1\r\n\r\n"),
        warc_record("resource", b"plain"),
    ]
    stored, lines, at = b"", [], 0
    for r in records:
        data = gzip.compress(r) if packed else r
        lines.append(f'org,other)/x 20240101000000 {json.dumps({"offset": str(at), "length": str(len(data)), "filename": "a/data.warc"})}')
        stored, at = stored + data, at + len(data)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/data.warc", stored)
        if index:
            text = ("!meta 1 {}\n" + "\n".join(sorted(lines))).encode()
            z.writestr("indexes/index.cdx.gz", gzip.compress(text))
            z.writestr("indexes/index.idx", b"!meta")
    return hashlib.sha1(body).hexdigest()


@pytest.mark.parametrize("index", [True, False])
@pytest.mark.parametrize("packed", [True, False])
def test_reads_archives_of_other_writers(spark, tmp_path, index, packed):
    digest = foreign_archive(str(tmp_path / "a.wacz"), index, packed)
    paths = spark.createDataFrame([(str(tmp_path / "a.wacz"),)], "path string")
    got = sorted(((r.record_type, r.payload_bytes, r.payload_digest, r.intact, r.url) for r in warc.read_archives(paths).collect()), key=str)
    url = "http://other.org/x"
    want = [
        ("request", None, None, None, url),
        ("resource", 5, hashlib.sha1(b"plain").hexdigest(), None, url),
        ("response", 3, hashlib.sha1(b"good").hexdigest(), False, url),
        ("response", 9, hashlib.sha1(b"Wikipedia").hexdigest(), True, url),
        ("response", 1800, digest, True, url),
        ("warcinfo", None, None, None, url),
    ]
    assert got == sorted(want, key=str)
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archives(paths, strict=True).collect()


def test_index_package_and_record_ids(spark, tmp_path):
    rows = [(1, "http://b.org/Z?q=1", "x" * 1200, 0), (2, "https://u@www.a.com:8443/p#f", "x" * 1200, 0), (3, None, "y", 0), (3, "http://c/", "y", 0), (None, "http://c/", "n", 0), (None, "http://c/", "n", 0)]
    archives = warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "w")).collect()
    with zipfile.ZipFile(archives[0].path.removeprefix("file:")) as z:
        lines = z.read("indexes/index.cdxj").decode().splitlines()
        package = json.loads(z.read("datapackage.json"))
        assert {(r["path"], r["hash"], r["bytes"]) for r in package["resources"]} == {(n, "sha256:" + hashlib.sha256(z.read(n)).hexdigest(), len(z.read(n))) for n in z.namelist() if n != "datapackage.json"}
        data = gzip.decompress(z.read("archive/data-00000.warc.gz"))
    assert lines == sorted(lines) and [line.split(" ")[:2] for line in lines] == [["-", "20240101000000"], ["c)/", "20240101000000"], ["c)/", "20240101000000"], ["c)/", "20240101000000"], ["com,a,www:8443)/p", "20240101000000"], ["org,b)/z?q=1", "20240101000000"]]
    ids = re.findall(rb"WARC-Record-ID: (\S+)", data)
    assert len(ids) == len(set(ids)) == 6 and re.findall(rb"WARC-Refers-To: (\S+)", data) == [b"<urn:strandloom:page:2>"]


def test_reading_is_dealt_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 10_000)
    pages = spark.createDataFrame([(i, "u", hashlib.sha256(str(i).encode()).hexdigest() * 40, 0) for i in range(400)], SCHEMA).repartition(4)
    records = warc.round_trip(spark, pages)
    assert records.rdd.getNumPartitions() > 4 and records.count() == 400


@pytest.mark.parametrize("packed", [True, False])
def test_members_without_an_index_take_linear_time(packed):
    import time

    class File:
        def __init__(self, data):
            self.data = data

        def read_at(self, n, at):
            return self.data[at : at + n]

    blocks = [hashlib.sha256(str(i).encode()).hexdigest().encode() * (1 + i % 7) for i in range(40_000)] + [b"long" * 3_000_000]
    data = b"".join(gzip.compress(warc_record("resource", x), 1) if packed else warc_record("resource", x) for x in blocks)
    began = time.monotonic()
    got = [x.partition(b"\r\n\r\n")[2] for x in warc._read_through(File(data), 0, len(data))]
    assert got == blocks and time.monotonic() - began < 20
    with pytest.raises(ValueError, match="ends early"):
        list(warc._read_through(File(data), 0, len(data) - 9))
