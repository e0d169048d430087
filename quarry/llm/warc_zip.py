"""WARC archives inside ZIP packages: written per task, read back by ranges without extraction.

A package holds stored members: archive/data.warc.gz, one gzip member per record, and indexes/index.cdxj,
a line per record with its page id, offset and length. The reader finds the end record (and ZIP64's
locator and end record), walks the central directory, reads a member's local header for the place of its
data, and then reads the index and each record by range.

Of pages with equal payloads of at least min_bytes, that with the largest page_id is stored as response
and the others as revisits of it.

Defined cases: a null html is an empty payload; rows with equal page_id and payload are records of the
same kind each; a page without page_id revisits the response of its payload, if there is one with an id;
url may be null or hold anything (line ends are dropped from headers); a very long payload is one record,
and a package ends behind it; an empty table gives no packages and no rows; other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, partitions, shared_dir, text_of, written

#: Fixed values of the formats.
EOCD, EOCD_SIZE = b"PK\x05\x06", 22
ZIP64_LOCATOR, ZIP64_EOCD = b"PK\x06\x07", b"PK\x06\x06"
CENTRAL, LOCAL = b"PK\x01\x02", b"PK\x03\x04"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:quarry:page:"
#: Payload bytes after which a task begins another package.
PACKAGE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{RECORD_ID}{'' if page_id is None else page_id}>"), ("WARC-Target-URI", "".join((url or "").splitlines())), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{RECORD_ID}{refers_to}>")]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode("utf-8") + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A WARC record's fields: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = headers["warc-type"]
    own = headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != told or digest(payload) != own:
            raise ValueError("the payload is not what its header says")
    number = lambda x: int(y) if (y := x.strip("<>").removeprefix(RECORD_ID)) else None
    return {"page_id": number(headers["warc-record-id"]), "url": headers["warc-target-uri"], "payload_bytes": told, "payload_digest": own, "record_type": kind, "refers_to": number(headers["warc-refers-to"]) if "warc-refers-to" in headers else None, "payload": payload if kind == "response" else None}


class _Package:
    """One ZIP under way: the archive member takes records, then the index is added."""

    def __init__(self, stream: io.RawIOBase):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)
        self.index: list[str] = []
        self.offset = self.payload = 0

    def add(self, page_id: int | None, record: bytes) -> None:
        packed = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = packed.compress(record) + packed.flush()
        self.member.write(data)
        self.index.append(json.dumps({"page_id": page_id, "offset": self.offset, "length": len(data)}))
        self.offset += len(data)
        self.payload += len(record)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr("indexes/index.cdxj", "\n".join(self.index))
        self.zip.close()


def write_packages(pages: DataFrame, out_dir: str, min_bytes: int = 0) -> DataFrame:
    """Write every page; returns the manifest (path, records) of packages by finished tasks."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    rows = rows.withColumns({"sha": F.sha1(F.encode("html", "UTF-8")), "bytes": F.octet_length("html")})
    groups = rows.filter(F.col("bytes") >= min_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("response"))
    groups = written(groups.filter("n > 1").select("sha", "response"), "payload-groups")
    rows = rows.join(groups, "sha", "left").withColumn("refers_to", F.when(F.col("bytes") >= min_bytes, F.col("response")))
    revisit = F.col("refers_to").isNotNull() & ~F.col("refers_to").eqNullSafe(F.col("page_id"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(out_dir)
        package = name = stream = None

        def closed() -> pa.RecordBatch:
            package.close()
            stream.close()
            return pa.RecordBatch.from_pydict({"path": [name], "records": [len(package.index)]})

        for batch in batches:
            for page_id, url, html, refers_to, again in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if package is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    stream = fs.open_output_stream(f"{folder}/{name}")
                    package = _Package(stream)
                package.add(page_id, warc_record(page_id, url, html.encode("utf-8"), refers_to, again))
                if package.payload >= PACKAGE_BYTES:
                    yield closed()
                    package = None
        if package is not None:
            yield closed()

    return written(rows.select("page_id", "url", "html", "refers_to", revisit.alias("again")).mapInArrow(write, "path string, records long"), "packages")


def central_directory(read, size: int) -> dict[str, tuple[int, int, int, int]]:
    """name -> (method, compressed size, size, place of the local header). read(offset, length) gives bytes."""
    tail_at = max(0, size - EOCD_SIZE - 0xFFFF)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(EOCD)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, count, length, offset, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
    if 0xFFFF == count or 0xFFFFFFFF in (length, offset):
        where = tail_at + at - 20
        locator = read(where, 20)
        if locator[:4] != ZIP64_LOCATOR:
            raise ValueError("no ZIP64 locator")
        end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != ZIP64_EOCD:
            raise ValueError("no ZIP64 end of central directory")
        count, length, offset = struct.unpack_from("<QQQ", end, 32)
    data, at, found = read(offset, length), 0, {}
    for _ in range(count):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, plain, n, extra, comment, place = (*struct.unpack_from("<H", data, at + 10), *struct.unpack_from("<II", data, at + 20), *struct.unpack_from("<HHH", data, at + 28), *struct.unpack_from("<I", data, at + 42))
        name = data[at + 46 : at + 46 + n].decode("utf-8")
        more, i = data[at + 46 + n : at + 46 + n + extra], 0
        while i + 4 <= len(more):
            tag, length = struct.unpack_from("<HH", more, i)
            if tag == 1:  # ZIP64: only the fields that did not fit, in this order
                j = i + 4
                if plain == 0xFFFFFFFF:
                    plain, j = struct.unpack_from("<Q", more, j)[0], j + 8
                if packed == 0xFFFFFFFF:
                    packed, j = struct.unpack_from("<Q", more, j)[0], j + 8
                if place == 0xFFFFFFFF:
                    place = struct.unpack_from("<Q", more, j)[0]
            i += 4 + length
        found[name] = (method, packed, plain, place)
        at += 46 + n + extra + comment
    return found


def stored_member(read, entry: tuple[int, int, int, int]) -> tuple[int, int]:
    """Place and size of a stored member's data."""
    method, packed, _, place = entry
    if method != 0:
        raise ValueError("the member is not stored")
    head = read(place, 30)
    if head[:4] != LOCAL:
        raise ValueError("no local header")
    return place + 30 + sum(struct.unpack_from("<HH", head, 26)), packed


def read_packages(spark: SparkSession, out_dir: str, manifest: DataFrame, payload: bool = False) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to (and url and payload)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "payload"] if payload else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(out_dir)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(f"{folder}/{path}") as f:

                    def read(offset: int, length: int) -> bytes:
                        f.seek(offset)
                        return f.read(length)

                    members = central_directory(read, f.size())
                    index = read(*stored_member(read, members["indexes/index.cdxj"])).decode()
                    base, _ = stored_member(read, members["archive/data.warc.gz"])
                    rows: list[dict] = []
                    for line in index.splitlines():
                        at = json.loads(line)
                        rows.append(parse_record(zlib.decompress(read(base + at["offset"], at["length"]), 31)))
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payload
    return manifest.select("path").repartition(partitions(spark)).mapInArrow(run, schema)


def package_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    out_dir = shared_dir(pages.sparkSession, "wacz")
    return read_packages(pages.sparkSession, out_dir, write_packages(pages, out_dir, min_bytes))
