"""WARC records inside ZIP packages, read by byte range.

A package is a ZIP file with two stored (uncompressed) members: the WARC
records, each a gzip member of its own, and an index of their places.  The
reader parses the end-of-central-directory record, the ZIP64 records where they
are present and the central directory, finds where a stored member's bytes lie,
and reads single records by offset and length without extracting anything.

Of records with equal payloads of at least ``REVISIT_BYTES``, the one with the
largest ``page_id`` is written as a response and the others as revisits of it.

Defined results: a null page is an empty payload; a null ``page_id`` is always
a response; rows that repeat a ``page_id`` are written one by one; an empty table gives no packages; extra
columns of the input are ignored; control characters in URLs are escaped.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, written

REVISIT_BYTES = 1000
#: Compressed bytes after which a package is closed.
PACKAGE_BYTES = 8 << 20
#: Packages that a task reads, one after the other; parts in which pages of one payload are dealt.
PACKAGES, SALTS = 16, 8
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdx"

# ---------------------------------------------------------------- ZIP

_LOCAL, _CENTRAL, _END, _END64, _FIND64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_FULL = 0xFFFFFFFF


def pack_zip(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; ZIP64 records where sizes need them or when asked for."""
    out, central, n = [], [], 0
    for name, data in members:
        raw, crc = name.encode(), zlib.crc32(data)
        wide = zip64 or len(data) >= _FULL or n >= _FULL
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        size = _FULL if wide else len(data)
        head = struct.pack("<4sHHHHHIIIHH", _LOCAL, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra
        more = struct.pack("<HHQQQ", 1, 24, len(data), len(data), n) if wide else b""
        central.append(struct.pack("<4sHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(more), 0, 0, 0, 0, _FULL if wide else n) + raw + more)
        out += [head, data]
        n += len(head) + len(data)
    directory = b"".join(central)
    wide = zip64 or n >= _FULL or len(members) >= 0xFFFF
    end = b""
    if wide:
        end = struct.pack("<4sQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, len(members), len(members), len(directory), n)
        end += struct.pack("<4sIQI", _FIND64, 0, n + len(directory), 1)
    count, length, at = (0xFFFF, _FULL, _FULL) if wide else (len(members), len(directory), n)
    return b"".join([*out, directory, end, struct.pack("<4sHHHHIIH", _END, 0, 0, count, count, length, at, 0)])


class ZipDirectory:
    """Members of a ZIP file known only by ``read(offset, length)``."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        tail_at = max(0, size - 22 - 0xFFFF - 20)
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(_END)
        while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(_END, 0, end)
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        _, _, _, count, length, at = struct.unpack_from("<HHHHII", tail, end + 4)
        if end >= 20 and tail[end - 20 : end - 16] == _FIND64:
            where = struct.unpack_from("<Q", tail, end - 12)[0]
            record = read(where, 56)
            if record[:4] != _END64:
                raise ValueError("ZIP64 end of central directory is missing")
            count, length, at = struct.unpack_from("<QQQ", record, 32)
        self.members: dict[str, tuple[int, int, int]] = {}
        d, p = read(at, length), 0
        for _ in range(count):
            if d[p : p + 4] != _CENTRAL:
                raise ValueError("central directory is damaged")
            method = struct.unpack_from("<H", d, p + 10)[0]
            packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", d, p + 20)
            start = struct.unpack_from("<I", d, p + 42)[0]
            name = d[p + 46 : p + 46 + n_name].decode()
            x, stop = p + 46 + n_name, p + 46 + n_name + n_extra
            while x + 4 <= stop:
                kind, n = struct.unpack_from("<HH", d, x)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", d, x + 4))
                    full = next(wide) if full == _FULL else full
                    packed = next(wide) if packed == _FULL else packed
                    start = next(wide) if start == _FULL else start
                x += 4 + n
            self.members[name] = (method, packed, start)
            p = stop + n_note

    def place(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes."""
        method, size, start = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed, not stored")
        head = self.read(start, 30)
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return start + 30 + n_name + n_extra, size


# ---------------------------------------------------------------- records

_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'-' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: {digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes | None]:
    """Headers and the payload (None of a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Type"] == "revisit":
        return fields, None
    return fields, block.partition(b"\r\n\r\n")[2]


def _page(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == "-" else int(name)


def _filesystem(uri: str):
    from pyarrow import fs

    # names by which Hadoop knows stores that Arrow knows by others
    scheme, colon, rest = uri.partition(":")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        warc, index, size = [], [], 0

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wacz"  # a retried task leaves packages that no row names
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(pack_zip([(RECORDS, b"".join(warc)), (INDEX, "".join(index).encode())], zip64=True))
            done = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(warc)], pa.int64())], ["package", "n_records"])
            warc.clear()
            index.clear()
            return done

        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = gzip.compress(record(page_id, url, (html or "").encode(), refers), 1, mtime=0)
                index.append(f"{'-' if page_id is None else page_id} {size} {len(raw)}\n")
                warc.append(raw)
                size += len(raw)
                if size >= PACKAGE_BYTES:
                    yield close()
                    size = 0
        if warc:
            yield close()

    return run


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with a ``part`` of SALTS, so that rows of one key are no one task's."""
    return rows.withColumn("part", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _in_all_parts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages; returns ``package, n_records`` of the packages that count."""
    p = pages.select(F.col("page_id").cast("long"), "url", "html")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    small = p.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).filter(F.col("n") >= REVISIT_BYTES).select("page_id", "digest")
    groups = small.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = _dealt(small, "page_id").join(_in_all_parts(groups), ["digest", "part"]).filter(F.col("page_id") < F.col("refers_to")).select("page_id", "digest", "refers_to").distinct()
    keyed = p.withColumn("digest", F.sha1(payload))
    placed = keyed.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    return written(placed.mapInArrow(_write(folder), "package string, n_records long"), "packages")


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, header_digest string, url string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _READ.split(", ")]
    types = [pa.int64() if f.endswith("long") else pa.string() for f in _READ.split(", ")]
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            files, path = _filesystem(uri)
            with files.open_input_file(path) as f:
                read = lambda at, n: f.read_at(n, at)  # noqa: B023, E731
                directory = ZipDirectory(read, f.size())
                base, _ = directory.place(RECORDS)
                rows = []
                for line in read(*directory.place(INDEX)).decode().splitlines():
                    at, n = map(int, line.split()[1:])
                    fields, payload = parse(gzip.decompress(read(base + at, n)))
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    url = fields["WARC-Target-URI"]
                    if payload is None:
                        rows.append((_page(fields["WARC-Record-ID"]), None, None, "revisit", _page(fields["WARC-Refers-To"]), digest, url))
                    else:
                        found = hashlib.sha1(payload).hexdigest()
                        if found != digest:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                        rows.append((_page(fields["WARC-Record-ID"]), len(payload), found, "response", None, digest, url))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_packages(packages: DataFrame) -> DataFrame:
    """Per record: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``; a revisit has its response's payload."""
    n = packages.count()
    cores = packages.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(n, max(4 * cores, n // PACKAGES)))
    read = written(packages.select("package").repartition(tasks).mapInArrow(_read, _READ), "records")
    responses = read.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "header_digest", F.col("payload_bytes").alias("r_bytes")).distinct()
    again = read.filter("record_type = 'revisit'")
    referred = again.select("refers_to", "header_digest").distinct().join(responses, ["refers_to", "header_digest"])
    revisits = _dealt(again, "page_id").join(_in_all_parts(referred), ["refers_to", "header_digest", "part"])
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    whole = revisits.select("page_id", F.col("r_bytes").alias("payload_bytes"), F.col("header_digest").alias("payload_digest"), "record_type", "refers_to", "url")
    return read.filter("record_type = 'response'").select(out).unionByName(whole)


def round_trip(pages: DataFrame) -> DataFrame:
    folder = fresh_path(pages.sparkSession, "archives")
    return read_packages(write_packages(pages, folder))
