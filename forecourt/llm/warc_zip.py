"""WARC records in ZIP packages: written per task, read back by byte ranges.

A package is a ZIP file of stored members: archives (archive/*.warc.gz, one gzip member per record, or *.warc) and
indexes (indexes/*.jsonl or *.cdxj: JSON with the archive's name, offset and length of each record, perhaps after a
key). The writer makes one of each. The reader never extracts a package: it reads the end of the file, the ZIP64 end
record if there is one, and the central directory, where it locates archives and indexes; the local header of a stored
member tells where its bytes begin; the index gives ranges, and each record is one range read.

Packages go to the shared folder under names of their own for each attempt; a written manifest lists those of
the attempts that counted, so that a lost executor or a second attempt cannot mix records.

Defined cases: null html is an empty payload; all pages of the smallest page_id of a payload are responses, so
rows that repeat are written as often as they occur; a null page_id is a response only if no page with the
payload has an id; ids may be of any type that can be cast to a string and back; payloads of any length are one record
each; an empty table gives no rows; other columns are ignored.

Tasks open the shared folder through pyarrow (local, s3, gs, abfs, hdfs); the folders of attempts that didn't count go
with the folder as a whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.llm.common import map_batches, materialize, new_path, table

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.jsonl"
ARCHIVES, INDEXES = re.compile(r"archive/(.+\.warc(?:\.gz)?)"), re.compile(r"indexes/.+\.(?:jsonl|cdxj)")
# Schemes of Spark's file systems whose names differ in pyarrow.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}
#: A task begins another package beyond so many bytes of records.
PACKAGE_BYTES = 128 << 20
SIGNATURES = {"end": b"PK\x05\x06", "end64": b"PK\x06\x06", "locator64": b"PK\x06\x07", "entry": b"PK\x01\x02", "local": b"PK\x03\x04"}


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, found, rest = uri.partition(":")
    if not found:
        return pafs.FileSystem.from_uri(f"file://{uri}")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


# ---- reading a package -------------------------------------------------------------------------------------


def read_range(f, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def zip64_values(extra: bytes, wanted: list[str]) -> dict[str, int]:
    """The 64-bit values of a ZIP64 extra field, in the fixed order of the fields that overflowed."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return {k: struct.unpack_from("<Q", extra, at + 4 + 8 * i)[0] for i, k in enumerate(wanted) if 8 * (i + 1) <= n}
        at += 4 + n
    return {}


def read_directory(f, size: int) -> dict[str, dict]:
    """Members by name: method, size, compressed size, offset of the local header."""
    tail_at = max(0, size - 65_557)
    tail = read_range(f, tail_at, size - tail_at)
    end = tail.rfind(SIGNATURES["end"])
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == SIGNATURES["locator64"]:
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        record = read_range(f, at, 56)
        if record[:4] != SIGNATURES["end64"]:
            raise ValueError("no ZIP64 end record")
        n, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, members = read_range(f, start, length), 0, {}
    for _ in range(n):
        if directory[at : at + 4] != SIGNATURES["entry"]:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, at + 20)
        (local,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        values = {"size": plain, "packed": packed, "local": local}
        values |= zip64_values(directory[at + 46 + n_name : at + 46 + n_name + n_extra], [k for k, v in values.items() if v == 0xFFFFFFFF])
        members[name] = values | {"method": method}
        at += 46 + n_name + n_extra + n_note
    return members


def member_start(f, member: dict) -> int:
    """Where a stored member's bytes begin."""
    if member["method"] != 0:
        raise ValueError("member isn't stored")
    header = read_range(f, member["local"], 30)
    if header[:4] != SIGNATURES["local"]:
        raise ValueError("no local header")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return member["local"] + 30 + n_name + n_extra


def read_entries(f, members: dict[str, dict]) -> Iterator[tuple[int, int, int]]:
    """(place in the package, length, offset in its archive) of every record that an index lists."""
    archives = {m[1]: x for name, x in members.items() if (m := ARCHIVES.fullmatch(name))}
    starts: dict[str, int] = {}
    for name, index in members.items():
        if INDEXES.fullmatch(name):
            for line in read_range(f, member_start(f, index), index["size"]).splitlines():
                entry = json.loads(line[line.index(b"{") :])
                own = entry.get("filename") or next(iter(archives))
                if own not in starts:
                    starts[own] = member_start(f, archives[own])
                yield starts[own] + int(entry["offset"]), int(entry["length"]), int(entry["offset"])


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


# ---- writing -----------------------------------------------------------------------------------------------


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: str | None, url: str | None, payload: bytes, first: str | None) -> tuple[str, bytes]:
    """Record type and bytes. first: page_id of the response with this payload, None if this is the response."""
    kind = "response" if first is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{'' if page_id is None else quote(page_id, safe='')}>", "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}"}
    if url is not None:
        head["WARC-Target-URI"] = " ".join(url.split())
    if first is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{quote(first, safe='')}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return kind, b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


class Package:
    """One ZIP file that is written as records arrive; only the index is held."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        files, path = open_fs(self.path)
        self.out = files.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True)
        self.index, self.at = io.BytesIO(), 0
        self.n = 0

    def add(self, kind: str, record: bytes) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.member.write(packed)
        self.index.write(json.dumps({"filename": WARC_MEMBER.partition("/")[2], "offset": self.at, "length": len(packed), "type": kind}).encode() + b"\n")
        self.at += len(packed)
        self.n += 1

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX_MEMBER), self.index.getvalue())
        self.zip.close()
        self.out.close()
        return self.path, self.n


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds payload (binary) and first_id: the smallest page_id of the payload where that is another page's.

    The smallest ids are a partial aggregate over digests. Only digests of several pages are joined back; a
    payload that fills a large share of all pages is split by the adaptive skew join.
    """
    pages = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("sha", F.when(F.octet_length("payload") >= min_bytes, F.unhex(F.sha1("payload"))))
    firsts = pages.where("sha is not null").groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return pages.join(firsts, "sha", "left").withColumn("first_id", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("sha", "first")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes packages to folder and returns the manifest (path, records) of those that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for page_id, url, payload, first in zip(*(c for c in batch.columns), strict=True):
                package = package or Package(folder)
                package.add(*make_record(page_id.as_py(), url.as_py(), payload.as_py(), first.as_py()))
                if package.at >= PACKAGE_BYTES:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], names=["path", "records"])

    files, path = open_fs(folder)
    files.create_dir(path)
    return materialize(map_batches(mark_revisits(pages, min_bytes).select(F.col("page_id").cast("string"), "url", "payload", F.col("first_id").cast("string")), run, "path string, records bigint"), "manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True, id_type: str = "bigint") -> DataFrame:
    """One row per record, read from its range of its package and held against its digest."""
    schema = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, url string, package string, record_offset bigint, record_length bigint, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def page(urn: str | None) -> str | None:
        return None if urn is None or urn == "<urn:page:>" else unquote(urn[10:-1])

    def rows_of(path: str) -> Iterator[tuple]:
        files, local = open_fs(path)
        with files.open_input_file(local) as f:
            for start, length, offset in read_entries(f, read_directory(f, f.size())):
                raw = read_range(f, start, length)
                warc, http, payload = parse_record(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
                digest, kind = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"]
                if kind == "response" and (sha1_base32(payload) != digest or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"digest of a record in {path} at {offset} differs")
                yield page(warc["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, page(warc.get("WARC-Refers-To")), warc.get("WARC-Target-URI"), path, offset, length, payload if with_payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = rows_of(path)
                while part := [x for _, x in zip(range(256), rows)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)

    n = max(1, manifest.count())
    found = map_batches(manifest.select("path").repartition(n), run, schema)
    return found.withColumns({x: F.col(x).cast(id_type) for x in ("page_id", "refers_to")})


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = write_archives(pages, new_path(spark, "packages"))
    return read_archives(manifest, with_payload=False, id_type=pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
