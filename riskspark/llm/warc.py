"""WARC records in ZIP packages, written and read by range.

A package holds stored (not deflated) members: `archive/N.warc.gz`, one gzip
member per record, and `indexes/N.cdxj`, a line per record with its place. The
reader takes a package's end, parses its central directory (ZIP64 too), finds
the stored members and their indexes, and reads records by range; nothing is
extracted. Packages lie in a folder that all executors share and are reached
through Arrow's file systems, by URI.
"""

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from riskspark.session import stage

#: Payloads of at least so many bytes are stored once.
LEAST_BYTES = 1000
#: Bytes of records in a member, and members in a package.
MEMBER_BYTES = 4_000_000
PACKAGE_MEMBERS = 64
#: Bytes that one range read takes at most, if a record is not longer.
READ_BYTES = 4_000_000
#: Bytes of members that one task reads.
TASK_BYTES = 32_000_000

#: Marks and sizes of the ZIP format.
END_MARK, END64_MARK, LOCATOR_MARK, ENTRY_MARK, LOCAL_MARK = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
END_SIZE, LOCATOR_SIZE, END64_SIZE, ENTRY_SIZE, LOCAL_SIZE = 22, 20, 56, 46, 30
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


# ---------------------------------------------------------------- records

def record(page_id, url, payload: bytes, kind: str, refers_to, digest: str) -> bytes:
    """A gzip member with one WARC record; a revisit holds headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{_shown(page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {re.sub(r'[\r\n]', lambda m: f'%{ord(m[0]):02X}', url)}")
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{_shown(refers_to)}>",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _shown(page_id) -> str:
    return "" if page_id is None else str(page_id)


def parse(data: bytes) -> dict:
    """The record in one gzip member, its payload checked against its digest."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
    return {
        "page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": size,
        "payload_digest": digest, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None,
    }


# --------------------------------------------------------------- packages

class Ranges:
    """Reads a file by range."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, size: int) -> bytes:
        found = self.file.read_at(size, at)
        if len(found) != size:
            raise ValueError("the package ends early")
        return found

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def directory(ranges) -> tuple[int, int, int]:
    """(offset, size, entries) of the central directory; ZIP64 where the end record says so."""
    tail_size = min(ranges.size, END_SIZE + FULL16 + LOCATOR_SIZE)
    tail = ranges.read(ranges.size - tail_size, tail_size)
    at = tail.rfind(END_MARK, 0, max(0, len(tail) - END_SIZE + len(END_MARK)))
    while at >= 0 and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END_MARK, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if entries == FULL16 or size == FULL32 or offset == FULL32:
        locator = at - LOCATOR_SIZE
        if locator < 0 or tail[locator:locator + 4] != LOCATOR_MARK:
            raise ValueError("no ZIP64 locator")
        end64 = ranges.read(struct.unpack_from("<Q", tail, locator + 8)[0], END64_SIZE)
        if end64[:4] != END64_MARK:
            raise ValueError("no ZIP64 end record")
        entries, size, offset = struct.unpack_from("<QQQ", end64, 32)
    return offset, size, entries


def members(ranges) -> list[dict]:
    """Name, method, size and local header offset of each member."""
    offset, size, entries = directory(ranges)
    data, at, found = ranges.read(offset, size), 0, []
    for _ in range(entries):
        if data[at:at + 4] != ENTRY_MARK:
            raise ValueError("damaged central directory")
        method, packed, plain = struct.unpack_from("<H8xII", data, at + 10)
        names, extras, comment = struct.unpack_from("<HHH", data, at + 28)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + ENTRY_SIZE:at + ENTRY_SIZE + names].decode()
        extra = data[at + ENTRY_SIZE + names:at + ENTRY_SIZE + names + extras]
        plain, packed, header = _extended(extra, plain, packed, header)
        found.append({"name": name, "method": method, "size": packed, "header": header})
        at += ENTRY_SIZE + names + extras + comment
    return found


def _extended(extra: bytes, *values: int) -> list[int]:
    """The values, those that are full replaced from the ZIP64 field in order."""
    at, wide = 0, b""
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            wide = extra[at + 4:at + 4 + size]
        at += 4 + size
    out, k = [], 0
    for value in values:
        if value == FULL32:
            value = struct.unpack_from("<Q", wide, k)[0]
            k += 8
        out.append(value)
    return out


def data_offset(ranges, member: dict) -> int:
    """Where a stored member's bytes begin."""
    if member["method"] != 0:
        raise ValueError(f"{member['name']} is not stored")
    local = ranges.read(member["header"], LOCAL_SIZE)
    if local[:4] != LOCAL_MARK:
        raise ValueError("no local header")
    names, extras = struct.unpack_from("<HH", local, 26)
    return member["header"] + LOCAL_SIZE + names + extras


# ------------------------------------------------------------------ Spark

def planned(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The pages with payload, payload_digest, record_type and refers_to.

    Of equal payloads of `least_bytes` or more, the row with the largest
    page_id is the response (rows that repeat that id too), the others revisit
    it. A null html is an empty payload. Where all page_ids of equal payloads
    are null, all are responses.

    Digests are counted first, with partial sums, and only those met more than
    once are written to a small table that the pages are joined to, so that
    a payload shared by many pages is an ordinary skewed join.
    """
    digest = F.sha1("payload")
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    shared = stage(
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy(digest.alias("shared_digest"), F.octet_length("payload").alias("shared_bytes"))
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1 and first_id is not null").drop("copies"),
        "payloads",
    )
    rows = rows.withColumn("payload_digest", digest).withColumn("payload_bytes", F.octet_length("payload"))
    known = rows.join(
        shared, (F.col("payload_digest") == F.col("shared_digest")) & (F.col("payload_bytes") == F.col("shared_bytes")), "left",
    )
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return known.select(
        "page_id", "url", "payload", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, member_bytes: int = MEMBER_BYTES) -> DataFrame:
    """Writes ZIP packages under `folder`, a URI all executors reach; returns one row per package: uri, records.

    Takes page_id, url, html; other columns are ignored. Package names are
    unique per attempt, and only those of finished tasks are in the result, so
    a task that runs again or twice leaves no record double. A null html is an
    empty payload, a null url leaves its header out. A very long payload is one
    record. An empty table gives no package.
    """
    rows = planned(pages, least_bytes).select("page_id", "url", "payload", "record_type", "refers_to", "payload_digest")

    def pack(batches):
        package = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                package = package or _Package(folder, member_bytes)
                package.add(row[0], record(row[0], row[1], bytes(row[2]), row[3], row[4], row[5]))
                if package.members >= PACKAGE_MEMBERS:
                    yield package.close()
                    package = None
        if package:
            yield package.close()

    return stage(rows.mapInArrow(pack, "uri string, records long"), "packages")


class _Package:
    """A package while it is written."""

    def __init__(self, folder: str, member_bytes: int):
        self.member_bytes = member_bytes
        self.uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.zip"
        system, path = fs.FileSystem.from_uri(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.file = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Sink(self.file), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.members = self.records = 0
        self.data, self.lines = io.BytesIO(), []

    def add(self, page_id, data: bytes):
        self.lines.append(json.dumps({"page": _shown(page_id), "offset": self.data.tell(), "length": len(data)}))
        self.data.write(data)
        self.records += 1
        if self.data.tell() >= self.member_bytes:
            self.flush()

    def flush(self):
        if self.lines:
            self.zip.writestr(_info(f"archive/{self.members}.warc.gz"), self.data.getvalue())
            self.zip.writestr(_info(f"indexes/{self.members}.cdxj"), "\n".join(self.lines))
            self.members += 1
            self.data, self.lines = io.BytesIO(), []

    def close(self):
        self.flush()
        self.zip.close()
        self.file.close()
        return pa.RecordBatch.from_arrays([pa.array([self.uri]), pa.array([self.records], pa.int64())], names=["uri", "records"])


def _info(name: str) -> zipfile.ZipInfo:
    return zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))


class _Sink:
    """An output stream as zipfile wants it; it can't be sought."""

    def __init__(self, file):
        self.file = file

    def write(self, data):
        self.file.write(data)
        return len(data)

    def flush(self):
        self.file.flush()


RECORDS = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"
RECORD_FIELDS = pa.schema([
    ("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()),
])


def read(packages: DataFrame, uri_col: str = "uri", task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row per record of the packages named in `uri_col`.

    Directories are read first; the stored members are then dealt out to one
    task for each `task_bytes` of them (as many tasks as there are cores, at
    least, while there are members), and each member's records are read by the
    ranges its index names, neighbours together. A deflated archive member, or
    one without an index, is an error. Null URIs are left out. No packages give
    no records.
    """
    def locate(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with Ranges(uri) as ranges:
                    found = {m["name"]: m for m in members(ranges)}
                    rows = []
                    for name, member in found.items():
                        if m := re.fullmatch(r"archive/(.+)\.warc\.gz", name):
                            index = found.get(f"indexes/{m[1]}.cdxj")
                            if index is None:
                                raise ValueError(f"{name} has no index")
                            rows.append((uri, data_offset(ranges, member), member["size"], data_offset(ranges, index), index["size"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["uri", "at", "size", "index_at", "index_size"])

    def fetch(batches):
        for batch in batches:
            for uri, at, index_at, index_size in zip(*(c.to_pylist() for c in batch.columns)):
                with Ranges(uri) as ranges:
                    places = [json.loads(x) for x in ranges.read(index_at, index_size).decode().split("\n")]
                    places.sort(key=lambda p: p["offset"])
                    k = 0
                    while k < len(places):
                        start, stop, n = places[k]["offset"], 0, k
                        while n < len(places) and (n == k or places[n]["offset"] + places[n]["length"] - start <= READ_BYTES):
                            stop = places[n]["offset"] + places[n]["length"]
                            n += 1
                        data = ranges.read(at + start, stop - start)
                        rows = [parse(data[p["offset"] - start:p["offset"] - start + p["length"]]) for p in places[k:n]]
                        yield pa.RecordBatch.from_pylist(rows, RECORD_FIELDS)
                        k = n

    cores = packages.sparkSession.sparkContext.defaultParallelism
    packages = packages.where(F.col(uri_col).isNotNull()).select(uri_col)
    found = stage(
        packages.repartition(max(1, min(packages.count(), 4 * cores)))
        .mapInArrow(locate, "uri string, at long, size long, index_at long, index_size long"), "members")
    total = found.agg(F.count("*").alias("members"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    # A given number of tasks stays, however small the rows that name the members are.
    tasks = max(1, min(total["members"], max(-(-total["size"] // task_bytes), cores)))
    return found.repartition(tasks).select("uri", "at", "index_at", "index_size").mapInArrow(fetch, RECORDS)


def digests(records: DataFrame) -> DataFrame:
    """Per record, what its headers and payload say."""
    whole = lambda c: F.expr(f"try_cast({c} as bigint)").alias(c)
    return records.select(whole("page_id"), "payload_bytes", "payload_digest", "record_type", whole("refers_to"))
