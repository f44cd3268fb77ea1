"""WARC records in ZIP packages: a writer, and a reader that never extracts.

A package holds two stored (uncompressed) members: the WARC file and an index with a line for each record. The reader finds the
end-of-central-directory record, follows the ZIP64 locator where a field overflows, parses the central directory, checks each
member's local header, and then reads single records by range: index offset plus the member's place in the package.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.llm.common import bounded_batches, scratch, table, text_of, without, written

# Fixed values of the ZIP format: signatures, the value that sends a reader to the ZIP64 fields, and sizes of fixed parts.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
END_SIZE, LOCATOR_SIZE, LOCAL_SIZE = 22, 20, 30
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    crc: int
    header: int  # offset of the local header


# ---- ZIP ----


class ZipWriter:
    """Stored members, written as a stream: sizes and checksums go into a data descriptor and the central directory. All sizes
    and offsets are written as ZIP64 fields, whatever their values."""

    def __init__(self, out) -> None:
        self.out, self.at, self.members, self.open = out, 0, [], None

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def start(self, name: str) -> None:
        raw = name.encode()
        self.open = [raw, self.at, 0, 0]
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.write(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x0808, 0, 0, 33, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)

    def add(self, data: bytes) -> int:
        """Appends to the open member; the offset in the member at which data begins."""
        at = self.open[3]
        self.open[2], self.open[3] = zlib.crc32(data, self.open[2]), at + len(data)
        self.write(data)
        return at

    def end(self) -> None:
        raw, header, crc, size = self.open
        self.write(b"PK\x07\x08" + struct.pack("<IQQ", crc, size, size))
        self.members.append((raw, header, crc, size))

    def close(self) -> None:
        begin = self.at
        for raw, header, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header)
            self.write(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x0808, 0, 0, 33, crc, FULL32, FULL32, len(raw), len(extra), 0, 0, 0, 0, FULL32) + raw + extra)
        length, at, n = self.at - begin, self.at, len(self.members)
        self.write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, begin))
        self.write(LOCATOR64 + struct.pack("<IQI", 0, at, 1))
        self.write(END + struct.pack("<HHHHIIH", 0, 0, n, n, FULL32, FULL32, 0))


def _at(f, offset: int, length: int) -> bytes:
    f.seek(offset)
    data = f.read(length)
    if len(data) != length:
        raise ValueError(f"package ends early: {length} bytes asked for at {offset}, {len(data)} there")
    return data


def directory(f, size: int) -> list[Member]:
    """The members that a package's central directory lists."""
    tail = _at(f, size - min(size, END_SIZE + FULL16), min(size, END_SIZE + FULL16))
    k = tail.rfind(END)
    while k >= 0 and (len(tail) - k < END_SIZE or struct.unpack_from("<H", tail, k + 20)[0] != len(tail) - k - END_SIZE):
        k = tail.rfind(END, 0, k)  # the signature may also occur in a comment
    if k < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    n, length, begin = struct.unpack_from("<HII", tail, k + 10)
    end = size - len(tail) + k
    if FULL16 == n or FULL32 in (length, begin):
        locator = _at(f, end - LOCATOR_SIZE, LOCATOR_SIZE)
        if locator[:4] != LOCATOR64:
            raise ValueError("ZIP64 locator missing")
        record = _at(f, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != END64:
            raise ValueError("ZIP64 end of central directory missing")
        n, length, begin = struct.unpack_from("<QQQ", record, 32)
    data, at, out = _at(f, begin, length), 0, []
    for _ in range(n):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("central directory entry missing")
        method, crc, packed, plain, names, extras, comments, header = struct.unpack_from("<10xH4xIIIHHH8xI", data, at)[0:8]
        name = data[at + 46 : at + 46 + names].decode("utf-8")
        extra = data[at + 46 + names : at + 46 + names + extras]
        x = 0
        while x + 4 <= len(extra):
            kind, room = struct.unpack_from("<HH", extra, x)
            if kind == 1:  # only the fields that overflow are there, in this order
                wide = list(struct.unpack_from(f"<{room // 8}Q", extra, x + 4))
                plain = wide.pop(0) if plain == FULL32 else plain
                packed = wide.pop(0) if packed == FULL32 else packed
                header = wide.pop(0) if header == FULL32 else header
            x += 4 + room
        out.append(Member(name, method, plain, crc, header))
        at += 46 + names + extras + comments
    return out


def data_start(f, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed (method {member.method}); records can be read by range from stored members only")
    head = _at(f, member.header, LOCAL_SIZE)
    if head[:4] != LOCAL:
        raise ValueError(f"local header of {member.name} missing")
    names, extras = struct.unpack_from("<HH", head, 26)
    return member.header + LOCAL_SIZE + names + extras


# ---- WARC ----


def record(page: str, url: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response record, or a revisit of `refers_to`, which has the HTTP headers and no payload."""
    clean = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's headers (lower-case names), HTTP headers and payload. The payload's SHA-1 is held against the header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    if headers["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != headers["warc-payload-digest"].removeprefix("sha1:"):
        raise ValueError(f"digest of {headers['warc-record-id']} doesn't hold")
    return {"headers": headers, "http": fields, "payload": payload}


# ---- Spark ----


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _writer(folder: str, roll: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(folder)
        fs.create_dir(root, recursive=True)
        out = None

        def finish() -> pa.RecordBatch:
            z.end()
            z.start(INDEX_MEMBER)
            z.add(index.getvalue().encode())
            z.end()
            z.close()
            out.close()
            return pa.RecordBatch.from_pydict({"name": [name], "bytes": [z.at], "records": [n]}, schema=pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    # a try that fails leaves a package that no manifest names, never half of one that a manifest does
                    name = f"{uuid.uuid4().hex}.wacz"
                    out, n, index = fs.open_output_stream(f"{root}/{name}"), 0, io.StringIO()
                    z = ZipWriter(out)
                    z.start(WARC_MEMBER)
                page = "null" if row["page_id"] is None else str(row["page_id"])
                ref = None if row["refers_to"] is None else str(row["refers_to"])
                data = record(page, row["url"] or "", row["payload"], row["digest"], ref, date)
                at = z.add(data)
                entry = {"offset": at, "length": len(data), "digest": f"sha1:{row['digest']}", "url": row["url"] or ""}
                index.write(f"page:{page} {date} {json.dumps(entry)}\n")
                n += 1
                if z.at >= roll:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return write


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest (SHA-1) and refers_to: the largest page_id among those of equal payloads of at least `least`
    bytes, null for that page itself, for shorter payloads, and where no page of the group has an id."""
    payload = F.encode(text_of("html"), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("__first"), F.count("*").alias("__n"))
    groups = written(groups.where("__n > 1").drop("__n"), "copies")  # read back, so that a large group of copies can be split in the join
    rows = rows.join(groups, "digest", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("__first"))
    return rows.select("page_id", "url", "payload", "digest", F.when(other, F.col("__first")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, least: int = 1000, roll: int = 1 << 28, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes each row of pages (page_id, url, html) as a record into packages of about `roll` bytes at `folder`; their manifest
    (name, bytes, records). The manifest, and not the folder's listing, says what was written: a lost task's packages aren't in it.
    A null html is the empty payload and a null url the empty URL; repeated rows are records of their own; an empty table gives no
    package; other columns aren't read."""
    bounded_batches(pages.sparkSession)
    kind = "name string, bytes bigint, records bigint"
    return written(with_revisits(pages, least).mapInArrow(_writer(folder, roll, date), kind), "manifest")


def _indexer(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(folder)
        kind = pa.schema([("name", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with fs.open_input_file(f"{root}/{name}") as f:
                    members = {m.name: m for m in directory(f, f.size())}
                    start, index = data_start(f, members[WARC_MEMBER]), members[INDEX_MEMBER]
                    left, at, rest = index.size, data_start(f, index), b""
                    while left:  # the index of a large package is read in pieces, too
                        step = min(left, 1 << 22)
                        lines = (rest + _at(f, at, step)).split(b"\n")
                        at, left, rest = at + step, left - step, lines.pop()
                        entries = [json.loads(x.split(b" ", 2)[2]) for x in lines]
                        yield pa.RecordBatch.from_pydict({"name": [name] * len(entries), "offset": [start + e["offset"] for e in entries], "length": [e["length"] for e in entries]}, schema=kind)

    return read


RECORD = "record_id string, record_type string, url string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


def _ranges(folder: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(folder)
        kind = pa.schema([(n, {"bigint": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in RECORD.split(", "))])
        name, f = None, None
        for batch in batches:
            rows, held = [], 0
            for n, offset, length in zip(*(batch.column(c).to_pylist() for c in ("name", "offset", "length")), strict=True):
                if n != name:
                    if f:
                        f.close()
                    name, f = n, fs.open_input_file(f"{root}/{n}")
                r = parse(_at(f, offset, length))
                h = r["headers"]
                ref = h.get("warc-refers-to")
                rows.append((h["warc-record-id"], h["warc-type"], h["warc-target-uri"], ref, h["warc-payload-digest"].removeprefix("sha1:"), int(r["http"]["content-length"]), r["payload"] if with_payload else None))
                held += length
                if with_payload and held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)
        if f:
            f.close()

    return read


def read_packages(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the packages in manifest. Index entries are dealt out in runs, so that a large package is read by
    many tasks, each by ranges. A damaged package or record is an error that names it."""
    spark = manifest.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = manifest.select("name").repartition(n)
    entries = names.mapInArrow(_indexer(folder), "name string, offset bigint, length bigint")
    runs = entries.repartition(n, "name", F.floor(F.col("offset") / (1 << 24))).sortWithinPartitions("name", "offset")
    return runs.mapInArrow(_ranges(folder, with_payload), RECORD)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "packages")
    manifest = write_packages(table(spark, sf_dir, "pages"), folder)
    got = without(read_packages(manifest, folder, with_payload=False), "payload")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return got.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select *, max(page_id) over (partition by payload_digest) as big from p)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and big <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and big <> page_id then big end as refers_to
from m
"""
