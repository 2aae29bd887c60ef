"""WARC records in ZIP packages: written, then read back by ranges without extraction.

A package is a ZIP file with stored members: ``archive/data.warc.gz`` holds one gzip member for each
record, ``indexes/index.cdxj`` one JSON line for each record with its place.  Packages always carry
ZIP64 fields, so they may grow past 4 GiB.  The reader takes the end of the file, follows the end records
(ZIP64 where there) to the central directory, finds each stored member by its local header, reads the
index, and then reads records by their ranges.  Files are opened by URI, whatever the shared store is.

A task starts another package after ``ROTATE`` payload bytes, so its memory stays bounded; a retried
task writes under another name, and only what the written manifest lists is read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm._util import fresh_path, materialise, tune

ROTATE = 16 << 20
#: Fixed values of the ZIP format: signatures of its records, the mark of a field held in ZIP64 form.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Pages in one Arrow batch.
ROWS = 256


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


# ---------------------------------------------------------------------------------- ZIP
class Member(NamedTuple):
    name: str
    method: int
    crc: int
    size: int  # as stored
    full: int  # when read
    header: int  # place of the local header


def _zip64(extra: bytes, full: int, size: int, at: int, disk: int) -> tuple[int, int, int]:
    """Replace fields that are full by what the ZIP64 extra field holds, in its fixed order."""
    k = 0
    while k + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, k)
        if kind == 1:
            body, j = extra[k + 4 : k + 4 + n], 0
            if full == FULL32:
                (full,), j = struct.unpack_from("<Q", body, j), j + 8
            if size == FULL32:
                (size,), j = struct.unpack_from("<Q", body, j), j + 8
            if at == FULL32:
                (at,), j = struct.unpack_from("<Q", body, j), j + 8
            return full, size, at
        k += 4 + n
    if FULL32 in (full, size, at):
        raise ValueError("a full field without its ZIP64 value")
    return full, size, at


def central_directory(f, length: int) -> list[Member]:
    """The members of a ZIP file, from its end records and its central directory."""
    tail_at = max(0, length - (22 + 0xFFFF + 20))
    tail = _range(f, tail_at, length - tail_at)
    k = tail.rfind(END)
    while k >= 0 and (k + 22 > len(tail) or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
        k = tail.rfind(END, 0, k)  # the bytes of the signature may stand in the comment
    if k < 0:
        raise ValueError("no end of central directory")
    n, size, at = struct.unpack_from("<HII", tail, k + 10)
    if FULL16 == n or FULL32 in (size, at):
        if k < 20 or tail[k - 20 : k - 16] != LOCATOR:
            raise ValueError("no ZIP64 locator")
        (end64,) = struct.unpack_from("<Q", tail, k - 12)
        record = _range(f, end64, 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        n, size, at = struct.unpack_from("<QQQ", record, 32)
    raw, out, k = _range(f, at, size), [], 0
    for _ in range(n):
        if raw[k : k + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, k + 8)
        crc, stored, full, n_name, n_extra, n_comment, disk = struct.unpack_from("<IIIHHHH", raw, k + 16)
        (header,) = struct.unpack_from("<I", raw, k + 42)
        name = raw[k + 46 : k + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[k + 46 + n_name : k + 46 + n_name + n_extra]
        full, stored, header = _zip64(extra, full, stored, header, disk)
        out.append(Member(name, method, crc, stored, full, header))
        k += 46 + n_name + n_extra + n_comment
    return out


def _range(f, at: int, n: int) -> bytes:
    f.seek(at)
    got = f.read(n)
    if len(got) != n:
        raise ValueError(f"{n} bytes wanted at {at}, {len(got)} there")
    return bytes(got)


def stored_at(f, m: Member) -> int:
    """Where a stored member's bytes begin; its local header may differ in length from the directory's."""
    if m.method != 0:
        raise ValueError(f"{m.name} is not stored")
    head = _range(f, m.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header of {m.name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return m.header + 30 + n_name + n_extra


def zip_stored(members: list[tuple[str, list[bytes]]]) -> Iterator[bytes]:
    """The bytes of a ZIP64 file of stored members, each given in parts."""
    at, entries = 0, []
    for name, parts in members:
        size, crc = sum(map(len, parts)), 0
        for p in parts:
            crc = zlib.crc32(p, crc)
        own = name.encode()
        extra = struct.pack("<HHQQ", 1, 16, size, size)
        yield LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 0x21, crc, FULL32, FULL32, len(own), len(extra)) + own + extra
        yield from parts
        far = struct.pack("<HHQQQ", 1, 24, size, size, at)
        entries.append(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 0x21, crc, FULL32, FULL32, len(own), len(far), 0, 0, 0, 0, FULL32) + own + far)
        at += 30 + len(own) + len(extra) + size
    directory = b"".join(entries)
    yield directory
    end = at + len(directory)
    yield END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(entries), len(entries), len(directory), at)
    yield LOCATOR + struct.pack("<IQI", 0, end, 1)
    yield END + struct.pack("<HHHHIIH", 0, 0, FULL16, FULL16, FULL32, FULL32, 0)


# ---------------------------------------------------------------------------------- WARC
def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1: 32 characters, no padding."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str | None) -> str:
    """A header's value on one line; what would end the line is escaped."""
    return "" if value is None else value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record.  A revisit has no payload, but tells its length and digest."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    body = b""
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}')}>", f"X-Refers-To-Page-ID: {refers_to}"]
    else:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


class Record(NamedTuple):
    headers: dict
    payload: bytes | None  # None for a revisit


def parse_record(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    if headers["WARC-Type"] == "revisit":
        return Record(headers, None)
    return Record(headers, body.partition(b"\r\n\r\n")[2])


# ---------------------------------------------------------------------------------- writing
def _package(folder: str, gz: list[bytes], index: list[str]) -> tuple[str, int, int]:
    fs, root = open_fs(folder)
    name = f"{uuid.uuid4().hex}.wacz"
    size = 0
    with fs.open_output_stream(f"{root}/{name}") as out:
        for part in zip_stored([(DATA, gz), (INDEX, [("\n".join(index) + "\n").encode()])]):
            out.write(part)
            size += len(part)
    return f"{folder}/{name}", len(index), size


def _writer(folder: str):
    def run(batches):
        gz, index, at, held = [], [], 0, 0
        done = []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "winner", "revisit")]
            for page_id, url, payload, digest, winner, revisit in zip(*cols):
                raw = gzip.compress(record(page_id, url, payload, digest, winner if revisit else None, revisit), 3, mtime=0)
                index.append(json.dumps({"id": page_id, "offset": at, "length": len(raw), "digest": digest}))
                gz.append(raw)
                at += len(raw)
                held += len(payload)
                if held >= ROTATE:
                    done.append(_package(folder, gz, index))
                    gz, index, at, held = [], [], 0, 0
        if gz:
            done.append(_package(folder, gz, index))
        cols = list(zip(*done)) or [(), (), ()]
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["path", "records", "bytes"])

    return run


def payloads(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest`` (20 bytes); a null html is an empty payload."""
    return pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        pages["url"].cast("string").alias("url"),
        F.encode(F.coalesce(pages["html"].cast("string"), F.lit("")), "utf-8").alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write a record per page into packages; returns the written manifest ``path, records, bytes``.

    Of records with equal payloads of ``least_bytes`` or more, the one with the largest page_id is the
    response and the others revisit it.  A page_id that repeats with the same payload is a response
    each time.  A null page_id is never the largest: it revisits, unless all are null.
    """
    spark = pages.sparkSession
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    folder = folder or fresh_path(spark, "packages")
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    p = payloads(pages)
    # one row a digest, combined before its shuffle; written, so that both sides of the join are dealt
    # by the join's own exchange and a hot digest's rows can be split
    won = materialise(p.groupBy("digest").agg(F.max("page_id").alias("winner")).withColumnRenamed("digest", "d"), "winners")
    repeat = (F.octet_length("payload") >= least_bytes) & F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    rows = p.join(won.hint("shuffle_hash"), p.digest == won.d).select("page_id", "url", "payload", _base32().alias("digest"), "winner", repeat.alias("revisit"))
    return materialise(rows.mapInArrow(_writer(folder), "path string, records long, bytes long"), "manifest")


def _base32():
    """Base32 of the 20 digest bytes: each five hex digits are four of its letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    number = lambda k: F.conv(F.substring(F.hex("digest"), 5 * k + 1, 5), 16, 10).cast("int")
    out = []
    for k in range(8):
        out += [F.substr(letters, F.shiftright(number(k), 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*out)


# ---------------------------------------------------------------------------------- reading
def read_package(path: str) -> Iterator[Record]:
    """The records of one package, each by a range read of its own place."""
    fs, name = open_fs(path)
    with fs.open_input_file(name) as f:
        members = {m.name: m for m in central_directory(f, f.size())}
        at = stored_at(f, members[INDEX])
        lines = _range(f, at, members[INDEX].size)
        if zlib.crc32(lines) != members[INDEX].crc:
            raise ValueError(f"{path}: broken index")
        data, end = stored_at(f, members[DATA]), members[DATA].size
        for line in io.BytesIO(lines):
            place = json.loads(line)
            if place["offset"] + place["length"] > end:
                raise ValueError(f"{path}: a record ends beyond its archive")
            yield parse_record(gzip.decompress(_range(f, data + place["offset"], place["length"])))


FIELDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _reader(with_payload: bool):
    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                rows: list[tuple] = []
                for r in read_package(path):
                    h = r.headers
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if r.payload is not None and (payload_digest(r.payload) != digest or len(r.payload) != int(h["X-Payload-Length"])):
                        raise ValueError(f"{path}: a payload differs from its digest")
                    num = lambda k: int(h[k]) if k in h else None
                    url = h["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    rows.append((num("X-Page-ID"), url, h["WARC-Type"], num("X-Refers-To-Page-ID"), int(h["X-Payload-Length"]), digest, r.payload if with_payload else None))
                    if len(rows) >= ROWS:
                        yield _batch(rows, with_payload)
                        rows = []
                if rows:
                    yield _batch(rows, with_payload)

    return run


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    n = 7 if with_payload else 6
    return pa.record_batch([pa.array(list(c), k) for c, k in list(zip(zip(*rows), kinds))[:n]], names=names[:n])


def read(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the packages in ``path``; a response's payload is held against its digest."""
    spark = manifest.sparkSession
    n = max(1, min(4 * int(spark.sparkContext.defaultParallelism), manifest.count()))
    return manifest.select("path").repartition(n).mapInArrow(_reader(with_payload), FIELDS + (", payload binary" if with_payload else ""))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read the packages back: one row per page.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``.  Empty tables give
    empty tables; other columns are ignored; a null url is an empty header.
    """
    return read(write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
w AS (SELECT x, max(page_id) AS m FROM d GROUP BY x)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(x, CAST(5 * (k // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> m THEN m END AS refers_to
FROM d JOIN w USING (x)
"""
