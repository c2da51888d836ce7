"""WARC records in ZIP packages, written by tasks and read back by byte range.

A package is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` holds
the records, each a gzip member of its own, and ``indexes/index.cdx`` has one line per
record with its place in that member. A reader takes the end of the file, follows the central
directory (ZIP64 where sizes ask for it) to the two members, reads the index,
and then only the byte ranges of the records.

Of pages with equal payloads of ``least`` bytes or more, that with the largest id is written as a
response and the others as revisits that name it. Only payloads that occur twice or
more are joined back, from a stored table, so pages with one popular payload
combine before the shuffle and the pages themselves move only if that
table is too large to broadcast.

Defined cases: a null page is an empty payload; a page without an id is always a response; rows that
repeat the largest id are all responses; a null url leaves out that header; line ends in
a url are percent-encoded; an empty table has no package.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readalike.llm.files import open_ranges, write_whole
from readalike.llm.shipping import with_package
from readalike.sources.store import Store

PACKAGE_BYTES = 32 << 20     # a package is closed when its records exceed this
READ_BYTES = 4 << 20         # ranges next to each other are read together up to this
RECORDS_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "path string, n_records long"
RANGES = "path string, begin long, length long"
RECORDS = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
           "refers_to long, payload binary")

_TAIL = struct.Struct("<4s4H2LH")
_TAIL64_PLACE = struct.Struct("<4sLQL")
_TAIL64 = struct.Struct("<4sQ2H2L4Q")
_ENTRY = struct.Struct("<4s4B4HL2L5H2L")
_LOCAL = struct.Struct("<4s2B4HL2L2H")


def with_targets(pages: DataFrame, store: Store, least: int = 0) -> DataFrame:
    """page_id, url, payload, digest (hex) and the page that the row revisits, if any."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    hashed = rows.withColumn("digest", F.sha1("payload"))
    again = hashed.filter(F.octet_length("payload") >= least).groupBy("digest").agg(
        F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    latest = store.write(again.select("digest", "latest"))
    revisits = F.when((F.octet_length("payload") >= least) & (F.col("page_id") < F.col("latest")), F.col("latest"))
    return hashed.join(latest, "digest", "left").select(
        "page_id", "url", "payload", "digest", revisits.alias("refers_to"))


def record_name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(digest))}",
            f"WARC-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        clean = url.replace("\r", "%0D").replace("\n", "%0A")
        head.append(f"WARC-Target-URI: {clean}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}",
                 f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def package(records: list[bytes]) -> bytes:
    """A ZIP file of gzip-compressed records and their index."""
    lines, place = [], 0
    for one in records:
        lines.append(f"{place} {len(one)}")
        place += len(one)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as target:
        for name, data in ((RECORDS_MEMBER, b"".join(records)), (INDEX_MEMBER, "\n".join(lines).encode())):
            target.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def write_packages(pages: DataFrame, store: Store, least: int = 0) -> DataFrame:
    """Writes every page as a record, returns the manifest of the packages."""
    folder = store.folder("warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        records: list[bytes] = []

        def finish() -> pa.RecordBatch:
            path = f"{folder}/pages-{part:06d}-{number:05d}.zip"
            write_whole(path, [package(records)])
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(records)]})

        for batch in batches:
            for k in range(batch.num_rows):
                row = [batch.column(name)[k].as_py() for name in ("page_id", "url", "payload", "digest", "refers_to")]
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                one = squeeze.compress(record(*row)) + squeeze.flush()
                records.append(one)
                size += len(one)
                if size >= PACKAGE_BYTES:
                    yield finish()
                    records, size, number = [], 0, number + 1
        if records:
            yield finish()

    return store.write(with_package(with_targets(pages, store, least)).mapInArrow(write, MANIFEST))


def members(source: pa.NativeFile) -> dict[str, tuple[int, int]]:
    """Place and size of the stored members of a ZIP file, by its central directory."""
    length = source.size()
    tail = source.read_at(min(length, 65_557), max(0, length - 65_557))
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("not a ZIP file")
    _, _, _, _, n, size, begin, _ = _TAIL.unpack_from(tail, at)
    if 0xFFFF in (n,) or 0xFFFFFFFF in (size, begin):
        _, _, place, _ = _TAIL64_PLACE.unpack_from(tail, at - _TAIL64_PLACE.size)
        fields = _TAIL64.unpack(source.read_at(_TAIL64.size, place))
        n, size, begin = fields[7], fields[8], fields[9]
    directory, at, out = source.read_at(size, begin), 0, {}
    for _ in range(n):
        entry = _ENTRY.unpack_from(directory, at)
        method, packed, real, name_size, extra_size, note_size, local = (
            entry[6], entry[10], entry[11], entry[12], entry[13], entry[14], entry[18])
        at += _ENTRY.size
        name = directory[at:at + name_size].decode()
        packed, real, local = wide_sizes(directory[at + name_size:at + name_size + extra_size], packed, real, local)
        at += name_size + extra_size + note_size
        if method != 0 or packed != real:
            raise ValueError(f"member {name} isn't stored")
        head = _LOCAL.unpack(source.read_at(_LOCAL.size, local))
        out[name] = local + _LOCAL.size + head[-2] + head[-1], real
    return out


def wide_sizes(extra: bytes, packed: int, real: int, local: int) -> tuple[int, int, int]:
    """Sizes and place of a member, from the ZIP64 field where the short ones are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            place = at + 4
            values = []
            for short in (real, packed, local):
                if short == 0xFFFFFFFF:
                    short, = struct.unpack_from("<Q", extra, place)
                    place += 8
                values.append(short)
            real, packed, local = values
        at += 4 + size
    return packed, real, local


def record_ranges(manifest: DataFrame) -> DataFrame:
    """Byte range of every record, from the packages' directories and indexes."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open_ranges(path) as source:
                    found = members(source)
                    begin = found[RECORDS_MEMBER][0]
                    place, size = found[INDEX_MEMBER]
                    lines = [line.split() for line in source.read_at(size, place).decode().splitlines()]
                yield pa.RecordBatch.from_pydict({
                    "path": [path] * len(lines), "begin": [begin + int(a) for a, _ in lines],
                    "length": [int(b) for _, b in lines]})

    # A task for each package; the manifest has one short row per package, so numbering it is small.
    number = F.row_number().over(Window.orderBy("path")) - 1
    placed = with_package(manifest).withColumn("number", number)
    return placed.repartitionById(max(1, manifest.count()), F.col("number")).mapInArrow(locate, RANGES)


def parsed(raw: bytes) -> dict[str, object]:
    """Fields and payload of one record; a response's digest is computed from its payload."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and base32(hashlib.sha1(payload, usedforsecurity=False).digest()) != stated:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    page, refers = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")
    return {"page_id": None if page is None else int(page), "url": fields.get("WARC-Target-URI"),
            "record_type": fields["WARC-Type"],
            "payload_bytes": int(fields["WARC-Payload-Length"]) if payload is None else len(payload),
            "payload_digest": stated, "refers_to": None if refers is None else int(refers), "payload": payload}


def read_records(ranges: DataFrame) -> DataFrame:
    """The records at (path, begin, length); a revisit's payload is null."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, begin, length = (batch.column(name).to_pylist() for name in ("path", "begin", "length"))
            at = 0
            while at < len(path):
                to = at + 1
                while (to < len(path) and path[to] == path[at] and begin[to] == begin[to - 1] + length[to - 1]
                       and begin[to] + length[to] - begin[at] <= READ_BYTES):
                    to += 1
                with open_ranges(path[at]) as source:
                    raw = source.read_at(begin[to - 1] + length[to - 1] - begin[at], begin[at])
                rows = [parsed(raw[begin[k] - begin[at]:begin[k] - begin[at] + length[k]]) for k in range(at, to)]
                yield pa.RecordBatch.from_pylist(rows, schema)
                at = to

    return with_package(ranges).mapInArrow(read, RECORDS)
