"""Web archives in ZIP packages: written by Spark, read back by ranges without extraction.

A package is a ZIP file whose members are stored, not compressed: ``archive/data-N.warc.gz`` with
one gzip member per WARC record, followed by ``indexes/data-N.cdx`` with a line per record. A
reader finds the central directory from the end of the file (ZIP64 included), and from it the
offset of every member; an index gives the range of every record, so any record is one ranged read.

Packages are written through Spark's text writer, whose commit protocol survives lost executors:
each row is one ZIP entry as raw bytes. The line feed after a row falls into the gap that ZIP
allows between entries, and that after the last row is the one-byte archive comment.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickline.llm.common import narrowed, scratch, table
from pickline.session import cut

#: Compressed bytes after which a data member is closed; a record is never split.
MEMBER_BYTES = 8 << 20
#: Most bytes of a member read at once; a longer record is read whole.
READ_BYTES = 4 << 20
#: Most tasks that the members are dealt out to; further members share tasks.
READERS = 20_000
#: Where ZIP's 32-bit and 16-bit fields end and ZIP64's begin.
LIMIT_32, LIMIT_16 = 0xFFFFFFFF, 0xFFFF

LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
END_64, LOCATOR_64 = b"PK\x06\x06", b"PK\x06\x07"
DOS_DATE = (2024 - 1980) << 9 | 1 << 5 | 1
WARC_DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- one record ---------------------------------------------------------------------------------

def pack_record(page_id, url, payload: bytes, refers_to) -> bytes:
    """A gzip member with a response, or with a revisit of page ``refers_to``, without a payload."""
    kind = "response" if refers_to is None else "revisit"
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {WARC_DATE}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(4, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def parse_record(data: bytes) -> dict:
    """The fields of one gzip member; the digest of a response is checked against its payload."""
    head, _, rest = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page = lambda name: (
        int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    )
    return {
        "page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"),
        "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": page("WARC-Refers-To"),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


# ---- one package --------------------------------------------------------------------------------

def _entry(name: bytes, data: bytes) -> bytes:
    """A stored local entry; its sizes fit 32 bits because members are closed far earlier."""
    return struct.pack("<4s5H3I2H", LOCAL, 20, 0x800, 0, 0, DOS_DATE, zlib.crc32(data), len(data),
                       len(data), len(name), 0) + name + data


def _central(name: bytes, crc: int, size: int, offset: int, zip64: bool) -> bytes:
    extra = struct.pack("<2HQ", 1, 8, offset) if zip64 or offset >= LIMIT_32 else b""
    return struct.pack("<4s6H3I5H2I", CENTRAL, 45 if extra else 20, 45 if extra else 20, 0x800, 0, 0,
                       DOS_DATE, crc, size, size, len(name), len(extra), 0, 0, 0, 0,
                       LIMIT_32 if extra else offset) + name + extra


def package_rows(records: Iterator[tuple], member_bytes: int = MEMBER_BYTES,
                 zip64: bool = False) -> Iterator[bytes]:
    """The rows of one package; each is followed by one line feed in the file.

    ``records`` yields ``(page_id, url, payload, refers_to)``. One open data member and a
    directory line per member are all that is held. ``zip64`` forces the large form.
    """
    at, directory, number = 0, [], 0

    def member(name: bytes, data: bytes) -> bytes:
        nonlocal at
        row = _entry(name, data)
        directory.append(_central(name, zlib.crc32(data), len(data), at, zip64))
        at += len(row) + 1
        return row

    def close(data: bytearray, lines: list[str]) -> Iterator[bytes]:
        nonlocal number
        yield member(b"archive/data-%05d.warc.gz" % number, bytes(data))
        yield member(b"indexes/data-%05d.cdx" % number, "".join(lines).encode())
        number += 1

    data, lines = bytearray(), []
    for page_id, url, payload, refers_to in records:
        packed = pack_record(page_id, url, payload, refers_to)
        lines.append(f"{len(data)} {len(packed)}\n")
        data += packed
        if len(data) >= member_bytes:
            yield from close(data, lines)
            data, lines = bytearray(), []
    if lines:
        yield from close(data, lines)
    if not directory:
        return
    listing, n = b"".join(directory), len(directory)
    end = b""
    if zip64 or n >= LIMIT_16 or at >= LIMIT_32 or len(listing) >= LIMIT_32:
        end = struct.pack("<4sQ2H2I4Q", END_64, 44, 45, 45, 0, 0, n, n, len(listing), at)
        end += struct.pack("<4sIQI", LOCATOR_64, 0, at + len(listing), 1)
        short = (LIMIT_16, LIMIT_16, LIMIT_32, LIMIT_32)
    else:
        short = (n, n, len(listing), at)
    yield listing + end + struct.pack("<4s2H2H2IH", END, 0, 0, *short, 1)


def _read(file, at: int, length: int) -> bytes:
    file.seek(at)
    got = file.read(length)
    if len(got) != length:
        raise EOFError(f"{length} bytes wanted at {at}, {len(got)} there")
    return got


def read_directory(file, size: int) -> list[tuple[str, int, int, int]]:
    """``(name, header offset, stored bytes, crc)`` of every stored member; others are an error."""
    tail = _read(file, max(0, size - 65_557), min(size, 65_557))
    at = tail.rfind(END, 0, len(tail) - 18)
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    n, length, start = struct.unpack_from("<H2I", tail, at + 10)
    place = size - len(tail) + at
    if place >= 20 and (n == LIMIT_16 or LIMIT_32 in (length, start)):
        locator = _read(file, place - 20, 20)
        if locator[:4] == LOCATOR_64:
            large = _read(file, struct.unpack_from("<Q", locator, 8)[0], 56)
            n, length, start = struct.unpack_from("<3Q", large, 32)
    listing, members, p = _read(file, start, length), [], 0
    for _ in range(n):
        if listing[p : p + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        method, = struct.unpack_from("<H", listing, p + 10)
        crc, packed, plain, n_name, n_extra, n_note = struct.unpack_from("<3I3H", listing, p + 16)
        offset, = struct.unpack_from("<I", listing, p + 42)
        name = listing[p + 46 : p + 46 + n_name].decode()
        q, stop = p + 46 + n_name, p + 46 + n_name + n_extra
        while q + 4 <= stop:
            tag, width = struct.unpack_from("<2H", listing, q)
            if tag == 1:
                r = q + 4
                if plain == LIMIT_32:
                    plain, = struct.unpack_from("<Q", listing, r)
                    r += 8
                if packed == LIMIT_32:
                    packed, = struct.unpack_from("<Q", listing, r)
                    r += 8
                if offset == LIMIT_32:
                    offset, = struct.unpack_from("<Q", listing, r)
            q += 4 + width
        if method or packed != plain:
            raise ValueError(f"{name} is not stored")
        members.append((name, offset, packed, crc))
        p = stop + n_note
    return members


def member_start(file, header: int) -> int:
    """Where a member's bytes begin; the local header has lengths of its own."""
    local = _read(file, header, 30)
    if local[:4] != LOCAL:
        raise ValueError("damaged local header")
    return header + 30 + sum(struct.unpack_from("<2H", local, 26))


def read_range_records(file, start: int, lines: list[tuple[int, int]],
                       read_bytes: int = READ_BYTES) -> Iterator[bytes]:
    """The records at ``(offset, length)`` of a member, neighbours fetched in one ranged read."""
    i = 0
    while i < len(lines):
        first, j = lines[i][0], i + 1
        while j < len(lines) and lines[j][0] + lines[j][1] - first <= read_bytes:
            j += 1
        got = _read(file, start + first, lines[j - 1][0] + lines[j - 1][1] - first)
        for offset, length in lines[i:j]:
            yield got[offset - first : offset - first + length]
        i = j


def open_file(path: str):
    """A seekable file in any store that Arrow reaches by URI (file, hdfs, s3, gs, ...)."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/(?!//)", "file:///", path))
    return store.open_input_file(inner)


# ---- Spark --------------------------------------------------------------------------------------

def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, refers_to)`` of pages ``(page_id, url, html)``.

    Payloads of at least ``min_bytes`` that are equal point to the smallest page id among them.
    Only ids and digests are grouped and joined; texts are joined once, with the revisits alone.
    """
    rows = pages.select(
        "page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    keys = cut(rows.filter(F.octet_length("payload") >= min_bytes).select("page_id", "digest"))
    firsts = (
        keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"),
                                   F.count("page_id").alias("named"), F.count("*").alias("n"))
        .filter("first < last or named < n").select("digest", "first")
    )
    refs = cut(
        keys.join(firsts, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first")))
        .select(F.col("page_id").alias("ref_id"), F.col("digest").alias("ref_digest"),
                F.col("first").alias("refers_to"))
        .distinct()
    )
    return rows.join(
        refs, F.col("page_id").eqNullSafe(F.col("ref_id")) & (F.col("digest") == F.col("ref_digest")),
        "left",
    ).select("page_id", "url", "payload", "refers_to")


def write_packages(records: DataFrame, path: str, member_bytes: int = MEMBER_BYTES,
                   zip64: bool = False) -> None:
    """One package below ``path`` per partition of ``records`` (see :func:`with_revisits`)."""

    def rows(batches):
        given = (
            (None if pd.isna(r[0]) else int(r[0]), r[1], bytes(r[2]), None if pd.isna(r[3]) else int(r[3]))
            for b in batches for r in zip(b.page_id, b.url, b.payload, b.refers_to, strict=True)
        )
        for row in package_rows(given, member_bytes, zip64):
            yield pd.DataFrame({"row": [row]})

    records.mapInPandas(rows, "row binary").select(F.col("row").cast("string").alias("value")) \
        .write.text(path)


RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long")


def read_packages(spark: SparkSession, path: str, payloads: bool = False,
                  access: str = "ranges") -> DataFrame:
    """Every record of the packages below ``path``, one row each.

    Spark lists the files. A first step reads only the end of each package and yields its members;
    these are dealt out, and a second step reads each data member's index and then its records by
    ranges. ``access="content"`` reads the packages through Spark itself, for stores that Arrow
    doesn't reach. Empty files hold no package. A damaged package is an error.
    """
    listed = spark.read.format("binaryFile").load(path).filter("length > 0")
    if access == "content":
        listed = listed.select("path", "length", "content")
    else:
        listed = listed.select("path", "length", F.lit(None).cast("binary").alias("content"))

    def opened(path, content):
        return open_file(path) if content is None else io.BytesIO(content)

    def members(batches):
        for b in batches:
            for path, length, content in zip(b.path, b.length, b.content, strict=True):
                with opened(path, content) as file:
                    found = {m[0]: m for m in read_directory(file, length)}
                rows = [
                    (path, m[1], found["indexes" + name[7:-8] + ".cdx"][1],
                     found["indexes" + name[7:-8] + ".cdx"][2], content)
                    for name, m in found.items() if name.startswith("archive/")
                ]
                yield pd.DataFrame(rows, columns=["path", "data", "index", "index_bytes", "content"])

    def records(batches):
        for b in batches:
            for path, data, index, n, content in zip(*[b[c] for c in b.columns], strict=True):
                with opened(path, content) as file:
                    lines = _read(file, member_start(file, index), n).decode().split("\n")[:-1]
                    ranges = [tuple(map(int, x.split())) for x in lines]
                    out, held = [], 0
                    for raw in read_range_records(file, member_start(file, data), ranges):
                        out.append(parse_record(raw))
                        held += len(out[-1]["payload"] or b"") * payloads
                        if not payloads:
                            del out[-1]["payload"]
                        if len(out) >= 4096 or held >= READ_BYTES:
                            yield pd.DataFrame(out)
                            out, held = [], 0
                    if out:
                        yield pd.DataFrame(out)

    found = listed.mapInPandas(members, "path string, data long, index long, index_bytes long, content binary")
    if access != "content":  # rows of some bytes that stand for megabytes: one task each
        found = cut(found)
        found = found.repartition(max(1, min(found.count(), READERS)))

    def typed(batches):
        names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * payloads
        for b in batches:
            for c in ("page_id", "refers_to"):
                b[c] = b[c].astype("Int64")
            yield b[names]

    return found.mapInPandas(lambda x: typed(records(x)), RECORD + ", payload binary" * payloads)


def op5_web_packages(spark, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the packages it was written to.

    Pages with a null html have an empty payload; a page with a null id refers to the smallest id
    of its group, and where no page of a group has an id all are responses; of repeated rows of the
    smallest id each is a response. An empty table gives no packages and no rows.
    """
    pages = narrowed(table(spark, sf_dir, "pages"), page_id="page_id", url="url", html="html")
    path = scratch(spark, "packages")
    write_packages(with_revisits(pages), path)
    return read_packages(spark, path).drop("url")


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP5_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, payload_bytes, hex, min(page_id) OVER (PARTITION BY hex) AS first,
         list_aggregate(list_transform(range(32), lambda i: substr('{_BASE32}',
           1 + CAST((CAST('0x' || substr(hex, CAST(10 * (i // 8) + 1 AS BIGINT), 10) AS BIGINT)
                     >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT), 1)), 'string_agg', '')
           AS payload_digest
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
