"""Legacy web archives (ARC, versions 1 and 2) made, read and converted to WARC.

An ARC file begins with a version block that says how its header lines are written: five
fields in version 1, ten in version 2, the last of them the declared length of what follows.
Records are cut by these lengths alone, whatever their bytes. Each becomes a WARC record
whose identifier, timestamp, type and digests are derived from the header line, the place in
the archive and the bytes, so a repeated task writes the same record.

Archives are files of one gzip member a record, written by Spark's text writer (a file a
row, committed with the job) and read by its binary file source, so any store that Spark
reaches will do. A file ends with a zero byte, which gzip readers skip as padding.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redlake.sources.tables import fresh_path

from .common import sliced, table, written

#: Compressed bytes at which an archive is closed; a longer record has an archive of its own.
ARCHIVE_BYTES = 32 << 20
#: Bytes of records that are sent on at once.
BATCH_BYTES = 4 << 20
#: Duplicated payloads that are broadcast at most; beyond that they are dealt out with so many salts.
BROADCAST_ROWS, SALTS = 200_000, 32
LEVEL = 3
#: HTTP header that carries a page's id through the archives, and the WARC field for the id of the page that a revisit refers to.
ID_HEADER, REFERS_FIELD = "X-Page-Id", "X-Refers-To-Page-Id"

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArcRecord(NamedTuple):
    """A record as its header line and declared length give it; fields that a version lacks, and '-', are None."""

    url: str | None
    ip: str | None
    date: str
    mime: str | None
    status: int | None
    offset: int
    block: bytes


def _decoded(line: bytes) -> str:
    """A header line as text; bytes that aren't UTF-8 are percent-encoded."""
    return re.sub("[\udc80-\udcff]", lambda m: f"%{ord(m[0]) - 0xDC00:02X}", line.decode("utf-8", "surrogateescape"))


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _plain(data: bytes) -> BinaryIO:
    """The bytes of an archive, whether or not they are compressed."""
    raw = io.BytesIO(data)
    return gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw


def _line(source: BinaryIO) -> bytes:
    """The next line that isn't blank, or b'' at the end."""
    while line := source.readline():
        if line.strip(b"\r\n\x00"):
            return line.rstrip(b"\r\n")
    return b""


def _exactly(source: BinaryIO, n: int, where: str) -> bytes:
    data = source.read(n)
    if len(data) < n:
        raise ValueError(f"{where}: {n} bytes are declared, {len(data)} are left")
    return data


def parse_arc(data: bytes, name: str = "") -> Iterator[ArcRecord]:
    """The records of an ARC file, the version block left out; damage is an error that names the place."""
    source, version = _plain(data), 0
    while line := _line(source):
        where = f"{name} before byte {source.tell()}"
        text = _decoded(line)
        if not version:
            if not text.startswith("filedesc:") or not text.rsplit(" ", 1)[-1].isdecimal():
                raise ValueError(f"{where}: no version block")
            block = _exactly(source, int(text.rsplit(" ", 1)[1]), where)
            version = int(block[:1]) if block[:1] in (b"1", b"2") else 0
            if not version:
                raise ValueError(f"{where}: version {block[:3]!r}")
            continue
        field = [None if x == "-" else x for x in text.rsplit(" ", ARC_FIELDS[version].count(" "))]  # an address may hold spaces
        if len(field) <= ARC_FIELDS[version].count(" ") or not (field[-1] or "").isdecimal() or not re.fullmatch(r"\d{14}", field[2] or ""):
            raise ValueError(f"{where}: header {text[:200]!r}")
        status = int(field[4]) if version == 2 and (field[4] or "").isdecimal() else None
        yield ArcRecord(field[0], field[1], field[2], field[3], status, source.tell(), _exactly(source, int(field[-1]), where))


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """(head, payload): the head of an HTTP response with its empty line, b'' if the block has none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = re.search(rb"\r?\n\r?\n", block)
    return (block[: end.end()], block[end.end() :]) if end else (block, b"")


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def record_id(archive: str, offset: int) -> str:
    """The identifier of what stands at a place of an archive."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}"


def warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(fields: Iterable[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def parse_warc(data: bytes, name: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of a WARC file."""
    source = _plain(data)
    while line := _line(source):
        where = f"{name} before byte {source.tell()}"
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{where}: {line[:80]!r} begins no record")
        fields = {}
        while line := source.readline().strip():
            key, _, value = _decoded(line).partition(":")
            fields[key.strip().lower()] = value.strip()
        yield fields, _exactly(source, int(fields["content-length"]), where)


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Archives:
    """Records of one task in archives of bounded size: a file is given out when the next record would go beyond it."""

    def __init__(self, most: int):
        self.most, self.parts, self.size = most, [], 0

    def add(self, record: bytes) -> int:
        """Where the record begins among the compressed bytes."""
        at = self.size
        self.parts.append(_member(record))
        self.size += len(self.parts[-1])
        return at

    def full(self) -> bool:
        return self.size >= self.most

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([b"".join(self.parts)], pa.binary())], names=["content"])
        self.parts, self.size = [], 0
        return out


def _write(archives: DataFrame, path: str) -> None:
    """Each row's bytes as a file."""
    archives.select(F.col("content").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content): a row a file, named by the last part of its path."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def _head(id_: object, payload: bytes) -> bytes:
    own = f"{ID_HEADER}: {id_}\r\n" if id_ is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode()


def _address(url: str | None) -> str:
    """url as one field of a header line."""
    if url is None:
        return "-"
    return "%2D" if url == "-" else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20000101000000", versions: tuple[int, ...] = (1, 2), archive_bytes: int = ARCHIVE_BYTES) -> None:
    """ARC files of pages, a record a row. A null address is '-', a null text an empty payload, a null id has no header. No shuffle.

    The archives take turns with the versions, beginning with another in each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, turn = _Archives(archive_bytes), TaskContext.get().partitionId()
        for b in sliced(batches, 200):
            for id_, url, html in zip(*b.columns, strict=True):
                if not out.parts:
                    version, turn = versions[turn % len(versions)], turn + 1
                    about = f"{version} 0 redlake\n{ARC_FIELDS[version]}\n\n".encode()
                    more = " 200 - - 0 pages.arc" if version == 2 else ""
                    out.add(f"filedesc://pages.arc 0.0.0.0 {date} text/plain{more} {len(about)}\n".encode() + about)
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                block = _head(id_.as_py(), payload) + payload
                more_own = f" 200 {digest(payload)} - {out.size} pages.arc" if version == 2 else ""
                out.add(f"{_address(url.as_py())} 0.0.0.0 {date} text/html{more_own} {len(block)}\n".encode("utf-8", "surrogatepass") + block + b"\n")
                if out.full():
                    yield out.take()
        if out.parts:
            yield out.take()

    _write(pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, "content binary"), path)


_ARC = "archive string, offset long, url string, ip string, date string, mime string, status int, page_id string, payload_bytes long, payload_digest string"


def read_arc(spark: SparkSession, path: str, with_bytes: bool = True) -> DataFrame:
    """A row a record: its archive and place, header fields, page_id (HTTP header, else null), size and digest of the payload, and head and payload if with_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(*b.columns, strict=True):
                rows, size = [], 0
                for r in parse_arc(content.as_py(), archive.as_py()):
                    head, payload = http_parts(r.block)
                    status = r.status if r.status or not head else int((re.match(rb"HTTP/\S+ (\d{3})\b", head) or [0, 0])[1]) or None
                    rows.append((archive.as_py(), r.offset, r.url, r.ip, r.date, r.mime, status, http_field(head, ID_HEADER), len(payload), digest(payload), *([head, payload] if with_bytes else [])))
                    size += len(r.block) if with_bytes else 100
                    if size > BATCH_BYTES:
                        yield _batch(rows, with_bytes)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, with_bytes)

    return _files(spark, path).mapInArrow(run, _ARC + ", head binary, payload binary" * with_bytes)


_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
_ARC_ARROW = [(c.split()[0], _TYPES[c.split()[1]]) for c in _ARC.split(", ")]


def _batch(rows: list[tuple], with_bytes: bool) -> pa.RecordBatch:
    kinds = _ARC_ARROW + [("head", pa.binary()), ("payload", pa.binary())] * with_bytes
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])


def first_of_equals(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(payload_digest, payload_bytes, first) of payloads that occur more than once, of least_bytes at least.

    first is the record with the smallest page_id, nulls last, and of equal ids the one
    that stands first. Counted by partial aggregates: a payload may have any number of records.
    """
    own = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").cast("long").alias("id"), "archive", "offset", "url", "date")
    return records.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def with_first(records: DataFrame, first: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """records with `first`, null where it is the record itself or no other has its payload.

    The firsts (a written table) are broadcast if counted as few. Beyond that they are dealt
    out with salts, so that the records of one payload are not one task's.
    """
    same = ["payload_digest", "payload_bytes"]
    if first.limit(most + 1).count() <= most:
        met = records.join(F.broadcast(first), same, "left")
    else:
        salted = first.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = records.withColumn("__salt", F.pmod(F.xxhash64("archive", "offset"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [*same, "__salt"], "left").drop("__salt")
    other = (F.col("first.archive") != F.col("archive")) | (F.col("first.offset") != F.col("offset"))
    return met.withColumn("first", F.when(other, F.col("first")))


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, most: int = BROADCAST_ROWS) -> None:
    """The ARC files of a folder as WARC files in another.

    HTTP responses become response records, others resource records; all but the first of
    equal payloads of least_bytes become revisits, which keep the HTTP head and refer to the
    first. Identifiers come from archive and place, timestamps from the archive date, and
    digests from the bytes. Archives are read twice, for digests alone and for records.
    """
    first = written(first_of_equals(read_arc(spark, arc_path, with_bytes=False), least_bytes), "first-of-equals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Archives(archive_bytes)
        for b in batches:
            for r in b.to_pylist():
                own, f = record_id(r["archive"], r["offset"]), r["first"]
                if not out.parts:
                    info = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, own + '/info')}"
                    about = b"software: redlake\r\nformat: WARC File Format 1.1\r\n"
                    out.add(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{info}>"), ("WARC-Date", warc_date(r["date"])), ("Content-Type", "application/warc-fields")], about))
                block = r["head"] if f else r["head"] + r["payload"]
                fields = [
                    ("WARC-Type", "revisit" if f else "response" if r["head"] else "resource"),
                    ("WARC-Record-ID", f"<{own}>"),
                    ("WARC-Date", warc_date(r["date"])),
                    ("WARC-Target-URI", r["url"]),
                    ("WARC-IP-Address", r["ip"]),
                    ("WARC-Warcinfo-ID", f"<{info}>"),
                    ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"),
                    ("WARC-Block-Digest", f"sha1:{digest(block)}"),
                    ("WARC-Identified-Payload-Type", r["mime"]),
                    ("Content-Type", "application/http; msgtype=response" if r["head"] else r["mime"]),
                ]
                if f:
                    fields += [
                        ("WARC-Profile", REVISIT_PROFILE),
                        ("WARC-Refers-To", f"<{record_id(f['archive'], f['offset'])}>"),
                        ("WARC-Refers-To-Target-URI", f["url"]),
                        ("WARC-Refers-To-Date", warc_date(f["date"])),
                        (REFERS_FIELD, f["id"]),
                        ("X-Payload-Length", r["payload_bytes"]),
                    ]
                out.add(warc_record(fields, block))
                if out.full():
                    yield out.take()
        if out.parts:
            yield out.take()

    _write(with_first(read_arc(spark, arc_path), first, most).mapInArrow(run, "content binary"), warc_path)


_WARC = "record_id string, record_type string, url string, date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, refers_to long"


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row a record of the WARC files of a folder, warcinfo left out; digests of what is there are checked, a wrong one is an error."""
    kinds = [(c.split()[0], _TYPES[c.split()[1]]) for c in _WARC.split(", ")] + [("payload", pa.binary())] * with_payload

    def one(f: dict[str, str], block: bytes) -> tuple:
        kind = f["warc-type"]
        head, payload = http_parts(block)
        said = f["warc-payload-digest"].removeprefix("sha1:")
        if f["warc-block-digest"] != f"sha1:{digest(block)}" or (kind != "revisit" and digest(payload) != said):
            raise ValueError(f"{f['warc-record-id']}: the digest is wrong")
        id_, refers, n = http_field(head, ID_HEADER), f.get(REFERS_FIELD.lower()), int(f["x-payload-length"]) if kind == "revisit" else len(payload)
        row = (f["warc-record-id"].strip("<>"), kind, f.get("warc-target-uri"), f["warc-date"], None if id_ is None else int(id_), n, said, (f.get("warc-refers-to") or "").strip("<>") or None, None if refers is None else int(refers))
        return (*row, None if kind == "revisit" else payload) if with_payload else row

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(*b.columns, strict=True):
                rows, size = [], 0
                for f, block in parse_warc(content.as_py(), archive.as_py()):
                    if f["warc-type"] == "warcinfo":
                        continue
                    rows.append(one(f, block))
                    size += len(block) if with_payload else 100
                    if size > BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return _files(spark, path).mapInArrow(run, _WARC + ", payload binary" * with_payload)


def archive_pages(pages: DataFrame, least_bytes: int = 0, versions: tuple[int, ...] = (1, 2), archive_bytes: int = ARCHIVE_BYTES, most: int = BROADCAST_ROWS) -> DataFrame:
    """pages (page_id, url, html) through ARC files and WARC files and back: what read_warc gives.

    One row per row: null texts are empty payloads, null ids stay null and come last among
    equals, repeated rows refer to the first of them. No pages give no archives and no rows.
    Other columns are not read. Both kinds of archive are in the shared folder.
    """
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc, versions=versions, archive_bytes=archive_bytes)
    convert(spark, arc, warc, least_bytes, archive_bytes, most)
    return read_warc(spark, warc)


def op13_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 in base 32: eight digits of 20 bits, four letters each.
ORACLE = """
WITH hashed AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
based AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM hashed),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM based)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM firsts
"""
