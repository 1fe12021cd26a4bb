"""Web archives: legacy ARC files in both versions are converted to WARC, and both are written and read as tables.

An archive is written as one row of text, so that Spark's own writer makes the file (whatever store the shared folder is in); records never lie in two files. Archives are read
whole, one at a time, and cut by the lengths that their records declare: a payload may hold anything that looks like a header.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_cut, drop_path, new_path

#: Payloads of fewer bytes are stored again instead of revisited.
REVISIT_BYTES = 1000
#: An archive is closed when it has so many bytes; one record more may be in it.
ARCHIVE_BYTES = 16 << 20
CAPTURED = "20240131000000"
# fixed values: the header lines of both ARC versions, in the formats' order
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
# fixed values: names of the WARC format
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
#: A header of ours within the HTTP block: the row's id, which neither format has a field for.
ID_HEADER = "X-Page-Id"
GZIP = b"\x1f\x8b"


class BadArchive(ValueError):
    """A record whose header line or declared length can't be read; it names the archive and the place."""


@dataclass
class ArcRecord:
    offset: int
    fields: dict[str, str]
    block: bytes
    opens: bool  # the version block


def _plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == GZIP else data


def _line(data: bytes, at: int) -> tuple[bytes, int]:
    end = data.find(b"\n", at)
    return (data[at:], len(data)) if end < 0 else (data[at:end].rstrip(b"\r"), end + 1)


def arc_records(data: bytes, name: str = "") -> Iterator[ArcRecord]:
    """The records of an ARC file, whichever version its first record declares; that record (filedesc:) is the first one given.

    The version line names the fields of all header lines; without names those of its version hold. A URL with blanks takes what is left over. Blank lines between
    records are skipped. A last record that is shorter than declared is given as far as it goes.
    """
    data, at, names = _plain(data), 0, ARC_FIELDS[1].split(" ")
    while at < len(data):
        begun = at
        line, at = _line(data, at)
        if not line:
            continue
        opens = begun == 0 and line.startswith(b"filedesc:")
        if opens:
            version = re.match(rb"(\d+) ", data[at : at + 16])
            if not version or int(version[1]) not in ARC_FIELDS:
                raise BadArchive(f"{name}: version at {begun}")
            names, parts = ARC_FIELDS[int(version[1])].split(" "), line.decode("utf-8", "surrogateescape").split(" ")
            block = data[at : at + int(parts[-1])] if parts[-1].isdigit() else b""
            declared = block.split(b"\n")[1:2]
            if declared and declared[0].startswith(b"URL "):
                names = declared[0].decode().rstrip("\r").split(" ")
        parts = line.decode("utf-8", "surrogateescape").rsplit(" ", len(names) - 1)
        if len(parts) < len(names) or not parts[-1].isdigit():
            raise BadArchive(f"{name}: header line at {begun}")
        size = int(parts[-1])
        yield ArcRecord(begun, dict(zip(names, parts)), data[at : at + size], opens)
        at += size


def warc_records(data: bytes, name: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of a WARC file."""
    data, at = _plain(data), 0
    while at < len(data):
        line, begun = _line(data, at)
        if not line:
            at = begun
            continue
        end = data.find(b"\r\n\r\n", at)
        if not line.startswith(b"WARC/") or end < 0:
            raise BadArchive(f"{name}: record at {at}")
        pairs = (x.partition(":") for x in data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:])
        fields = {k.strip().lower(): v.strip() for k, _, v in pairs}
        if not fields.get("content-length", "").isdigit():
            raise BadArchive(f"{name}: length at {at}")
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(header with its blank line, payload) of an HTTP response; a header that doesn't end has no payload."""
    found = re.search(rb"\r?\n\r?\n", block)
    return (block[: found.end()], block[found.end() :]) if found else (block, b"")


def http_field(header: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^%s:[ \t]*([^\r\n]*)" % re.escape(name.encode()), header)
    return found[1].strip().decode("utf-8", "replace") if found else None


def is_http(block: bytes) -> bool:
    return block.startswith(b"HTTP/")


def warc_date(archive_date: str) -> str:
    """An ARC date of up to 14 digits as an ISO instant; what is missing is the earliest."""
    digits = (re.sub(r"\D", "", archive_date) + "00000101000000"[min(len(re.sub(r"\D", "", archive_date)), 14) :])[:14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}Z"


def record_id(archive: str, offset: int) -> str:
    """A record's identifier: the same for the same place of the same archive, so that passes and lost tasks agree."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{archive}:{offset}'.encode()).digest()[:16], version=5)}"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def _warc(kind: str, identifier: str, date: str, content_type: str, block: bytes, **more: str | None) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{identifier}>", "WARC-Date": date} | {k.replace("_", "-"): v for k, v in more.items() if v is not None}
    lines = [f"{k}: {v}" for k, v in (fields | {"WARC-Block-Digest": _digest(block), "Content-Type": content_type, "Content-Length": str(len(block))}).items()]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode("utf-8", "surrogateescape") + block


def converted(arc: ArcRecord, archive: str, revisits: dict | None) -> bytes:
    """The WARC record of an ARC record: the version block becomes a warcinfo, an HTTP response a response or, given what it repeats, a revisit without its payload, all else a resource."""
    identifier, date, uri = record_id(archive, arc.offset), warc_date(arc.fields["Archive-date"]), arc.fields["URL"]
    if arc.opens:
        return _warc("warcinfo", identifier, date, "application/warc-fields", f"software: tidemark\r\nformat: WARC File Format 1.1\r\ndescription: from {uri}\r\n".encode(), WARC_Filename=uri.removeprefix("filedesc://"))
    more = {"WARC_Target_URI": uri, "WARC_IP_Address": ip if (ip := arc.fields["IP-address"]) not in ("0.0.0.0", "-", "") else None}
    if not is_http(arc.block):
        return _warc("resource", identifier, date, arc.fields["Content-type"], arc.block, **more, WARC_Payload_Digest=_digest(arc.block))
    header, payload = split_http(arc.block)
    more["WARC_Payload_Digest"] = _digest(payload)
    if not revisits:
        return _warc("response", identifier, date, HTTP_TYPE, arc.block, **more)
    refers = {"WARC_Profile": REVISIT_PROFILE, "WARC_Refers_To": f"<{revisits['record_id']}>", "WARC_Refers_To_Target_URI": revisits["uri"], "WARC_Refers_To_Date": revisits["date"], "WARC_Truncated": "length"}
    return _warc("revisit", identifier, date, HTTP_TYPE, header, **more, **refers)


def _write(rows: DataFrame, separator: str, label: str) -> str:
    """Write rows(content), an archive each, to a new folder: `separator` stands after the last record, as between records."""
    path = new_path(rows.sparkSession, label)
    rows.select(F.col("content").cast("string")).write.options(lineSep=separator, compression="gzip", maxRecordsPerFile=1).text(path)
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of the files of a folder."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def _packed(records: Iterable[bytes], separator: bytes, first, most: int) -> Iterator[pa.RecordBatch]:
    """Archives of about `most` bytes from records; first(k) is the record that opens the k-th one."""
    held, size, k = [], 0, 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array([separator.join(held)], pa.binary())], ["content"])
    for record in records:
        if not held:
            held, k = [first(k)], k + 1
        held.append(record)
        size += len(record)
        if size >= most:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def write_arc(pages: DataFrame, captured: str = CAPTURED, most: int = ARCHIVE_BYTES, versions: tuple[int, ...] = (1, 2)) -> str:
    """Legacy archives of pages(id, url, html), versions taking turns; gives their folder. Null html is an empty payload, a null url is -, blanks in urls are escaped."""

    def version_block(version: int, name: str) -> bytes:
        body = f"{version} 0 tidemark\n{ARC_FIELDS[version]}\n".encode()
        middle = "" if version == 1 else f" 200 - - 0 {name}"
        return f"filedesc://{name} 0.0.0.0 {captured} text/plain{middle} {len(body)}\n".encode() + body

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, version = lambda k: f"pages-{part:06d}-{k:04d}.arc", lambda k: versions[(part + k) % len(versions)]
        first = lambda k: version_block(version(k), name(k))

        def records() -> Iterator[tuple]:
            for batch in batches:
                for number, url, html in zip(*(batch.column(c) for c in ("id", "url", "html"))):
                    number, payload = number.as_py(), (html.as_py() or "").encode()
                    header = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
                    header += [] if number is None else [f"{ID_HEADER}: {number}".encode()]
                    yield re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url.as_py() or "-"), b"\r\n".join([*header, b"", b""]) + payload

        def lines() -> Iterator[bytes]:
            # the header line depends on the archive's version: the record after the one that fills an archive opens the next one
            size, k = 0, 0
            for url, block in records():
                if size >= most:
                    size, k = 0, k + 1
                checksum = hashlib.sha1(block).hexdigest()
                middle = "" if version(k) == 1 else f" 200 {checksum} - {size} {name(k)}"
                record = f"{url} 0.0.0.0 {captured} text/html{middle} {len(block)}\n".encode() + block
                size += len(record)
                yield record

        return _packed(lines(), b"\n", first, most)

    return _write(pages.mapInArrow(build, "content binary"), "\n", "arc")


ARC_ROWS = "archive string, offset long, record_id string, uri string, date string, payload_digest string, payload_bytes long, page_id string"


def arc_rows(archives: DataFrame) -> DataFrame:
    """What the conversion decides on, a row for each HTTP response of archives(archive, content): no payloads, only their digests and lengths."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("archive"), batch.column("content")):
                archive, rows = archive.as_py(), []
                for r in arc_records(content.as_py(), archive):
                    if is_http(r.block):
                        header, payload = split_http(r.block)
                        rows.append((archive, r.offset, record_id(archive, r.offset), r.fields["URL"], warc_date(r.fields["Archive-date"]), _digest(payload), len(payload), http_field(header, ID_HEADER)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k in (1, 6) else pa.string()) for k, c in enumerate(zip(*rows))], [c.split()[0] for c in ARC_ROWS.split(", ")])

    return archives.mapInArrow(parse, ARC_ROWS)


def repeated(rows: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(archive, offset, refers): the rows that revisit another one. Of equal payloads of `least` bytes or more that with the largest page_id stays (missing ones and those
    that are no numbers are smallest, of equal ids the largest record_id)."""
    number = F.expr("try_cast(page_id as decimal(38,0))")
    long = rows.where(F.col("payload_bytes") >= least)
    kept = long.groupBy("payload_digest").agg(F.max(F.struct(number.alias("number"), "record_id", "uri", "date")).alias("refers"), F.count("*").alias("copies")).where("copies > 1")
    # one row for each digest, written: a digest with many copies makes a skewed join, and adaptive execution splits its left side where the right one is a table
    kept = cut(kept, "kept")
    found = long.join(kept.select("payload_digest", "refers"), "payload_digest").where("record_id <> refers.record_id")
    return found.select("archive", "offset", F.struct("refers.record_id", "refers.uri", "refers.date").alias("refers"))


def write_warc(archives: DataFrame, revisits: DataFrame, most: int = ARCHIVE_BYTES) -> str:
    """Convert archives(archive, content), revisits as `repeated` gives them, and give the folder. Decisions are gathered for each archive, as many as it has records,
    so it is the archives as they are stored that meet them, not their records."""
    decided = revisits.groupBy("archive").agg(F.collect_list(F.struct("offset", "refers")).alias("revisits"))

    def convert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def first(k: int) -> bytes:
            name = f"pages-{part:06d}-{k:04d}.warc"
            return _warc("warcinfo", record_id(name, 0), warc_date(CAPTURED), "application/warc-fields", b"software: tidemark\r\nformat: WARC File Format 1.1\r\n", WARC_Filename=name)

        def records() -> Iterator[bytes]:
            for batch in batches:
                for archive, content, decisions in zip(*(batch.column(c) for c in ("archive", "content", "revisits"))):
                    archive = archive.as_py()
                    refers = {d["offset"]: d["refers"] for d in decisions.as_py() or ()}
                    for r in arc_records(content.as_py(), archive):
                        yield converted(r, archive, refers.get(r.offset))

        return _packed(records(), b"\r\n\r\n", first, most)

    return _write(archives.join(decided, "archive", "left").mapInArrow(convert, "content binary"), "\r\n\r\n", "warc")


WARC_ROWS = "archive string, record_id string, record_type string, uri string, date string, payload_digest string, payload_bytes long, page_id string, refers_to_id string, intact boolean"


def warc_rows(archives: DataFrame) -> DataFrame:
    """A row for each response, resource and revisit of archives(archive, content). A revisit's length is what its HTTP header declares; `intact` says that the payload (of a revisit the block) has its digest."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("archive"), batch.column("content")):
                archive, rows = archive.as_py(), []
                for fields, block in warc_records(content.as_py(), archive):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    header, payload = split_http(block) if is_http(block) else (b"", block)
                    declared = http_field(header, "Content-Length") or ""
                    digest = fields.get("warc-payload-digest") or _digest(payload)
                    intact = _digest(block) == fields.get("warc-block-digest", _digest(block)) if kind == "revisit" else _digest(payload) == digest
                    size = len(payload) if kind != "revisit" else int(declared) if declared.isdigit() else None
                    plain = lambda k: (fields.get(k) or "").strip("<>") or None
                    rows.append((archive, plain("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), _hex(digest), size, http_field(header, ID_HEADER), plain("warc-refers-to"), intact))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, {6: pa.int64(), 9: pa.bool_()}.get(k, pa.string())) for k, c in enumerate(zip(*rows))], [c.split()[0] for c in WARC_ROWS.split(", ")])

    return archives.mapInArrow(parse, WARC_ROWS)


def resolved(rows: DataFrame) -> DataFrame:
    """warc_rows with `refers_to`, the page_id of the response that a revisit refers to; null where that is not there, or has another digest."""
    targets = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("_digest"))
    both = rows.where("record_type = 'revisit'").join(targets, "refers_to_id", "left")
    return rows.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("string")).unionByName(both.withColumn("refers_to", F.when(F.col("_digest") == F.col("payload_digest"), F.col("refers_to"))).drop("_digest"))


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", most: int = ARCHIVE_BYTES) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to, record_id, date, intact): pages written as ARC files of both versions, these converted to WARC, and the WARC files read back.

    Null html is an empty payload, a null url is written as -, a null key has none and comes back as null; rows with one key are records of their own, of equal payloads
    one of them stays; empty tables give no rows; other columns, whatever their names, are not read. A page of any length is one record of one archive (a file holds 2 GB at most).
    """
    spark, kind = pages.sparkSession, pages.schema[key].dataType.simpleString()
    arc = write_arc(pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("html")), most=most)
    found = cut(arc_rows(read_archives(spark, arc)), "found")
    revisits = cut(repeated(found), "revisits")
    drop_cut(found)
    warc = write_warc(read_archives(spark, arc), revisits, most)
    drop_path(spark, arc)
    drop_cut(revisits)
    read = cut(warc_rows(read_archives(spark, warc)), "records")
    drop_path(spark, warc)
    return resolved(read).select(F.col("page_id").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "record_id", "date", "intact")
