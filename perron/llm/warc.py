"""Legacy archives to WARC: parse ARC, synthesise WARC records, and read WARC back.

ARC is the older crawl format: a version block, then records of one header line (its fields depend
on the version), a declared number of bytes and a line feed. The converter reads both versions of
the header line, takes the declared lengths at their word (so a payload may hold anything), and
makes up what WARC wants and ARC lacks: record identifiers, ISO timestamps, types and digests.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perron.session import bound_arrow_batches
from perron.staging import stage

#: Bytes of records after which an archive is closed (a larger record is an archive of its own).
ARCHIVE_BYTES = 4 << 20
MIN_REVISIT_BYTES = 100
#: A table of repeated payloads is broadcast only up to this many rows (counted); beyond, it is joined by shuffle.
BROADCAST_ROWS = 50_000

# The field names of the two versions of ARC header lines.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122


@dataclass
class ArcRecord:
    """One record of an ARC file; ``fields`` by the version's names, ``body`` of the declared length."""

    fields: dict[str, str]
    body: bytes
    offset: int


def arc_archive(records: list[tuple[str, str, str, bytes]], name: str = "pages.arc", version: int = 1) -> bytes:
    """An ARC file of (url, content type, 14-digit date, body) records."""
    names = ARC_FIELDS[version]
    block = f"{version} 0 perron\n{' '.join(names)}\n".encode()
    out = bytearray()

    def header(url: str, kind: str, date: str, length: int) -> bytes:
        # No blanks in fields other than as separators; the type goes without parameters.
        url = quote(url or "-", safe="%/:?#[]@!$&'()*+,;=~-._")
        if version == 1:
            parts = [url, "0.0.0.0", date, kind, str(length)]
        else:
            parts = [url, "0.0.0.0", date, kind, "200", "-", "-", str(len(out)), name, str(length)]
        return " ".join(parts).encode() + b"\n"

    out += header(f"filedesc://{name}", "text/plain", records[0][2] if records else "19700101000000", len(block)) + block + b"\n"
    for url, kind, date, body in records:
        out += header(url, kind, date, len(body)) + body + b"\n"
    return bytes(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, its version block included.

    The first block names the version and with it the fields of all header lines. Fields are taken
    from the right, so a URL with blanks stays whole. A header that does not fit, or a length
    beyond the end of the file, is a ValueError that names the offset.
    """
    at, names = 0, ARC_FIELDS[1]
    while at < len(data):
        if data[at : at + 1] == b"\n":  # the line feed after a record
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace")
        if at == 0 and len(line.split(" ")) >= len(ARC_FIELDS[2]):
            names = ARC_FIELDS[2]
        parts = line.rstrip("\r").rsplit(" ", len(names) - 1)
        if end < 0 or len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"no ARC header at byte {at}")
        length = int(parts[-1])
        if end + 1 + length > len(data):
            raise ValueError(f"ARC record at byte {at} ends beyond the file")
        body = data[end + 1 : end + 1 + length]
        if at == 0:
            names = ARC_FIELDS[2] if body[:1] == b"2" else ARC_FIELDS[1]
        yield ArcRecord(dict(zip(names, parts, strict=True)), body, at)
        at = end + 1 + length


def http_parts(body: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields (lower-case names) and the payload of an HTTP response; without one, all is payload."""
    if not body.startswith(b"HTTP/"):
        return {}, body
    head, found, payload = body.partition(b"\r\n\r\n")
    if not found:
        return {}, body
    lines = [x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]]
    return {k.strip().lower(): v.strip() for k, _, v in lines}, payload


def iso_date(date: str) -> str:
    """A 14-digit ARC date as a WARC timestamp; shorter ones are padded, others are the epoch."""
    digits = date if date.isdigit() and 4 <= len(date) <= 14 else "19700101000000"
    padded = digits + "00000101000000"[len(digits) :]
    try:
        return datetime.strptime(padded, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page}/{digest}')}>"


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def arc_to_warc(data: bytes, first_of: Callable[[str, int, str], str | None] = lambda page, size, digest: None) -> bytes:
    """A WARC archive equivalent to an ARC archive.

    The version block becomes a warcinfo record; HTTP responses become response records, anything
    else resource records. Identifiers are derived from page and payload digest, so a conversion
    that is run again gives the same archive. ``first_of(page, payload size, payload digest)`` names
    the page whose payload this one repeats, if any: the record then is a revisit without payload.
    """
    out = bytearray()
    for r in read_arc(data):
        date, url = iso_date(r.fields["Archive-date"]), r.fields["URL"]
        block_digest = hashlib.sha256(r.body).hexdigest()
        if r.offset == 0 and url.startswith("filedesc://"):
            out += warc_record("warcinfo", [("WARC-Record-ID", record_id(url, block_digest)), ("WARC-Date", date), ("WARC-Filename", url[11:]), ("Content-Type", "application/warc-fields")], b"software: perron\r\nformat: WARC File Format 1.1\r\n")
            continue
        head, payload = http_parts(r.body)
        digest, page = hashlib.sha256(payload).hexdigest(), head.get("x-page-id", "")
        fields = [
            ("WARC-Record-ID", record_id(page or url, digest)),
            ("WARC-Date", date),
            ("WARC-Target-URI", url),
            ("WARC-IP-Address", r.fields["IP-address"]),
            ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("X-Payload-Length", str(len(payload))),
        ]
        if page:
            fields.append(("X-Page-Id", page))
        if not head:
            out += warc_record("resource", [*fields, ("Content-Type", r.fields["Content-type"])], r.body)
            continue
        block, kind = r.body, "response"
        first = first_of(page, len(payload), digest)
        if first is not None:
            kind, block = "revisit", r.body[: len(r.body) - len(payload)]
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page-Id", first)]
        fields += [("WARC-Block-Digest", f"sha256:{block_digest if block is r.body else hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http;msgtype=response")]
        out += warc_record(kind, fields, block)
    return bytes(out)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of a WARC archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + n]
        if data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"WARC record at byte {at} doesn't end as declared")
        at = end + 8 + n


def archive_pages(pages: DataFrame, date: str = "20260101000000", version: int = 1, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """WARC archives (one binary column ``warc``) of ``pages(page_id, url, html)``, through ARC.

    Of pages with equal payloads of ``least`` bytes or more the one with the smallest page_id is a
    response and the others are revisits of it; rows that repeat that id are responses too. Null
    html is an empty payload, null url is "-", a null page_id has no part in the comparison (always
    a response). Other columns are ignored; an empty table gives no archives.
    """
    bound_arrow_batches(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    keyed = base.withColumn("_size", F.octet_length("payload")).withColumn("_digest", F.sha2("payload", 256))
    first = (
        keyed.where((F.col("_size") >= least) & F.col("page_id").isNotNull())
        .groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    )
    first = stage(first, "repeated-payloads")
    takes_part = (keyed["_size"] >= least) & keyed["page_id"].isNotNull()
    if first.count() <= BROADCAST_ROWS:
        # A null page_id takes no part, but keeps its row.
        joined = keyed.join(F.broadcast(first), (keyed["_digest"] == first["_digest"]) & takes_part, "left")
    else:
        # A payload may be that of very many pages: only narrow rows meet by digest, pages meet theirs by id.
        narrow = keyed.where(takes_part).select("page_id", "_digest").distinct()
        matched = stage(narrow.join(first, "_digest").where("page_id <> _first").select(F.col("page_id").alias("_id"), F.col("_digest").alias("_same"), "_first"), "revisits")
        joined = keyed.join(matched, (keyed["page_id"] == matched["_id"]) & (keyed["_digest"] == matched["_same"]), "left")
    rows = joined.select("page_id", "url", "payload", F.when(F.col("_first") != F.col("page_id"), F.col("_first")).alias("_first"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def archive(records: list, firsts: dict[str, str]) -> pa.RecordBatch:
            data = arc_to_warc(arc_archive(records, version=version), lambda page, size, digest: firsts.get(page))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["warc"])

        records, firsts, size = [], {}, 0
        for batch in batches:
            ids, urls, payloads, first = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                page, body = ids[i].as_py(), payloads[i].as_py()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n" + (f"X-Page-Id: {page}\r\n" if page is not None else "") + "\r\n"
                key, of = str(page), first[i].as_py()
                if records and (size + len(body) > ARCHIVE_BYTES or key in firsts and firsts[key] != (None if of is None else str(of))):
                    yield archive(records, {k: v for k, v in firsts.items() if v is not None})
                    records, firsts, size = [], {}, 0
                records.append((urls[i].as_py() or "-", "text/html", date, head.encode() + body))
                firsts[key] = None if of is None else str(of)
                size += len(body) + len(head)
        if records:
            yield archive(records, {k: v for k, v in firsts.items() if v is not None})

    return rows.mapInArrow(work, "warc binary")


def archived_records(archives: DataFrame) -> DataFrame:
    """What the response and revisit records of WARC archives say.

    Returns page_id, url, payload_bytes, payload_digest (recomputed from the payload of a response,
    as recorded for a revisit), record_type, refers_to, record_id, warc_date.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                out: list[tuple] = []
                for f, block in read_warc(data.as_py()):
                    kind = f["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    size, digest = int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind != "revisit":
                        payload = http_parts(block)[1]
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    number = lambda k, f=f: int(f[k]) if k in f else None
                    out.append((number("X-Page-Id"), f["WARC-Target-URI"], size, digest, kind, number("X-Refers-To-Page-Id"), f["WARC-Record-ID"], f["WARC-Date"]))
                columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return archives.select("warc").mapInArrow(
        work, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string"
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages into archives, and back."""
    archives = stage(archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")), "archives")
    return archived_records(archives).drop("record_id")
