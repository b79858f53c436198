"""ARC archives to WARC, and back to rows.

ARC files start with a version block; its version says which fields the header line of each
record has, and the last field is the length of what follows. The converter reads by these
declared lengths and makes the equivalent WARC record: identifier, timestamp, type and digests.
Archives are written by Spark's text writer, one archive a row, whose line separator is the end of
its last WARC record, and read as whole files of bounded size, so any store that Spark knows will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histloom.session import scratch_path, written

#: Fields of a record's header line, by version of the archive (fixed by the format).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length".split(),
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
       "Archive-length".split(),
}
RECORD_END = b"\r\n\r\n"
#: An archive ends with the record that brings it to this many bytes before compression, so it is
#: larger by less than one record.
ARCHIVE_BYTES = 16 << 20
ROWS_AT_ONCE = 64
ROWS_PER_BATCH = 4096
#: ARC files made from tables without a date say this.
NO_DATE = "19700101000000"


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    content: bytes

    @property
    def url(self) -> str:
        return self.fields["URL"]


def arc_header(version: int, values: dict[str, str]) -> bytes:
    """A header line; fields that are not given are `-`, and blanks inside fields are escaped."""
    escaped = [re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", values.get(f) or "-") for f in ARC_FIELDS[version]]
    return " ".join(escaped).encode("utf-8", "surrogatepass") + b"\n"


def arc_start(version: int, name: str = "pages.arc") -> bytes:
    """The version block that an archive begins with."""
    block = f"{version} 0 -\n{' '.join(ARC_FIELDS[version])}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": NO_DATE}
    values |= {"Content-type": "text/plain", "Archive-length": str(len(block))}
    return arc_header(version, values) + block + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an archive, the version block first.

    The first header line has the fields of either version; the block then tells the version of
    all others. A line with a wrong number of fields, or a length beyond the end, is an error.
    """
    version, at = 0, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "surrogateescape").rstrip("\r")
        values = line.split(" ")
        known = version or next((v for v, names in ARC_FIELDS.items() if len(names) == len(values)), 0)
        if end < 0 or not known or len(values) != len(ARC_FIELDS[known]) or not values[-1].isdecimal():
            raise ValueError(f"not an ARC header line at byte {at}: {line[:200]!r}")
        stop = end + 1 + int(values[-1])
        if stop > len(data):
            raise ValueError(f"the record at byte {at} is longer than its archive")
        content = data[end + 1 : stop]
        if not version:
            if not values[0].startswith("filedesc:") or not content[:1].isdigit():
                raise ValueError("the archive has no version block")
            version = int(content.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
        yield ArcRecord(version, dict(zip(ARC_FIELDS[known], values)), content)
        at = stop


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """The head of an HTTP message with its blank line, and the payload."""
    head, gap, body = content.partition(RECORD_END)
    return (head + gap, body) if gap else (b"", content)


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*(.*?)\r?$", head)
    return found[1].decode("utf-8", "replace") if found else None


def record_id(name: str | None, digest: str) -> str:
    """The same for the same name and payload, in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}:{digest}')}>"


def warc_type(record: ArcRecord) -> tuple[str, str]:
    """WARC-Type and Content-Type of the record that an ARC record becomes."""
    if record.url.startswith("filedesc:"):
        return "warcinfo", "application/warc-fields"
    if record.url.startswith("dns:"):
        return "resource", "text/dns"
    if record.content.startswith(b"HTTP/"):
        return "response", "application/http; msgtype=response"
    return "resource", record.fields["Content-type"]


def convert(record: ArcRecord, name: str | None = None, revisits: str | None = None) -> bytes:
    """The WARC record, without the blank lines at its end.

    `name` goes into the identifier (else the URL and date do). With `revisits`, the identifier
    of an earlier response with the same payload, a response becomes a revisit of it: it keeps
    the HTTP head, which tells the payload's length, but not the payload.
    """
    kind, media = warc_type(record)
    head, payload = http_parts(record.content) if kind == "response" else (b"", record.content)
    digest = sha1_base32(payload)
    date = record.fields["Archive-date"].ljust(14, "0")
    block = record.content
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(name or f"{record.url} {date}", digest),
        "WARC-Date": f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z",
        "WARC-Target-URI": record.url,
        "WARC-IP-Address": record.fields["IP-address"],
        "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if kind == "response" and revisits:
        block = head
        fields["WARC-Type"] = "revisit"
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = revisits
    if kind == "warcinfo":
        del fields["WARC-Target-URI"]
    fields["WARC-Block-Digest"] = f"sha1:{sha1_base32(block)}"
    fields["Content-Type"] = media
    fields["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v != "-")
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogateescape") + b"\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by their declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(RECORD_END, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"not a WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        fields = dict(line.split(": ", 1) for line in lines)
        start = end + len(RECORD_END)
        stop = start + int(fields["Content-Length"])
        if data[stop : stop + len(RECORD_END)] != RECORD_END:
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield fields, data[start:stop]
        at = stop + len(RECORD_END)


def page_to_arc(page_id: str | None, url: str | None, html: bytes, version: int) -> bytes:
    """An ARC record of a page: an HTTP response that names the page."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if page_id is not None:
        head += f"X-Page-Id: {page_id}\r\n"
    content = f"{head}Content-Length: {len(html)}\r\n\r\n".encode() + html
    values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": NO_DATE, "Content-type": "text/html"}
    values |= {"Result-code": "200", "Checksum": sha1_base32(html), "Filename": "pages.arc"}
    return arc_header(version, values | {"Archive-length": str(len(content))}) + content + b"\n"


def archive_of(pages: list[tuple[str | None, str | None, bytes]], version: int) -> bytes:
    return arc_start(version) + b"".join(page_to_arc(*page, version) for page in pages)


def in_archives(records: Iterator[bytes], archive_bytes: int) -> Iterator[bytes]:
    """Records joined to archives without the end of their last record."""
    part, size = [], 0
    for record in records:
        part.append(record)
        size += len(record) + len(RECORD_END)
        if size >= archive_bytes:
            yield RECORD_END.join(part)
            part, size = [], 0
    if part:
        yield RECORD_END.join(part)


def pages_to_archives(
    pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """`archive`: the WARC records of many pages, made by way of ARC archives of both versions.

    Of pages with the same payload, of at least `min_bytes`, the one with the smallest id is a
    response and the others revisit it. Payloads are compared by SHA-1 and length.
    """
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("_url"), html.alias("_html")
    ).withColumns({"_sha": F.sha1("_html"), "_size": F.length("_html")})
    first = (
        rows.filter(F.col("_size") >= min_bytes)
        .groupBy("_sha", "_size")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    named = rows.join(first, ["_sha", "_size"], "left").select(
        F.col("_id").cast("string").alias("_id"), "_url", "_html",
        F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first").cast("string")).alias("_first"),
    )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        version = 1
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids, urls, html, firsts = (part.column(i).to_pylist() for i in range(4))
                arc = parse_arc(archive_of(list(zip(ids, urls, html)), version))
                next(arc)  # the version block
                for record, name, first in zip(arc, ids, firsts, strict=True):
                    refers = first and record_id(first, sha1_base32(http_parts(record.content)[1]))
                    yield convert(record, str(name), refers)
                version = 3 - version

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for archive in in_archives(records(batches), archive_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["archive"])

    return named.mapInArrow(run, "archive binary")


def write_archives(archives: DataFrame, path: str) -> None:
    """Write each row of `archive` as a gzipped WARC file."""
    (
        archives.select(F.col("archive").cast("string"))
        .write.option("lineSep", RECORD_END.decode())
        .option("compression", "gzip")
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """version, fields and content of the records in ARC files, plain or gzipped."""
    schema = "version int, fields map<string,string>, content binary"
    kinds = pa.schema([("version", pa.int32()), ("fields", pa.map_(pa.string(), pa.string())), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                for r in parse_arc(_plain(content)):
                    row = {"version": r.version, "fields": list(r.fields.items()), "content": r.content}
                    yield pa.RecordBatch.from_pylist([row], schema=kinds)

    return _files(spark, path).mapInArrow(run, schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit in WARC files: record_id, record_type, target_uri, page_id
    (text), payload_bytes, payload_digest, refers_to_id, and valid: whether the payload of a
    response has the length and digest that its headers say."""
    schema = (
        "record_id string, record_type string, target_uri string, page_id string, payload_bytes long, "
        "payload_digest string, refers_to_id string, valid boolean"
    )
    text = ["record_id", "record_type", "target_uri", "page_id", "payload_digest", "refers_to_id"]
    kinds = pa.schema([
        (n.split()[0], pa.string() if n.split()[0] in text else pa.int64() if "long" in n else pa.bool_())
        for n in schema.split(", ")
    ])

    def row(fields: dict[str, str], block: bytes) -> dict:
        head, payload = http_parts(block)
        size = int(http_field(head, "Content-Length") or 0)
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        full = fields["WARC-Type"] == "response"
        return {
            "record_id": fields["WARC-Record-ID"], "record_type": fields["WARC-Type"],
            "target_uri": fields.get("WARC-Target-URI"), "page_id": http_field(head, "X-Page-Id"),
            "payload_bytes": len(payload) if full else size,
            "payload_digest": sha1_base32(payload) if full else digest,
            "refers_to_id": fields.get("WARC-Refers-To"),
            "valid": not full or (len(payload) == size and sha1_base32(payload) == digest),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                found = (row(f, b) for f, b in parse_warc(_plain(content)) if f["WARC-Type"] in ("response", "revisit"))
                while rows := list(islice(found, ROWS_PER_BATCH)):
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return _files(spark, path).mapInArrow(run, schema)


def with_targets(rows: DataFrame, id_type: str | Column = "long") -> DataFrame:
    """Rows of `read_archives` with refers_to: the page of the response that a revisit names."""
    rows = written(rows, "warc-rows").withColumn("page_id", F.col("page_id").cast(id_type))
    targets = (
        rows.filter("record_type = 'response'")
        .groupBy(F.col("record_id").alias("refers_to_id"))
        .agg(F.min("page_id").alias("refers_to"))
    )
    responses = rows.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast(id_type))
    revisits = rows.filter("record_type = 'revisit'").join(targets, "refers_to_id", "left")
    return responses.unionByName(revisits)


def archive_round_trip(
    pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url",
    html_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write pages as WARC files to `path` (by default a new one in the shared folder) and read
    them back: see `read_archives` and `with_targets`.

    A null html is an empty payload; empty payloads are equal to each other. A null url has no
    target; blanks in urls are escaped. A null id is never the smallest unless a payload has no
    other. Rows that repeat id and payload are the same page and get the same type. Extra
    columns are not read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages_to_archives(pages, id_col, url_col, html_col, min_bytes, archive_bytes), path)
    return with_targets(read_archives(spark, path), pages.select(id_col).schema[0].dataType.simpleString())
