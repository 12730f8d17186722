"""WARC: a legacy archive (ARC) converter, a writer of deduplicated WARC files and their reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luminode.llm.common import new_path, stored

# Field names of the two ARC versions' header lines, as their version blocks declare them.
ARC_FIELDS = {
    "1": ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    "2": ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
#: Records are written in groups of about so many bytes, so many groups to a file: a reader holds
#: no more at once, unless single records are larger.
GROUP_BYTES, GROUPS_PER_FILE = 4_000_000, 8
#: A header line, after whatever could not be read.
_HEADER = re.compile(rb"\n([A-Za-z][A-Za-z0-9+.-]*:\S[^\n]* \d{8,14} [^\n]* \d+\n)")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_message(payload: bytes, media: str, status: str = "200 OK") -> bytes:
    """What a server sends: a status line, fields, a blank line, the payload."""
    return f"HTTP/1.1 {status}\r\nContent-Type: {media}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def http_payload(block: bytes) -> int | None:
    """Where the payload of an HTTP message begins, whatever line ends its head has; None where there is no head."""
    if not block.startswith(b"HTTP/"):
        return None
    ends = [k + len(gap) for gap in (b"\r\n\r\n", b"\n\n") if (k := block.find(gap)) >= 0]
    return min(ends, default=len(block))


def arc_archive(records: list[tuple[str, str, bytes]], version: str = "1", date: str = "19970101000000") -> bytes:
    """An ARC file of (url, media type, body): a version block, then header lines with lengths."""
    fields = " ".join(ARC_FIELDS[version])
    block = f"{version} 0 legacy\n{fields}\n".encode()
    out = [f"filedesc://legacy.arc 0.0.0.0 {date} text/plain ".encode() + (b"" if version == "1" else b"200 - - 0 legacy.arc ") + f"{len(block)}\n".encode(), block, b"\n"]
    for url, media, body in records:
        more = "" if version == "1" else "200 - - 0 legacy.arc "
        out += [f"{url} 0.0.0.0 {date} {media} {more}{len(body)}\n".encode(), body, b"\n"]
    return b"".join(out)


def arc_date(digits: str) -> str:
    """An ARC date of 8 to 14 digits as a WARC one; what is not told is zero."""
    if not 8 <= len(digits) <= 14:
        raise ValueError(f"ARC date {digits!r}")
    return datetime.strptime(digits.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def read_arc(archive: bytes) -> Iterator[dict]:
    """The records of an ARC file after its version block: fields by name, offset, body; or offset and error.

    The version block's second line names the fields of all later header lines; the declared
    length, the last field, tells where a record ends, whatever its body holds. An address may
    hold blanks: the other fields are read from the right. After a record that cannot be read the
    next line that looks like a header goes on; a file without a known version block is one error.
    """
    at, names = 0, None
    while at < len(archive):
        if archive[at : at + 1] == b"\n":
            at += 1
            continue
        end = archive.find(b"\n", at)
        line = archive[at : end if end >= 0 else len(archive)].decode("utf-8", "replace").rstrip("\r")
        try:
            values = line.rsplit(" ", (len(names) if names else 2) - 1)
            if end < 0 or not values[-1].isdigit() or names and len(values) != len(names):
                raise ValueError(f"no ARC header line: {line[:80]!r}")
            length = int(values[-1])
            body = archive[end + 1 : end + 1 + length]
            if len(body) != length:
                raise ValueError(f"ARC record declares {length} bytes, {len(body)} are there")
            if names is None:
                version, _, fields = body.decode("utf-8", "replace").partition("\n")
                found = tuple(fields.split("\n")[0].split(" "))
                if ARC_FIELDS.get(version.split(" ")[0]) != found:
                    yield {"offset": at, "error": f"unknown ARC version block {version[:80]!r}"}
                    return
                names = found
            else:
                record = dict(zip(names, values)) | {"offset": at, "body": body}
                record["date"] = arc_date(record["Archive-date"])
                yield record
            at = end + 1 + length
        except ValueError as error:
            yield {"offset": at, "error": str(error)}
            later = _HEADER.search(archive, at)
            if names is None or not later:
                return
            at = later.start(1)


def warc_headers(arc: dict, identity: str) -> dict:
    """WARC fields equivalent to an ARC record's; the identifier is a name-based UUID of identity.

    A record with an HTTP head is a response, and its payload follows the head; any other (dns:
    answers, files) is a resource of its own media type, and its payload is the whole body.
    """
    start = http_payload(arc["body"])
    return {
        "WARC-Type": "resource" if start is None else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, identity)}>",
        "WARC-Date": arc["date"],
        "WARC-Target-URI": arc["URL"].replace(" ", "%20"),
        "WARC-IP-Address": arc["IP-address"],
        "WARC-Payload-Digest": f"sha1:{payload_digest(arc['body'][start or 0 :])}",
        "Content-Type": arc["Content-type"] if start is None else "application/http;msgtype=response",
    }


def warc_record(headers: dict, body: bytes) -> bytes:
    """A record without its closing blank lines; a revisit keeps the HTTP head only."""
    block = body[: http_payload(body)] if headers["WARC-Type"] == "revisit" else body
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def read_warc(archive: bytes) -> Iterator[tuple[dict, dict, bytes]]:
    """WARC fields, HTTP fields and payload of each record, by declared lengths; digests are checked."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        length = int(fields["Content-Length"])
        block = archive[end + 4 : end + 4 + length]
        at = end + 4 + length
        if len(block) != length or archive[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"WARC record ends wrongly at byte {at}")
        at += 4
        start = http_payload(block) or 0
        payload = block[start:]
        http = dict(line.split(": ", 1) for line in block[:start].decode("utf-8", "replace").splitlines()[1:] if ": " in line)
        if fields["WARC-Type"] != "revisit" and fields["WARC-Payload-Digest"] != f"sha1:{payload_digest(payload)}":
            raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
        yield fields, http, payload


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file; other bytes as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out) + data


def line_field(text: str | None) -> str:
    """A header value: no line breaks."""
    return " ".join((text or "unknown:").split()) or "unknown:"


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, arc_version: str = "1") -> None:
    """Packs pages as a legacy archive per batch, converts it and writes gzip WARC files below path.

    Of pages with equal payloads of at least min_bytes bytes, the one with the largest id is
    written as response and the others as revisits of it; equal ids are all responses, and so
    are null ids. A null payload is empty; a null or blank address becomes `unknown:`.
    """
    body = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= min_bytes)
    # one row for each payload held more than once; its size on disk decides how Spark joins it
    kept = stored(large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper"), "payloads")
    joined = rows.join(kept, "digest", "left").select("page_id", "url", "payload", F.when(F.octet_length("payload") >= min_bytes, F.col("keeper")).alias("keeper"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                ids, urls, payloads, keepers = (c.to_pylist() for c in batch.slice(start, 256).columns)
                archive = arc_archive([(line_field(u), "text/html", http_message(p, "text/html")) for u, p in zip(urls, payloads)], arc_version)
                groups, size = [[]], 0
                for i, keeper, arc in zip(ids, keepers, read_arc(archive)):
                    fields = warc_headers(arc, f"page:{i}")
                    if i is not None:
                        fields["X-Page-ID"] = i
                    if None not in (i, keeper) and i < keeper:
                        fields |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{keeper}')}>", "X-Refers-To-Page-ID": keeper}
                    record = warc_record(fields, arc["body"])
                    if size + len(record) > GROUP_BYTES and groups[-1]:
                        groups.append([])
                        size = 0
                    groups[-1].append(record)
                    size += len(record)
                yield pa.RecordBatch.from_arrays([pa.array([RECORD_END.encode().join(g) for g in groups], pa.binary())], ["value"])

    records = joined.mapInArrow(convert, "value binary").select(F.col("value").cast("string").alias("value"))
    # Spark's line sink writes the bytes of each group of records and the blank lines that close it
    records.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", GROUPS_PER_FILE).text(path)


def load_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files below path: page_id, url, type, bytes and digest of the full payload, page that a revisit refers to."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    names = [n for n, _ in fields]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for content in batch.column(0):
                rows = [
                    (number(w.get("X-Page-ID")), w["WARC-Target-URI"], int(h["Content-Length"]), w["WARC-Payload-Digest"].removeprefix("sha1:"), w["WARC-Type"], number(w.get("X-Refers-To-Page-ID")))
                    for w, h, _ in read_warc(gunzip(content.as_py()))
                ]
                columns = zip(*rows) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, fields)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def convert_arc(spark: SparkSession, path: str) -> DataFrame:
    """Reads ARC files (gzip or plain): (path, offset, record, error), a row per record.

    record holds the bytes of the equivalent WARC record; a record that cannot be read has an
    error instead. An empty file has no rows.
    """
    names = ["path", "offset", "record", "error"]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = [(r["offset"], None, r["error"]) if "error" in r else (r["offset"], warc_record(warc_headers(r, f"{name}#{r['offset']}"), r["body"]), None) for r in read_arc(gunzip(content.as_py()))]
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(out), pa.string()), *[pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.string()))]], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(convert, "path string, offset long, record binary, error string")


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Writes pages to WARC files in the shared folder and reads those files back."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return load_warc(pages.sparkSession, path)
