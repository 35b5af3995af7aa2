"""WARC archives: a writer, and a reader that salvages damaged archives.

Writing is one Spark job without Python: a record is a string, and the text
writer puts the two line ends that close a record behind each of them.
Archives are bounded in size, so that one fits a task.  The reader checks every
record and, after a failed check, goes on at the next valid gzip member or
version line; what lies between is logged as a gap."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.llm.common import require, shared_path, small_batches, stage

ARCHIVE_BYTES = 8 << 20
CRLF = "\r\n"
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD_SCHEMA = ("kind string, archive string, offset long, length long, reason string, record_id string, "
                 "record_type string, refers_to string, target_uri string, payload_bytes long, payload_digest string, "
                 "payload binary")


def sha1_base32(value: Column) -> Column:
    """Upper-case base32 SHA-1: each 20 bits of the digest are four digits."""
    hexed = F.sha1(value)
    digits = F.concat(*[F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", compression: str = "none") -> None:
    """Writes a record per row below ``path``.

    Of rows with equal payloads of at least ``min_revisit_bytes``, those with
    the largest id are responses and the others revisits that name it; null ids
    are smaller than any other, and rows of null ids only are responses.  A
    null payload is empty, a null url is left out; repeated rows are a record
    each, an empty table writes no record.  Only the digests of repeated
    payloads are joined back, so the payloads are not shuffled while that table
    is small enough for Spark to broadcast."""
    require(pages, id_col, url_col, payload_col)
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    sized = rows.select("id", sha1_base32(F.col("body")).alias("digest"), F.octet_length("body").alias("n"))
    grouped = stage(sized.groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("copies"),
                                                F.any_value("n").cast("long").alias("n")), "payloads")
    totals = grouped.agg(F.sum(F.col("n") * F.col("copies")).alias("b"), F.sum("copies").alias("c")).first()
    count, total = totals["c"] or 0, totals["b"] or 0
    per_file = max(1, int(ARCHIVE_BYTES * count // (total + 700 * count))) if count else 1
    repeated = stage(grouped.filter(f"copies > 1 and n >= {int(min_revisit_bytes)}").select(
        F.col("digest").alias("_digest"), F.col("first").alias("_first")), "repeated")
    keyed = rows.withColumn("digest", sha1_base32(F.col("body")))
    j = keyed.join(repeated, keyed["digest"] == repeated["_digest"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("id").eqNullSafe(F.col("_first"))

    def urn(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value, F.lit(CRLF))

    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF), line("Content-Type", F.lit("text/html; charset=utf-8")),
                    line("Content-Length", F.octet_length("body").cast("string")), F.lit(CRLF))
    blocks = j.withColumn("_revisit", revisit).withColumn(
        "block", F.concat(http, F.when(F.col("_revisit"), F.lit("")).otherwise(F.col("body"))))
    none = F.lit("")
    head = F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", F.when(F.col("_revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("id")), line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNull(), none).otherwise(line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]+", " "))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), sha1_base32(F.col("block")))),
        F.when(F.col("_revisit"), F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", urn("_first"))))
        .otherwise(none),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")), F.lit(CRLF))
    blocks.select(F.concat(head, F.col("block")).alias("value")).write.option("lineSep", CRLF * 2).option(
        "maxRecordsPerFile", per_file).option("compression", compression).text(path)


_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_URN = re.compile(r"<urn:page:(.*)>")


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for row in raw.decode("utf-8", "replace").split(CRLF)[1:]:
        name, colon, value = row.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _record_at(data: bytes, at: int) -> tuple[str, int, dict[str, str], bytes]:
    """What is wrong with the record at ``at`` (empty if nothing), where it
    ends (0 if that can't be told), its headers and its block."""
    if not _VERSION_LINE.match(data, at):
        return "no version line", 0, {}, b""
    split = data.find(b"\r\n\r\n", at)
    if split < 0 or _VERSION_LINE.search(data, at + 1, split):
        return "headers cut off", 0, {}, b""
    head = _headers(data[at:split])
    if not head.get("content-length", "").isdigit():
        return "no length", 0, head, b""
    start = split + 4
    end = start + int(head["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        return "length does not fit", 0, head, b""
    block = data[start:end]
    said = head.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] == _digest(block):
        return "", end + 4, head, block
    if end + 4 < len(data) and not _VERSION_LINE.match(data, end + 4):
        return "length does not fit", 0, head, b""
    if said.startswith("sha1:"):
        return "digest differs", end + 4, head, b""
    return "", end + 4, head, block


def records(data: bytes) -> Iterator[tuple[int, int, str, dict[str, str], bytes]]:
    """(offset, length, reason, headers, block) of an uncompressed archive; a
    row with a reason is a quarantined gap.  Offsets and lengths cover all of
    ``data`` without overlap."""
    at = 0
    while at < len(data):
        wrong, end, head, block = _record_at(data, at)
        if not wrong:
            yield at, end - at, "", head, block
            at = end
            continue
        if not end:  # the next version line that begins a valid record
            nxt = at
            while True:
                m = _VERSION_LINE.search(data, nxt + 1)
                if not m:
                    end = len(data)
                    break
                nxt = m.start()
                bad, stop, _, _ = _record_at(data, nxt)
                if not bad or stop:
                    end = nxt
                    break
        yield at, end - at, wrong, {}, b""
        at = end


#: Bytes of a compressed archive that are inflated at a time.
_FEED = 1 << 16


def _until_damage(d, block: memoryview) -> Iterator[bytes]:
    """What a damaged block inflates to before the damage."""
    try:
        for at in range(len(block)):
            yield d.decompress(block[at:at + 1])
    except zlib.error:
        return


def members(data: bytes) -> Iterator[tuple[int, int, str, bytes]]:
    """(offset, length, reason, content) of the gzip members of ``data``.  A
    member that is damaged or cut off has a reason, and the content that did
    inflate; it ends where the next valid member begins.  Every member is fed
    in blocks of its own bytes, so the work grows with the archive."""
    view, at = memoryview(data), 0
    while at < len(data):
        d, out, pos, wrong = zlib.decompressobj(31), [], at, ""
        while pos < len(data) and not d.eof and not wrong:
            before = d.copy()
            try:
                out.append(d.decompress(view[pos:pos + _FEED]))
                pos += _FEED
            except zlib.error:
                wrong = "member does not inflate"
                out += _until_damage(before, view[pos:pos + _FEED])
        if not wrong and d.eof:
            end = min(pos, len(data)) - len(d.unused_data)
            yield at, end - at, "", b"".join(out)
            at = end
            continue
        end = at
        while True:
            end = data.find(b"\x1f\x8b\x08", end + 1)
            if end < 0:
                end = len(data)
                break
            try:
                probe = zlib.decompressobj(31)
                probe.decompress(view[end:end + _FEED])
                break
            except zlib.error:
                continue
        yield at, end - at, wrong or "member cut off", b"".join(out)
        at = end


def salvage(data: bytes) -> Iterator[tuple[int, int, str, dict[str, str], bytes]]:
    """:func:`records` of a plain or compressed archive.  In a compressed one,
    records that share a member share its place.  Of a damaged member the
    records that inflated whole and whose digest holds are kept, and the member
    is a gap as well."""
    if b"\x1f\x8b\x08" != data[:3] and (_VERSION_LINE.search(data) or b"\x1f\x8b\x08" not in data):
        yield from records(data)
        return
    for at, size, wrong, content in members(data):
        for _, _, bad, head, block in records(content):
            if not wrong:
                yield at, size, bad, head, block
            elif not bad and head.get("warc-block-digest", "").startswith("sha1:"):
                yield at, size, "", head, block
        if wrong:
            yield at, size, wrong, {}, b""


def _payload(head: dict[str, str], block: bytes) -> tuple[int | None, str | None, bytes | None]:
    """Size, digest and bytes of a record's full payload; a revisit holds its
    payload's size and digest only."""
    top, _, body = block.partition(b"\r\n\r\n")
    if head.get("warc-type") == "revisit":
        size = _headers(top).get("content-length", "")
        return int(size) if size.isdigit() else None, head.get("warc-payload-digest", "").removeprefix("sha1:"), None
    return len(body), _digest(body), body


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``path`` (RECORD_SCHEMA): ``kind``
    is record or gap, a gap has its ``reason``.  Every byte of an archive is in
    a record or in a gap; a damaged gzip member is a gap, and the records that
    could be read from it come beside it.  A record whose payload digest differs is a gap.  A
    task reads one archive at a time; an empty folder gives no rows."""
    small_batches(spark)
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(),
             pa.string(), pa.int64(), pa.string(), pa.binary()]

    def rows_of(archive: str, data: bytes) -> Iterator[tuple]:
        for at, size, wrong, head, block in salvage(data):
            if not wrong:
                n, digest, body = _payload(head, block)
                said = head.get("warc-payload-digest", "").removeprefix("sha1:")
                wrong = "payload digest differs" if said and digest != said else ""
            if wrong:
                yield ("gap", archive, at, size, wrong, *[None] * 7)
                continue
            yield ("record", archive, at, size, None, _name(head.get("warc-record-id")), head.get("warc-type"),
                   _name(head.get("warc-refers-to")), head.get("warc-target-uri"), n, digest,
                   body if with_payload else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1)):
                held: list[tuple] = []
                for row in rows_of(archive.as_py(), content.as_py() or b""):
                    held.append(row)
                    if len(held) == 256:
                        yield _batch(held, names, kinds)
                        held = []
                yield _batch(held, names, kinds)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD_SCHEMA)


def _name(urn: str | None) -> str | None:
    m = _URN.fullmatch(urn or "")
    return (m[1] or None) if m else urn


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def round_trip(pages: DataFrame, with_payload: bool = False, **options) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, **options)
    return read_archives(spark, path, with_payload)
