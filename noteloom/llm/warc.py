"""WARC archives: written whole, normalised to one gzip member per record, and indexed.

A monolithic archive is a single gzip stream, which can only be read from its start. The
normaliser inflates such a stream once, as Spark's text reader hands it over in pieces, finds
the records by their declared lengths, and writes each as a gzip member of its own. Every
member carries its offset in the header's extra field, so that the sidecar index can be taken
from the archive itself, in parallel and in any order.

All files are read and written by Spark, so archives can lie in any store that Spark reaches:

* The writer's line separator is the empty line that ends a WARC record, so each row is a record.
* The reader of monolithic archives splits at the same separator. The pieces of a file come in
  order in one task, as gzip cannot be split, and joined again they are the stream.
* Members are written with an empty gzip member as separator, which readers of multi-member gzip
  skip. A file is then split between any two members, and a row is exactly one member.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.common import shared_path, stored

RECORD_END = "\r\n\r\n"
#: Fixed value: a gzip member without content.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_EXTRA = struct.Struct("<2sHQ")
_MEMBER_TEXT = {"lineSep": EMPTY_MEMBER.decode("latin-1"), "encoding": "ISO-8859-1"}
_BASE32HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
    "archive string, offset bigint, length bigint")


def base32_of_hex(digest: Column) -> Column:
    """Bare upper-case base32 of a 40-digit hexadecimal number, 60 bits at a time."""
    parts = [
        F.lpad(F.conv(F.substring(digest, start, digits), 16, 32), digits * 4 // 5, "0")
        for start, digits in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*parts), _BASE32HEX, _BASE32)


def _urn(page_id: Column, digest: Column) -> Column:
    """A record id that follows from the page and its payload."""
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def records(pages: DataFrame, least_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Each page as the text of a WARC record without its closing empty line (column ``value``).

    Of the pages with equal payloads of at least ``least_revisit_bytes``, those with the smallest
    page_id are responses and the others revisit it. A null payload is empty. Pages without an
    id come after all others, and are responses if none of the equal ones has an id. A row that
    repeats the smallest id is a response like the first. A null url has no header line.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).select(
        "*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    # Written first, so that a join on a payload with very many copies can be split.
    firsts = stored(rows.where(F.col("size") >= least_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id")), "firsts")
    first = F.col("first_id")
    revisit = first.isNotNull() & ~first.eqNullSafe(F.col("page_id")) & (F.col("size") >= least_revisit_bytes)

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(RECORD_END))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    only = lambda value: F.when(F.col("revisit"), value)
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", _urn(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))),
        line("WARC-Refers-To", only(_urn(first, F.col("digest")))), line("WARC-Profile", only(F.lit(_PROFILE))),
        line("X-Page-Id", F.col("page_id")), line("X-Refers-To-Page", only(first)), line("X-Payload-Length", F.col("size")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "))
    return rows.join(firsts, "digest", "left").withColumn("revisit", F.coalesce(revisit, F.lit(False))).withColumn("block", block).select(
        F.concat(head, F.octet_length("block").cast("string"), F.lit(RECORD_END), F.col("block")).alias("value"))


def write_monolithic(pages: DataFrame, path: str, **options) -> None:
    """Pages as WARC archives, each file one gzip stream."""
    records(pages, **options).write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


class RecordStream:
    """Cuts an inflated stream, fed in pieces, into records by their declared lengths."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.size, self.needed = 0, 1

    def feed(self, piece: bytes) -> Iterator[bytes]:
        self.parts.append(piece)
        self.size += len(piece)
        if self.size < self.needed:
            return
        data, start = b"".join(self.parts), 0
        while True:
            while data[start:start + 1] in (b"\r", b"\n"):  # empty lines between records
                start += 1
            head = data.find(b"\r\n\r\n", start)
            if head < 0:
                needed = 1
                break
            end = head + 4 + content_length(data[start:head]) + 4
            if end > len(data):
                needed = end - start
                break
            yield data[start:end]
            start = end
        rest = data[start:]
        self.parts, self.size, self.needed = [rest] if rest else [], len(rest), needed

    def close(self, archive: str) -> None:
        if b"".join(self.parts).strip(b"\r\n"):
            raise ValueError(f"{archive} ends within a record")


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}


def content_length(head: bytes) -> int:
    if not head.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {head[:40]!r}")
    return int(fields(head)["content-length"])


def gzip_member(record: bytes, offset: int, level: int) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    extra = _EXTRA.pack(b"OF", 8, offset)
    return b"".join((
        b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff", struct.pack("<H", len(extra)), extra, squeeze.compress(record),
        squeeze.flush(), struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)))


def read_member(member: bytes) -> tuple[int, bytes]:
    """The offset that a member carries, and its content."""
    inflate = zlib.decompressobj(16 + zlib.MAX_WBITS)
    record = inflate.decompress(member) + inflate.flush()
    if not inflate.eof or inflate.unused_data:
        raise ValueError("not exactly one gzip member")
    return _EXTRA.unpack_from(member, 12)[2], record


def normalise(spark: SparkSession, source: str, target: str, level: int = 4) -> None:
    """Rewrite monolithic archives with one gzip member per record."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, archive, offset = RecordStream(), None, 0
        for batch in batches:
            out = []
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != archive:
                    stream.close(archive)
                    stream, archive = RecordStream(), name
                for record in stream.feed(piece + b"\r\n\r\n"):
                    out.append(gzip_member(record, offset, level))
                    offset += len(out[-1]) + len(EMPTY_MEMBER)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
        stream.close(archive)

    pieces = spark.read.option("lineSep", RECORD_END).text(source).select("_metadata.file_path", F.col("value").cast("binary"))
    pieces.mapInArrow(rewrite, "member binary").select(F.col("member").cast("string")).write.options(**_MEMBER_TEXT).text(target)


def read_records(spark: SparkSession, archives: str, with_payload: bool = False) -> DataFrame:
    """What normalised archives hold: the columns of the index, and the payload if asked for.

    The payload of a revisit is null; its size and digest are those that its header gives. The
    digest of a response is taken from its payload, and must be the one in its header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_entry(a, m) for a, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            rows = rows if with_payload else [r[:-1] for r in rows]
            columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    schema = INDEX_SCHEMA + (", payload binary" if with_payload else "")
    names = [c.split(" ")[0] for c in schema.split(", ")]
    types = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types[c.split(" ")[1]] for c in schema.split(", ")]
    members = spark.read.options(**_MEMBER_TEXT).text(archives).select("_metadata.file_name", F.col("value").cast("binary"))
    return members.mapInArrow(read, schema)


def _entry(archive: str, member: bytes) -> tuple:
    offset, record = read_member(member)
    head, _, rest = record.partition(b"\r\n\r\n")
    said = fields(head)
    number = lambda name: int(said[name]) if name in said else None
    digest, kind, payload = said["warc-payload-digest"].removeprefix("sha1:"), said["warc-type"], None
    size = number("x-payload-length")
    if kind == "response":
        payload = rest[:-4].partition(b"\r\n\r\n")[2]
        size = len(payload)
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{archive}: payload at {offset} differs from its digest")
    return (
        number("x-page-id"), said.get("warc-target-uri"), size, digest, kind, number("x-refers-to-page"), archive, offset,
        len(member), payload)


def write_index(spark: SparkSession, archives: str, index: str) -> DataFrame:
    """Write the sidecar index of normalised archives, and read it."""
    read_records(spark, archives).write.parquet(index)
    return spark.read.schema(INDEX_SCHEMA).parquet(index)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives, normalise and index them, and return the index.

    ``folder`` gets ``monolithic``, ``members`` and ``index``; by default it is in the shared
    folder. The index is read from the finished archives. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    write_monolithic(pages, f"{folder}/monolithic")
    normalise(spark, f"{folder}/monolithic", f"{folder}/members")
    return write_index(spark, f"{folder}/members", f"{folder}/index")
