"""WARC archives: writing with segmentation and revisits, reading with segment reassembly.

A payload travels as a chunked HTTP body. A block longer than a segment is cut into an origin record and
continuation records; reading groups the pieces by origin identifier, orders them by segment number,
verifies that they are gapless and as long as stated, and only then decodes the chunk framing.

Archives are gzip files written by Spark's text writer, one record per row, so any file system that Spark
writes to serves; a file holds a bounded number of records of bounded size. Of a page only its own
segments meet in one group.

Defined results: null html is an empty payload, a null url has no target; a null page id is kept as such and
never revisits; rows equal in page id and payload are one page; extra columns are ignored; an empty table
gives an empty archive. What can't be reassembled is returned with a null payload and the reason in ``status``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltide.llm.common import schema
from voltide.session import cut_lineage

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- which record is a revisit ------------------------------------------------------

def plan_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, payload_key, keeper): pages whose payload, of ``least_bytes`` or more, a larger page id has too.

    Equal payloads are counted by an aggregate that combines map-side; the keepers are then a written table,
    so the join back to a payload that a third of all pages share is split by adaptive execution.
    """
    keyed = pages.select("page_id", payload_key(F.col("html")).alias("payload_key")).where(
        F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes)
    keepers = cut_lineage(keyed.groupBy("payload_key").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
                          .where("n > 1").drop("n"))
    return keyed.join(keepers, "payload_key").where("page_id < keeper").dropDuplicates(["page_id", "payload_key"])


def payload_key(html):
    return F.unhex(F.sha2(F.coalesce(html, F.lit("")), 256))


# ---- writing ------------------------------------------------------------------------

def record_id(page_id: int | None, sha1: bytes) -> str:
    """Named by page and payload, so a revisit can name a record that another task writes."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}/'.encode() + sha1).digest()[:16], version=5)}>"


def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i:i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_records(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, segment_bytes: int,
                 chunk_bytes: int, date: str) -> Iterator[bytes]:
    sha1 = hashlib.sha1(payload).digest()
    own = record_id(page_id, sha1)
    common = [("WARC-Date", date), ("WARC-Record-ID", own), ("X-Page-Id", None if page_id is None else str(page_id)),
              ("WARC-Target-URI", None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")),
              ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()),
              ("Content-Type", "application/http; msgtype=response")]
    if keeper is not None:
        yield record([("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(keeper, sha1))], REVISIT_HEAD)
        return
    block = HTTP_HEAD + chunked(payload, chunk_bytes)
    pieces = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(pieces) == 1:
        yield record([("WARC-Type", "response"), *common], block)
        return
    yield record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1")], pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        last = str(len(block)) if n == len(pieces) else None
        name = f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{own}#{n}'.encode()).digest()[:16], version=5)}>"
        yield record([("WARC-Type", "continuation"), ("WARC-Date", date), ("WARC-Record-ID", name), ("WARC-Segment-Origin-ID", own),
                      ("WARC-Segment-Number", str(n)), ("WARC-Segment-Total-Length", last)], piece)


def write_archive(pages: DataFrame, revisits: DataFrame, path: str, segment_bytes: int = 4096, chunk_bytes: int = 1500,
                  records_per_file: int = 8192, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one response or revisit per page (page_id, url, html) to gzip files under ``path``."""
    decided = pages.select("page_id", "url", "html", payload_key(F.col("html")).alias("payload_key")).join(
        revisits, ["page_id", "payload_key"], "left").select("page_id", "url", F.col("html").cast("binary").alias("html"), "keeper")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for page_id, url, html, keeper in zip(*(c.to_pylist() for c in b.columns)):
                for r in page_records(page_id, url, html or b"", keeper, segment_bytes, chunk_bytes, date):
                    out.append(r[:-1])      # the text writer ends each row with the line feed
                    held += len(r)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    (decided.mapInArrow(rows, schema("value binary")).select(F.col("value").cast("string").alias("value"))
     .write.option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


# ---- reading ------------------------------------------------------------------------

RECORD = ("type string, record_id string, page_id bigint, uri string, refers_to string, payload_digest string, origin string, "
          "segment int, total_length bigint, block binary")


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """Records in order; stops at the end of the stream or at bytes that begin no record."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line.startswith(b"WARC/"):
            return
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields.get("content-length", 0)))
        number = lambda key: int(fields[key]) if fields.get(key, "").lstrip("-").isdigit() else None
        yield (fields.get("warc-type"), fields.get("warc-record-id"), number("x-page-id"), fields.get("warc-target-uri"),
               fields.get("warc-refers-to"), fields.get("warc-payload-digest"), fields.get("warc-segment-origin-id"),
               number("warc-segment-number"), number("warc-segment-total-length"), block)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records under ``path`` (plain or gzip files), one row each, blocks as they stand."""
    target = schema(RECORD)
    names = target.fieldNames()
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        for b in batches:
            for i in range(b.num_rows):
                raw = io.BytesIO(b.column(0)[i].as_buffer())
                zipped = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                out, held = [], 0
                for r in parse_records(gzip.GzipFile(fileobj=raw) if zipped else raw):
                    out.append(r)
                    held += len(r[-1])
                    if held > 4 << 20:
                        yield pack(out)
                        out, held = [], 0
                if out:
                    yield pack(out)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, target)


def decode_http(block: bytes) -> tuple[bytes | None, str]:
    """(body, ok or what is wrong) of an HTTP response, chunk framing removed."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None, "no end of HTTP headers"
    if b"transfer-encoding: chunked" not in head.lower():
        return body, "ok"
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        try:
            n = int(size, 16)
        except ValueError:
            return None, "bad chunk size"
        if n == 0:
            return b"".join(parts), "ok"
        if body[end + 2 + n:end + 4 + n] != b"\r\n":
            return None, "bad chunk"
        parts.append(body[end + 2:end + 2 + n])
        at = end + 4 + n


def join_segments(numbers: list[int], blocks: list[bytes], total: int | None) -> tuple[bytes | None, str]:
    """The whole block of one origin, if segments 1 to n are all there and as long as stated. Repeats count once."""
    pieces = dict(sorted(zip(numbers, blocks)))
    if list(pieces) != list(range(1, len(pieces) + 1)):
        return None, "missing segment"
    whole = b"".join(pieces.values())
    if total is None:
        return None, "missing last segment"
    return (whole, "ok") if len(whole) == total else (None, "wrong total length")


def responses(records: DataFrame) -> DataFrame:
    """(record_id, page_id, uri, payload, status) of every response, segments put together.

    Only segmented records are shuffled.
    """
    one = records.where("type = 'response' AND segment IS NULL").selectExpr(
        "record_id", "page_id", "uri", "CAST(NULL AS ARRAY<INT>) AS numbers", "array(block) AS blocks", "CAST(NULL AS BIGINT) AS total")
    many = (records.where("segment IS NOT NULL AND (type = 'continuation' OR type = 'response')")
            .groupBy(F.coalesce("origin", "record_id").alias("record_id"))
            .agg(F.max("page_id").alias("page_id"), F.max("uri").alias("uri"), F.collect_list(F.struct("segment", "block")).alias("parts"),
                 F.max("total_length").alias("total"))
            .selectExpr("record_id", "page_id", "uri", "parts.segment AS numbers", "parts.block AS blocks", "total"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads, notes, first = [], [], 0
            held = 0
            for i in range(b.num_rows):
                numbers, blocks = b.column(3)[i].as_py(), b.column(4)[i].as_py()
                whole, note = (blocks[0], "ok") if numbers is None else join_segments(numbers, blocks, b.column(5)[i].as_py())
                body, note = decode_http(whole) if whole is not None else (None, note)
                payloads.append(body)
                notes.append(note)
                held += len(body or b"")
                if held > 4 << 20 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [*b.slice(first, i + 1 - first).columns[:3], pa.array(payloads, pa.binary()), pa.array(notes, pa.string())],
                        ["record_id", "page_id", "uri", "payload", "status"])
                    payloads, notes, first, held = [], [], i + 1, 0

    return one.unionByName(many).mapInArrow(decode, schema("record_id string, page_id bigint, uri string, payload binary, status string"))


def resolve(records: DataFrame) -> DataFrame:
    """Per page: size and SHA-1 of the full payload as decoded, record type, and the page a revisit refers to."""
    full = cut_lineage(
        responses(records).selectExpr("record_id", "page_id", "octet_length(payload) AS payload_bytes", "sha1(payload) AS payload_digest", "status")
        .dropDuplicates(["record_id"]))
    revisits = records.where("type = 'revisit'").select("record_id", "page_id", "refers_to").dropDuplicates(["record_id"])
    named = full.selectExpr("record_id AS refers_to", "page_id AS refers_page", "payload_bytes", "payload_digest", "status")
    return full.selectExpr("page_id", "CAST(payload_bytes AS BIGINT) AS payload_bytes", "payload_digest", "'response' AS record_type",
                           "CAST(NULL AS BIGINT) AS refers_to", "status").unionByName(
        revisits.join(named, "refers_to", "left").selectExpr(
            "page_id", "CAST(payload_bytes AS BIGINT) AS payload_bytes", "payload_digest", "'revisit' AS record_type",
            "refers_page AS refers_to", "coalesce(status, 'record referred to is missing') AS status"))
