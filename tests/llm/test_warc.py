import gzip
import hashlib
import io
from collections import Counter

from pyspark.sql import functions as F

from voltide.llm import warc
from voltide.session import scratch_path


def build(spark, rows, **how):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, extra string").withColumn("keeper", F.lit(1))
    path = scratch_path(spark)
    warc.write_archive(pages, warc.plan_revisits(pages), path, **how)
    return path


def test_round_trip(spark):
    big, wild = "payload ü " * 900, "0\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n" * 60
    rows = [(1, "http://a/ b\r\nX: y", big, "e"), (5, None, big, "e"), (3, "http://é", big, None), (4, "u", "small", None), (9, "u", "small", None),
            (6, "u", None, None), (7, "u", "", None), (8, "u", wild, None), (10, "u", wild + "\n", None), (4, "u", "small", None), (None, "u", big, None)]
    got = warc.resolve(warc.read_archive(spark, build(spark, rows, segment_bytes=700, chunk_bytes=300, records_per_file=50))).collect()
    want = Counter()
    for i, _, html, _ in set(rows):
        b = (html or "").encode()
        keeper = max((j for j, _, h, _ in rows if j is not None and (h or "").encode() == b), default=None) if len(b) >= 1000 else None
        revisit = i is not None and keeper is not None and i < keeper
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None, "ok"] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["status"]) for r in got) == want


def test_segments_are_checked():
    assert warc.join_segments([2, 1, 2], [b"b", b"a", b"b"], 2) == (b"ab", "ok")
    assert warc.join_segments([1, 3], [b"a", b"c"], 2)[1] == "missing segment"
    assert warc.join_segments([1, 2], [b"a", b"b"], None)[1] == "missing last segment"
    assert warc.join_segments([1, 2], [b"a", b"b"], 3)[1] == "wrong total length"


def test_framing():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    for payload in (b"", b"x", b"0\r\n\r\n" * 50):
        assert warc.decode_http(head + warc.chunked(payload, 7)) == (payload, "ok")
    assert warc.decode_http(head + b"3;name=v\r\nabc\r\n0\r\n\r\n") == (b"abc", "ok")
    assert warc.decode_http(head + b"5\r\nabc\r\n0\r\n\r\n")[0] is None
    assert warc.decode_http(head + b"zz\r\n")[0] is None
    assert warc.decode_http(b"HTTP/1.1 200 OK\r\n\r\nplain") == (b"plain", "ok")
    assert warc.decode_http(b"no end")[0] is None


def test_lost_segment_is_reported(spark):
    records = warc.read_archive(spark, build(spark, [(1, "u", "z" * 5000, None)], segment_bytes=1000))
    got = warc.resolve(records.where("coalesce(segment, 1) <> 2")).collect()
    assert [(r["page_id"], r["payload_bytes"], r["status"]) for r in got] == [(1, None, "missing segment")]


def test_foreign_archive(tmp_path, spark):
    one = warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<i>")], b"software: x\r\n")
    two = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<r>"), ("WARC-Target-URI", "http://x")], b"HTTP/1.1 200 OK\r\n\r\nbody")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "b.warc").write_bytes(two + b"garbage")
    records = warc.read_archive(spark, str(tmp_path))
    assert records.count() == 3
    assert [bytes(r["payload"]) for r in warc.responses(records).collect()] == [b"body", b"body"]
    assert len(list(warc.parse_records(io.BytesIO(b"")))) == 0


def test_no_pages(spark):
    assert warc.resolve(warc.read_archive(spark, build(spark, []))).count() == 0
