"""Archives written and read back, against digests computed on whole payloads."""

import base64
import gzip
import hashlib
import io
from pathlib import Path

import pytest
from factloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(pages, least=0):
    rows = []
    for page_id, _, html in pages:
        body = html or ""
        same = [p for p, _, h in pages if (h or "") == body]
        top = max(same, key=lambda p: (p is not None, p or 0)) if len(body.encode()) >= least else page_id
        rows.append((page_id, len(body.encode()), b32(body), top))
    return rows


ODD = [
    (1, "http://a/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (3, None, "<p>other é 漢🙂</p>"), (4, "http://c/\r\nX: 1", "WARC/1.1\r\n\r\n"), (5, "http://d/ü ?q=%20", None), (6, "", ""),
    (None, "http://none/", "<p>same</p>"), (None, None, None), (7, "http://long/", "0123456789" * 70_000), (8, "http://long/2", "0123456789" * 70_000), (9, "http://x", "\r\n\r\n"),
]


def test_round_trip_of_odd_pages(spark):
    frame = spark.createDataFrame([(*r, 1, "x", b"y") for r in ODD], SCHEMA + ", record long, digest string, data binary")
    rows = warc.round_trip(frame).collect()
    assert all(r.intact for r in rows)
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest) for r in rows) == sorted((p or -1, n, d) for p, n, d, _ in expected(ODD))
    tops = {(p, d): t for p, _, d, t in expected(ODD)}
    for r in rows:
        top = tops[r.page_id, r.payload_digest]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == top else ("revisit", top))


def test_payloads_come_back_whole(spark, tmp_path):
    manifest = warc.write_archives(spark.createDataFrame(ODD, SCHEMA), str(tmp_path), chunk=1000)
    rows = warc.read_archives(manifest, payloads=True, chunk=700).collect()
    heads = {r.record_id: r for r in rows if r.record_type}
    parts = {}
    for r in rows:
        if r.record_type is None:
            parts.setdefault(r.record_id, {})[r.chunk] = r.data
            assert len(r.data) <= 700
    assert len(heads) == len(ODD)
    for name, head in heads.items():
        data = b"".join(parts.get(name, {})[k] for k in range(head.chunk)) if head.chunk else b""
        if head.record_type == "response":
            assert len(data) == head.payload_bytes and base64.b32encode(hashlib.sha1(data).digest()).decode() == head.payload_digest
        else:
            assert not data
    assert manifest.agg({"records": "sum"}).first()[0] == len(ODD)


def test_least_size_repeated_rows_and_no_rows(spark):
    pages = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc"), (4, "u", "abc")]
    frame = spark.createDataFrame(pages, SCHEMA)
    kinds = sorted((r.page_id, r.record_type, r.refers_to or 0) for r in warc.round_trip(frame, least=3).collect())
    assert kinds == [(1, "response", 0), (2, "response", 0), (3, "revisit", 4), (4, "response", 0), (4, "revisit", 4)]
    none = warc.round_trip(frame.filter("false"))
    assert none.count() == 0 and none.columns[:2] == ["record_id", "page_id"]


def test_records_are_gzip_members_in_the_standard_form(spark, tmp_path):
    path = warc.write_archives(spark.createDataFrame(ODD[:3], SCHEMA), str(tmp_path)).first().path
    raw = Path(path).read_bytes()
    assert raw.count(b"\x1f\x8b\x08") >= 4
    text = gzip.decompress(raw)
    records = text.split(b"WARC/1.1\r\n")[1:]
    assert records[0].startswith(b"WARC-Type: warcinfo")
    for record in records:
        head, _, block = record.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
        assert block[int(fields["Content-Length"]):] == b"\r\n\r\n"


def test_damage_is_seen():
    def archive(body, told):
        http = f"HTTP/1.1 200 OK\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:1>\r\nWARC-Payload-Digest: sha1:{told}\r\nContent-Length: {len(http) + len(body)}\r\n\r\n"
        return gzip.compress(head.encode() + http + body + b"\r\n\r\n")

    read = lambda raw: list(warc.records(gzip.GzipFile(fileobj=io.BytesIO(raw))))
    good, bad = read(archive(b"abc", b32("abc")))[-1], read(archive(b"abd", b32("abc")))[-1]
    assert good["intact"] and good["page_id"] is None and not bad["intact"]
    cut = gzip.compress(gzip.decompress(archive(b"abc" * 100, b32("x")))[:-50])
    with pytest.raises(EOFError):
        read(cut)
