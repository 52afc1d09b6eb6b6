"""WARC archives from page tables, and back.

Payloads travel as a table of chunks: (record, chunk number, bytes) with the SHA-1 of the payload up to and with
the chunk. A task that writes or reads archives holds one chunk at a time, and the digest of a payload is known when its last chunk has passed.

Writing takes two passes. The last chunks of all payloads, which carry no bytes, decide by digest which record is a response
and which ones revisit it; then every decision meets its chunks, sorted in front of them, in the task that writes their file. Each
record is a gzip member of its own. File names are unique to an attempt and only files that a finished task
reports count, so a task that runs again leaves nothing half-written in the result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import checkpoint, discard, reread, scratch_path, shared_folder

#: Bytes of a chunk, payload bytes of an archive file, and tasks over which the records of one digest are dealt.
CHUNK, FILE, SPREAD = 1 << 18, 64 << 20, 32
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record long, page_id long, url string, chunk long, chunks long, data binary, bytes long, digest string"
READ = "record_id string, page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, intact boolean"
MANIFEST = "path string, records long, size long"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_table(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Payloads as chunk rows with running sizes and digests, their bytes deflated; an empty payload is one empty chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, size = hashlib.sha1(), 0
        for batch in batches:
            sizes, digests, packed = [], [], []
            for number, data in zip(batch.column("chunk").to_pylist(), batch.column("data")):
                if number == 0:
                    sha, size = hashlib.sha1(), 0
                data = data.as_buffer()
                sha.update(data)
                size += data.size
                sizes.append(size)
                digests.append(base32(sha.digest()))
                packed.append(zlib.compress(data, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], [*batch.schema.names, "bytes", "digest"])

    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("_payload"))
    chunks = F.greatest(F.ceil(F.octet_length("_payload") / chunk), F.lit(1)).cast("long")
    pieces = F.transform(F.sequence(F.lit(0), chunks.cast("int") - 1), lambda k: F.substring(F.col("_payload"), k * chunk + 1, F.lit(chunk)))
    cut = rows.select("record", "page_id", "url", chunks.alias("chunks"), F.posexplode(pieces).alias("chunk", "data"))
    return cut.select("record", "page_id", "url", F.col("chunk").cast("long").alias("chunk"), "chunks", "data").mapInArrow(run, CHUNKS)


def decisions(chunks: DataFrame, least: int = 0) -> DataFrame:
    """Per record (record, page_id, url, bytes, digest, revisits): the record that it revisits, as a struct (page_id, record), or null.

    Of records with equal payloads of at least ``least`` bytes that with the largest page_id (null is least, then the last
    of equal rows) is the response. The winners of digests met more than once are few and small rows; each is repeated
    ``SPREAD`` times, so that the records of a common payload meet it in as many tasks.
    """
    ends = chunks.filter(F.col("chunk") == F.col("chunks") - 1).select("record", "page_id", "url", "bytes", "digest")
    own = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "record")
    winners = ends.filter(F.col("bytes") >= least).groupBy("digest").agg(F.max(own).alias("best"), F.count("*").alias("n")).filter("n > 1")
    winners = winners.select("digest", "best", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    salted = ends.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(SPREAD)).cast("int"))
    revisits = F.when(F.col("best.record") != F.col("record"), F.struct("best.page_id", "best.record"))
    return salted.join(winners, ["digest", "salt"], "left").select("record", "page_id", "url", "bytes", "digest", revisits.alias("revisits"))


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that Spark names."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", folder)))


def record_id(page_id: int | None, record: int) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{record}>"


def page_of(record_id: str) -> int | None:
    """Page in a record id of ``record_id``; None in others."""
    found = re.fullmatch(r"<urn:page:(-?\d+):\d+>", record_id)
    return int(found[1]) if found else None


def _head(fields: list[tuple[str, str | None]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def record_head(row: dict, date: str) -> bytes:
    """Everything of a record before its payload: WARC header, and HTTP header with the size of the payload."""
    revisits, url = row["revisits"], row["url"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    return _head([
        ("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", record_id(row["page_id"], row["record"])), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")), ("WARC-Payload-Digest", f"sha1:{row['digest']}"),
        ("WARC-Refers-To", record_id(revisits["page_id"], revisits["record"]) if revisits else None), ("WARC-Profile", PROFILE if revisits else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + (0 if revisits else row["bytes"])))]) + http


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = DATE, chunk: int = CHUNK) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html; other columns are ignored) to gzip files in ``folder``; (path, records, size) of each file.

    A null html is an empty payload; see ``decisions`` for responses and revisits. Rows that repeat a page_id are records of
    their own. A null url has no target line. No rows in, no files.
    """
    spark = pages.sparkSession
    place = scratch_path(spark, "chunks")
    chunks = reread(chunk_table(pages, chunk), "chunks", place, compression="zstd")
    decided = decisions(chunks, least)
    total = chunks.filter("chunk = chunks - 1").agg(F.sum("bytes")).first()[0] or 0
    none = lambda kind: F.lit(None).cast(kind)
    revisits = "struct<page_id:bigint,record:bigint>"
    rows = decided.select("record", F.lit(-1).cast("long").alias("chunk"), "page_id", "url", "bytes", "digest", "revisits", none("binary").alias("data")).unionByName(
        chunks.select("record", "chunk", none("long").alias("page_id"), none("string").alias("url"), none("long").alias("bytes"), none("string").alias("digest"), none(revisits).alias("revisits"), "data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, records = None, 0
        for batch in batches:
            heads = batch.drop_columns(["data"]).to_pylist()
            for row, data in zip(heads, batch.column("data")):
                if out is None:
                    files, at = store(folder)
                    path = f"{folder}/pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    files.create_dir(at)
                    out = files.open_output_stream(f"{at}/{path.rsplit('/', 1)[1]}", compression=None)
                    info = b"software: factloom\r\nformat: WARC File Format 1.1\r\n"
                    out.write(gzip.compress(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]) + info + b"\r\n\r\n"))
                if row["chunk"] < 0:
                    if records:
                        out.write(member.compress(b"\r\n\r\n") + member.flush())
                    member, revisit, records = zlib.compressobj(6, zlib.DEFLATED, 31), row["revisits"], records + 1
                    out.write(member.compress(record_head(row, date)))
                elif not revisit:
                    out.write(member.compress(zlib.decompress(data.as_buffer())))
        if out is not None:
            out.write(member.compress(b"\r\n\r\n") + member.flush())
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": records, "size": size}], pa.schema([("path", pa.string()), ("records", pa.int64()), ("size", pa.int64())]))

    dealt = rows.repartition(max(1, -(-total // FILE)), "record").sortWithinPartitions("record", "chunk")
    manifest = checkpoint(dealt.mapInArrow(run, MANIFEST))
    discard(spark, place)
    return manifest


def _fields(stream: gzip.GzipFile) -> dict[str, str]:
    """Header lines up to the empty one, by lower-case name."""
    fields = {}
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def records(stream: gzip.GzipFile, chunk: int = CHUNK) -> Iterator[dict]:
    """Response and revisit records of an archive: a row per chunk of the payload as it comes, then the record's own row."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError("no record where one should start")
            continue
        head = _fields(stream)
        left, kind, name = int(head["content-length"]), head["warc-type"], head["warc-record-id"]
        page, known, sha, size, number = kind in ("response", "revisit"), None, hashlib.sha1(), 0, 0
        while page and left and (line := stream.readline()):  # the HTTP header belongs to the block, not to the payload
            left -= len(line)
            if not line.strip():
                break
            field, _, value = line.decode("latin-1").partition(":")
            known = int(value) if field.strip().lower() == "content-length" else known
        while left:
            data = stream.read(min(left, chunk))
            if not data:
                raise EOFError("an archive ends inside a record")
            left -= len(data)
            if page:
                sha.update(data)
                size += len(data)
                yield {"record_id": name, "chunk": number, "data": data}
                number += 1
        if page:
            told, whole = head.get("warc-payload-digest", "").removeprefix("sha1:"), kind == "response"
            digest = base32(sha.digest()) if whole else told
            yield {"record_id": name, "page_id": page_of(name), "record_type": kind, "refers_to": page_of(head.get("warc-refers-to", "")), "url": head.get("warc-target-uri"),
                   "payload_bytes": size if whole else known, "payload_digest": digest, "intact": not whole or (digest == told and size == known), "chunk": number}


def read_archives(paths: DataFrame, payloads: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Records of the archives in column ``path``: one row per record, or with ``payloads`` chunk rows (record_id, chunk, data) as well.

    ``payload_bytes`` and ``payload_digest`` of a response are computed from its bytes, chunk by chunk, and
    ``intact`` tells whether they are those in its header; a revisit holds no payload and names them. With ``payloads`` a record's row
    follows its chunks, with null ``data`` and the number of chunks as ``chunk``. No paths in, no rows out.
    """
    schema = READ + (", chunk long, data binary" if payloads else "")
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                folder, name = path.rsplit("/", 1)
                files, at = store(folder)
                held, size = [], 0
                with files.open_input_stream(f"{at}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in records(stream, chunk):
                        if payloads or "record_type" in row:
                            held.append(row)
                            size += len(row.get("data", b""))
                        if len(held) >= 1000 or size >= 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(held, arrow)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, arrow)

    paths = paths.select("path")
    return paths.repartitionByRange(max(1, paths.count()), "path").mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives of ``pages`` in a new place of the shared folder, read back: ``read_archives`` rows, one per row of ``pages``."""
    spark = pages.sparkSession
    manifest = write_archives(pages, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}", least)
    return read_archives(manifest)


#: Five hexadecimal digits of a digest are four letters of base 32.
_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {s}) % 32, 1)" for i in range(8) for s in (15, 10, 5, 0))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT page_id, strlen(body) AS payload_bytes, {_LETTERS} AS payload_digest,
             row_number() OVER w AS k, first_value(page_id) OVER w AS first_id
      FROM p WINDOW w AS (PARTITION BY body ORDER BY page_id DESC NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN first_id END AS refers_to
FROM m"""
