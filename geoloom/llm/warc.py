"""WARC archives: a writer with revisit records and a salvage reader.

The writer packs one gzip member a record. Of records with equal payloads of at least ``least`` bytes the one
with the smallest id is the response; the others are revisits that name it and carry only the header block.
Archives are rows (name, bytes) of a table in the shared folder, since executors share no other disk.

The reader checks every member: gzip checksum, version line, Content-Length, block digest. After a failed
check it searches for the next gzip magic (or version line, in plain archives) that begins a valid record,
goes on from there, and logs the bytes between as a quarantined gap.

Defined results: a null payload is an empty one; payloads under ``least`` bytes are responses; rows that tie
on the smallest id of a payload are all responses; a row without id is a revisit if an equal payload has
one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, map_arrow

#: An archive is closed when it has this many bytes.
ARCHIVE = 8 << 20
VERSION = b"WARC/1.1\r\n"
EPOCH = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit (``refers_to``) has the header block only."""
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    own = "" if page_id is None else str(page_id)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{own}>"),
        ("WARC-Date", EPOCH),
        ("WARC-Target-URI", uri),
        *([] if refers_to is None else [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parsed(raw: bytes, at: int = 0) -> tuple[dict, bytes, int] | None:
    """Fields, block and end of the record at ``at``, or nothing if it fails a check."""
    if not re.match(rb"WARC/1\.[01]\r\n", raw[at : at + 10]):
        return None
    head = raw.find(b"\r\n\r\n", at)
    if head < 0:
        return None
    fields = {}
    for line in raw[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isdigit():
        return None
    block = raw[head + 4 : head + 4 + int(length)]
    end = head + 4 + int(length)
    if len(block) != int(length) or raw[end : end + 4] != b"\r\n\r\n":
        return None
    told = fields.get("warc-block-digest", "")
    if told.startswith("sha256:") and hashlib.sha256(block).hexdigest() != told[7:]:
        return None
    return fields, block, end + 4


def gzip_record(data: bytes, at: int) -> tuple[dict, bytes, int] | None:
    """The record of the gzip member at ``at``, and where the member ends."""
    unpacker, parts, pos = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof:
            if pos >= len(data):
                return None
            parts.append(unpacker.decompress(data[pos : pos + 65_536]))
            pos += 65_536
    except zlib.error:
        return None
    raw = b"".join(parts)
    got = parsed(raw)
    if got is None or got[2] != len(raw):
        return None
    return got[0], got[1], min(pos, len(data)) - len(unpacker.unused_data)


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | None, bytes]]:
    """("record", start, end, fields, block) and ("gap", start, end, None, b"") over the whole archive, in order."""
    at, packed = 0, b"WARC/" not in data[:5]
    read, sign = (gzip_record, b"\x1f\x8b\x08") if packed else (parsed, b"WARC/1.")
    while at < len(data):
        found, pos = read(data, at), at
        while found is None:
            pos = data.find(sign, pos + 1)
            if pos < 0:
                break
            found = read(data, pos)
        if found is None:
            yield "gap", at, len(data), None, b""
            return
        if pos > at:
            yield "gap", at, pos, None, b""
        fields, block, end = found
        yield "record", pos, end, fields, block
        at = end


def with_roles(pages: DataFrame, key: str, payload: str, least: int) -> DataFrame:
    """``pages`` with digest and the id that a revisit refers to (null: a response)."""
    raw = F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8")
    rows = pages.withColumn("__digest", F.sha2(raw, 256))
    heads = pages.select(F.col(key).alias("__id"), F.octet_length(raw).alias("__n"), F.sha2(raw, 256).alias("__digest")).where(F.col("__n") >= least)
    heads = heads.groupBy("__digest").agg(F.min("__id").alias("__head"), F.count("*").alias("__copies")).where("__copies > 1").drop("__copies")
    return rows.join(heads, "__digest", "left").withColumn("__refers", F.when(F.col(key).isNull() | (F.col(key) != F.col("__head")), F.col("__head")))


def write_archives(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 100) -> DataFrame:
    """A table of archives: name, number of records, bytes."""
    rows = with_roles(pages.select(key, url, payload), key, payload, least).select(key, url, payload, "__digest", "__refers")

    def pack(batches):
        from pyspark import TaskContext

        part, k, held, n, size = TaskContext.get().partitionId(), 0, [], 0, 0

        def close():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{k:06d}.warc.gz"]), pa.array([n], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["archive", "records", "data"])

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                page_id, uri, _, digest, refers = (x.as_py() for x in row)
                raw = row[2].as_buffer().to_pybytes() if row[2].is_valid else b""
                held.append(member(record(page_id, uri, raw, digest, refers)))
                n, size = n + 1, size + len(held[-1])
                if size >= ARCHIVE:
                    yield close()
                    k, held, n, size = k + 1, [], 0, 0
        if held:
            yield close()

    return rows.mapInArrow(pack, "archive string, records long, data binary")


READ = "archive string, kind string, start long, stop long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, target_uri string"


def read_archives(archives: DataFrame) -> DataFrame:
    """One row a record or quarantined gap (``kind``), with its byte range in the archive."""

    def number(urn: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(m[1]) if m else None

    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in READ.split(", ")]

    def make():
        def step(batch):
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for kind, start, stop, fields, block in salvage(data.as_py()):
                    if fields is None:
                        rows.append((name.as_py(), kind, start, stop, *[None] * 6))
                        continue
                    head, _, body = block.partition(b"\r\n\r\n")
                    told = re.search(rb"(?i)content-length: *(\d+)", head)
                    length = int(told[1]) if told else len(body)
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    if fields.get("warc-type") == "response":
                        length, digest = len(body), hashlib.sha256(body).hexdigest()
                    rows.append((name.as_py(), kind, start, stop, number(fields.get("warc-record-id")), fields.get("warc-type"), number(fields.get("warc-refers-to")), length, digest, fields.get("warc-target-uri")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        return step

    return map_arrow(archives.select("archive", "data"), make, READ)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "warc")
    archives = stages.keep(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")), "archives")
    stages.sweep()
    return read_archives(archives).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
