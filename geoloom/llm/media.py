"""Media columns: signature sniffing.

An Aho-Corasick automaton finds the magic bytes of known formats anywhere in a binary value; a format's
validator then walks the structure from there (chunk lengths, checksums, trailers) and says how long the
object is, or that it is none. The object at offset 0 corrects the declared type; valid objects further
inside are carved.

Payloads are stored losslessly as 8-bit samples: WAV (unsigned 8-bit PCM) or PNG (8-bit grey), by a bit of
the payload's checksum.

Defined results: a null text is an empty one (64 zero bytes are stored); a null binary value has no type
and nothing carved; equal values give equal results, repeated rows are all kept; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pieces, whole_text

# Magic bytes, their offset in the object, and the type whose validator decides.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"RIFF", 0, "riff"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
    (b"ftyp", 4, "video/mp4"),
]
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


def png_length(data: bytes, at: int) -> int | None:
    pos, first = at + 8, True
    while pos + 12 <= len(data):
        n, kind = int.from_bytes(data[pos : pos + 4], "big"), data[pos + 4 : pos + 8]
        end = pos + 12 + n
        if end > len(data) or first != (kind == b"IHDR") or zlib.crc32(data[pos + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return None
        if kind == b"IEND":
            return end - at
        pos, first = end, False
    return None


def gif_length(data: bytes, at: int) -> int | None:
    def blocks(pos):
        while pos < len(data) and data[pos]:
            pos += data[pos] + 1
        return pos + 1

    if at + 13 > len(data):
        return None
    pos = at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 128 else 0)
    while pos < len(data):
        if data[pos] == 0x3B:
            return pos + 1 - at
        if data[pos] == 0x21:
            pos = blocks(pos + 2)
        elif data[pos] == 0x2C and pos + 10 <= len(data):
            packed = data[pos + 9]
            pos = blocks(pos + 11 + (3 << (packed & 7) + 1 if packed & 128 else 0))
        else:
            return None
    return None


def jpeg_length(data: bytes, at: int) -> int | None:
    pos = at + 2
    while pos + 4 <= len(data) and data[pos] == 0xFF:
        marker = data[pos + 1]
        if marker == 0xD9:
            return pos + 2 - at
        n = int.from_bytes(data[pos + 2 : pos + 4], "big")
        if n < 2:
            return None
        pos += 2 + n
        if marker == 0xDA:
            while 0 <= (pos := data.find(b"\xff", pos)) < len(data) - 1 and (data[pos + 1] == 0 or 0xD0 <= data[pos + 1] <= 0xD7):
                pos += 2
            if pos < 0:
                return None
    return pos + 2 - at if data[pos : pos + 2] == b"\xff\xd9" else None


def riff_length(data: bytes, at: int) -> tuple[str, int] | None:
    kind = RIFF_TYPES.get(data[at + 8 : at + 12])
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    if not kind or end > len(data):
        return None
    pos = at + 12
    while pos + 8 <= end:
        pos += 8 + (n := int.from_bytes(data[pos + 4 : pos + 8], "little")) + n % 2
    return (kind, end - at) if pos in (end, end + 1) else None


def zip_length(data: bytes, at: int) -> int | None:
    pos = at
    while 0 <= (pos := data.find(b"PK\x05\x06", pos + 1)):
        if pos + 22 > len(data):
            return None
        size, offset, note = struct.unpack_from("<IIH", data, pos + 12)
        if at + offset + size == pos and data[at + offset : at + offset + 4] == b"PK\x01\x02" and pos + 22 + note <= len(data):
            return pos + 22 + note - at
    return None


def gzip_length(data: bytes, at: int) -> int | None:
    unpacker = zlib.decompressobj(31)
    try:
        for pos in range(at, len(data), 1 << 20):
            unpacker.decompress(data[pos : pos + (1 << 20)])
            if unpacker.eof:
                return min(pos + (1 << 20), len(data)) - len(unpacker.unused_data) - at
    except zlib.error:
        pass
    return None


def ogg_length(data: bytes, at: int) -> int | None:
    pos = at
    while data[pos : pos + 4] == b"OggS" and pos + 27 <= len(data) and data[pos + 4] == 0:
        segments = data[pos + 26]
        end = pos + 27 + segments + sum(data[pos + 27 : pos + 27 + segments])
        if end > len(data):
            return None
        last, pos = data[pos + 5] & 4, end
        if last:
            return pos - at
    return None


def flac_length(data: bytes, at: int) -> int | None:
    """To the end of the metadata; frames are taken to go on to the value's end."""
    pos = at + 4
    if data[pos : pos + 4][:1] not in (b"\x00", b"\x80") or data[pos + 1 : pos + 4] != b"\x00\x00\x22":
        return None
    while pos + 4 <= len(data):
        last, n = data[pos] & 128, int.from_bytes(data[pos + 1 : pos + 4], "big")
        pos += 4 + n
        if last:
            return len(data) - at if pos <= len(data) else None
    return None


def mp4_length(data: bytes, at: int) -> int | None:
    pos, kinds = at, []
    while pos + 8 <= len(data):
        n, kind = int.from_bytes(data[pos : pos + 4], "big"), data[pos + 4 : pos + 8]
        if n < 8 or pos + n > len(data) or not kind.isalnum():
            break
        kinds.append(kind)
        pos += n
    return pos - at if kinds[:1] == [b"ftyp"] and b"moov" in kinds else None


def pdf_length(data: bytes, at: int) -> int | None:
    end = data.find(b"%%EOF", at)
    return end + 5 - at if end >= 0 and b"startxref" in data[at:end] else None


VALIDATORS = {
    "image/png": png_length, "image/gif": gif_length, "image/jpeg": jpeg_length, "application/pdf": pdf_length, "application/zip": zip_length,
    "application/gzip": gzip_length, "audio/flac": flac_length, "audio/ogg": ogg_length, "video/mp4": mp4_length,
}


class Sniffer:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for magic, offset, kind in MAGIC:
            self.automaton.add_word(magic.decode("latin-1"), (len(magic), offset, kind))
        self.automaton.make_automaton()

    def objects(self, data: bytes) -> list[tuple[int, int, str]]:
        """Confirmed objects (offset, length, type), none inside another."""
        out, free = [], 0
        for last, (n, offset, kind) in self.automaton.iter(data.decode("latin-1")):
            at = last + 1 - n - offset
            if at < free:
                continue
            if kind == "riff":
                found = riff_length(data, at)
            else:
                found = (kind, length) if (length := VALIDATORS[kind](data, at)) else None
            if found:
                out.append((at, found[1], found[0]))
                free = at + found[1]
        return out

    def sniff(self, data: bytes | None, declared: str | None) -> tuple[str | None, bool, int, list]:
        """Type (the declared one where nothing is confirmed at 0), whether that corrects, length, carved objects.

        What a container embeds is looked for behind its own header.
        """
        if data is None:
            return None, False, 0, []
        found = self.objects(data)
        if found and found[0][0] == 0:
            _, n, kind = found[0]
            inner = [(at + 1, m, k) for at, m, k in self.objects(data[1:n]) if at + 1 < n]
            return kind, kind != declared, n, inner + found[1:]
        return declared, False, len(data), found


def wav_of(payload: bytes, rate: int = 8000) -> bytes:
    body = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def wav_samples(data: bytes) -> bytes:
    pos = 12
    while pos + 8 <= len(data):
        n = int.from_bytes(data[pos + 4 : pos + 8], "little")
        if data[pos : pos + 4] == b"data":
            return data[pos + 8 : pos + 8 + n]
        pos += 8 + n + n % 2
    raise ValueError("no samples")


def png_of(payload: bytes, width: int = 64) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + payload[i : i + width] for i in range(0, len(payload), width))
    header = struct.pack(">IIBBBBB", width, len(payload) // width, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def png_samples(data: bytes) -> bytes:
    pos, width, packed = 8, 0, []
    while pos + 12 <= len(data):
        n, kind = int.from_bytes(data[pos : pos + 4], "big"), data[pos + 4 : pos + 8]
        if kind == b"IHDR":
            width = int.from_bytes(data[pos + 8 : pos + 12], "big")
        elif kind == b"IDAT":
            packed.append(data[pos + 8 : pos + 8 + n])
        pos += 12 + n
    rows = zlib.decompress(b"".join(packed))
    if any(rows[:: width + 1]):
        raise ValueError("only unfiltered rows are stored")
    return b"".join(rows[i + 1 : i + 1 + width] for i in range(0, len(rows), width + 1))


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def store(payload: bytes) -> bytes:
    return png_of(payload) if zlib.crc32(payload) & 1 else wav_of(payload)


def samples(data: bytes, kind: str) -> bytes:
    return {"audio/wav": wav_samples, "image/png": png_samples}[kind](data)


def sniff_media(df: DataFrame, content: str, declared: str, *, key: str) -> DataFrame:
    """One row a value: the corrected type, whether it was corrected, the object's length, and what was carved from inside."""
    source = df.select(key, F.col(content).cast("binary").alias("__data"), F.col(declared).alias("__declared"))
    schema = "kind string, corrected boolean, length long, carved array<struct<at:long,length:long,kind:string>>"
    types = [pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int64()), ("kind", pa.string())]))]

    def make():
        sniffer = Sniffer()

        def step(batch):
            rows = []
            for x, d in zip(batch.column(1), batch.column(2), strict=True):
                kind, corrected, n, inner = sniffer.sniff(x.as_py(), d.as_py())
                rows.append((kind, corrected, n, [{"at": a, "length": m, "kind": k} for a, m, k in inner]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [key, "kind", "corrected", "length", "carved"])

        return step

    return map_arrow(source, make, f"`{key}` {source.schema[0].dataType.simpleString()}, {schema}")


def store_and_read(docs: DataFrame, *, key: str = "doc_id", text: str = "text", declared: str = "audio/wav") -> DataFrame:
    """Stores each text as media under one declared type, sniffs the stored bytes, reads them back by the type found, and describes them."""
    source = docs.select(key, whole_text(text).alias("__text"))
    fields = [("n_bytes", "long", pa.int64()), ("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()), ("media_bytes", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string())]

    def make():
        sniffer = Sniffer()

        def one(raw: bytes):
            media = store(padded(raw))
            kind, corrected, n, inner = sniffer.sniff(media, declared)
            back = samples(media, kind)
            feature = f"{kind};corrected={int(corrected)};length={n};samples={len(back)};sum={zlib.adler32(back)};carved={','.join(f'{k}@{a}+{m}' for a, m, k in inner)}"
            return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature

        def step(batch):
            for part in pieces(batch, "__text"):
                rows = [one(x.as_buffer().to_pybytes()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f[2]) for c, f in zip(zip(*rows, strict=True), fields, strict=True))], [key, *(f[0] for f in fields)])

        return step

    return map_arrow(source, make, f"`{key}` {source.schema[0].dataType.simpleString()}, " + ", ".join(f"{a} {b}" for a, b, _ in fields))


def op4_media(spark, sf_dir: str) -> DataFrame:
    return store_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"))
