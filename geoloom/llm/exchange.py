"""Shards of texts, and questions about keys that are asked across all shards.

A table is packed once into shards (rows of compressed Arrow batches in a written table). A shard asks
about its distinct 64-bit keys: sorted, cut into buckets by range, delta-coded. A bucket sees every
shard's keys of its range and answers each shard in the order of its keys. Keys are hashes, so buckets
are even whatever repeats; a key that a third of all rows hold counts once a shard.

Shards and buckets both grow with the data, and a row for each pair of them would grow with its square. Beyond ``DIRECT``
buckets the exchange has two levels: shards send to coarse ranges of buckets, groups of shards are merged there, and
only the merged lists go on to single buckets; answers take the same way back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

PACKED = "shard long, rows long, bytes long, blob binary"
ASKED = "bucket int, shard long, blob binary"
ANSWERED = "shard long, bucket int, blob binary"
#: Text bytes a shard, about; keys a bucket, about.
SHARD_BYTES, BUCKET_KEYS = 4 << 20, 2 << 20
#: Bytes that array passes over texts take at a time.
CACHED = 1 << 17

#: Buckets up to which each shard writes to each of them.
DIRECT = 1024

U64 = np.uint64
MULTIPLIERS = [U64(m) for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit integers."""
    for m in MULTIPLIERS:
        x = (x ^ x >> U64(33)) * m
    return x ^ x >> U64(33)


#: Fixed by a rule: a random-looking 64-bit value for each byte, and an odd base.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


#: Powers that a worker keeps, for arrays of twice a shard's size at most.
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    kept = _POWERS.get(base)
    if kept is not None and len(kept) >= n:
        return kept[:n]
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if n <= 2 * SHARD_BYTES:
        _POWERS[base] = out
    return out


class Spans:
    """Hashes of byte spans of one array, from a prefix sum."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        power = powers(BASE, len(data))
        for at in range(0, len(data), CACHED):  # pieces that stay in the processor's cache
            end = min(at + CACHED, len(data))
            part = BYTE_VALUE[data[at:end]] * power[at:end]
            part[:1] += self.sums[at]
            np.cumsum(part, out=self.sums[at + 1 : end + 1])
        self.back = powers(BASE_INVERSE, len(data) + 1)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column in one array, and each row's bounds in it; null rows are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64))


#: Bytes that separate words: blanks, tabs and line ends.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def words_in(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of the rows with these bounds; no word crosses a row's end."""
    word = ~BLANK[data]
    first, last = word.copy(), word.copy()
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def to_blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as source:
        return source.read_next_batch()


def pack(df: DataFrame, text: str, size: int = SHARD_BYTES) -> DataFrame:
    """Shards of ``df``; numbered by task, so the result has to be written before it is read twice."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch, text, size) if batch.num_rows else ():
                total = sum(len(x.as_buffer()) for x in part.column(text) if x.is_valid)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part.num_rows]), pa.array([total]), pa.array([to_blob(part)], pa.binary())], ["shard", "rows", "bytes", "blob"])
                number += 1

    return df.mapInArrow(run, PACKED)


def squeeze(values: np.ndarray) -> bytes:
    """Compresses integers by byte planes."""
    width = values.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def unsqueeze(blob: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(width, -1).T).view(dtype).ravel()


def asked(shard: int, keys: np.ndarray, bits: int, buckets: int, counts: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes]]:
    """Bucket, shard and coded keys. ``keys``: sorted, distinct, under 2 ** ``bits``; ``counts`` (up to 65535) may go with them."""
    cuts = np.searchsorted(keys, edges(bits, buckets))
    for b in range(buckets):
        part = keys[cuts[b] : cuts[b + 1]]
        if len(part):
            deltas = squeeze(np.diff(part, prepend=U64(0)))
            rest = b"" if counts is None else squeeze(counts[cuts[b] : cuts[b + 1]].astype(np.uint16))
            yield b, shard, len(deltas).to_bytes(4, "little") + deltas + rest


def edges(bits: int, buckets: int) -> np.ndarray:
    """First keys of the buckets, and the end of the last one; every ``coarse``-th one of ``coarse`` squared is an edge of ``coarse`` buckets too."""
    return np.array([min(-(-(b << bits) // buckets), (1 << 64) - 1) for b in range(buckets)] + [(1 << 64) - 1], np.uint64)


def keys_of(blob: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    n = int.from_bytes(blob[:4], "little")
    keys = np.cumsum(unsqueeze(blob[4 : 4 + n], np.uint64), dtype=np.uint64)
    return keys, unsqueeze(blob[4 + n :], np.uint16) if len(blob) > 4 + n else None


def ask(rows: DataFrame, make: Callable, bits: int, buckets: int, *columns: str) -> DataFrame:
    """Questions of all rows: ``make`` gives, once a task, a function of a row's values that returns sorted distinct keys (and counts)."""

    def run(batches):
        keys_in = make()
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("shard", *columns)), strict=True):
                shard, *values = (x.as_py() for x in row)
                keys, counts = keys_in(*values)
                out = list(asked(shard, keys, bits, buckets, counts))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "shard", "blob"])

    return rows.select("shard", *columns).mapInArrow(run, ASKED)


def merged(lists: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted lists of distinct keys (with counts or without): all keys, sorted, how much each counts (a list without counts: 1), and
    where each key of each list stands among them."""
    keys = np.concatenate([k for k, _ in lists])
    counts = np.concatenate([np.ones(len(k), np.int64) if c is None else c.astype(np.int64) for k, c in lists])
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64), place


def told_blobs(found: np.ndarray, lists: list, counted: bool) -> list[bytes]:
    out, at = [], 0
    for k, _ in lists:
        part = found[at : at + len(k)]
        out.append(squeeze(part) if counted else zstandard.compress(np.packbits(part).tobytes(), 1))
        at += len(k)
    return out


def answer(questions: DataFrame) -> DataFrame:
    """For each shard and bucket: a bit a key (do several shards have it?), or the sum of its counts (65535 at most) where counts were sent."""

    def run(table: pa.Table) -> pa.Table:
        shards = table.column("shard").to_pylist()
        lists = [keys_of(x.as_py()) for x in table.column("blob")]
        bucket = table.column("bucket")[0].as_py()
        counted = lists[0][1] is not None
        _, counts, place = merged(lists)
        found = np.minimum(counts, 65535).astype(np.uint16)[place] if counted else (counts > 1)[place]
        return pa.table({"shard": pa.array(shards, pa.int64()), "bucket": pa.array([bucket] * len(shards), pa.int32()), "blob": pa.array(told_blobs(found, lists, counted), pa.binary())})

    return questions.groupBy("bucket").applyInArrow(run, ANSWERED)


def two_levels(stages, name: str, questions: DataFrame, bits: int, coarse: int, shards: int) -> DataFrame:
    """``answer`` for questions to ``coarse`` ranges, each of ``coarse`` buckets. About ``coarse`` shards make a group, whose lists in a range are
    merged to one; rows are shards x coarse on both levels. The answers stand for the ranges."""
    groups = max(1, -(-shards // coarse))
    asked = stages.keep(questions.withColumn("grp", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int")), name)
    fine = coarse * coarse

    def merge(table: pa.Table) -> pa.Table:
        lists = [keys_of(x.as_py()) for x in table.column("blob")]
        counted = lists[0][1] is not None
        keys, counts, _ = merged(lists)
        # the count of a list without counts tells in the next step whether one or several shards of the group have a key
        out = list(asked_range(table.column("grp")[0].as_py(), keys, bits, fine, np.minimum(counts, 65535 if counted else 2), table.column("bucket")[0].as_py(), coarse))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("bucket", "shard", "blob"), zip(*out, strict=True) if out else ([], [], []), (pa.int32(), pa.int64(), pa.binary()), strict=True)})

    above = asked.groupBy("bucket", "grp").applyInArrow(merge, ASKED)
    told = answer(above).select(F.col("shard").cast("int").alias("grp"), F.floor(F.col("bucket") / coarse).cast("int").alias("bucket"), F.col("bucket").alias("fine"), F.col("blob").alias("told"))

    def split(key, mine: pa.Table, told: pa.Table) -> pa.Table:
        lists = [keys_of(x.as_py()) for x in mine.column("blob")]
        counted = lists[0][1] is not None
        keys, _, place = merged(lists)
        answers = {b: x.as_py() for b, x in zip(told.column("fine").to_pylist(), told.column("told"), strict=True)}
        counts = counts_told(keys, answers, bits, fine)
        found = counts[place] if counted else (counts > 1)[place]
        return pa.table({"shard": mine.column("shard"), "bucket": mine.column("bucket"), "blob": pa.array(told_blobs(found, lists, counted), pa.binary())})

    return asked.groupBy("bucket", "grp").cogroup(told.groupBy("bucket", "grp")).applyInArrow(split, ANSWERED)


def asked_range(group: int, keys: np.ndarray, bits: int, buckets: int, counts: np.ndarray, part: int, coarse: int) -> Iterator[tuple[int, int, bytes]]:
    """``asked`` for the buckets of one coarse range only."""
    ends = edges(bits, buckets)[part * coarse : (part + 1) * coarse + 1]
    cuts = np.searchsorted(keys, ends)
    for j in range(coarse):
        one = keys[cuts[j] : cuts[j + 1]]
        if len(one):
            deltas = squeeze(np.diff(one, prepend=U64(0)))
            yield part * coarse + j, group, len(deltas).to_bytes(4, "little") + deltas + squeeze(counts[cuts[j] : cuts[j + 1]].astype(np.uint16))


def ranges(buckets: int) -> int:
    """The ranges of keys that answers stand for: the buckets, or beyond ``DIRECT`` coarse ranges of them."""
    return buckets if buckets <= DIRECT else math.ceil(math.sqrt(buckets))


def told_by(stages, name: str, rows: DataFrame, make: Callable, bits: int, buckets: int, *columns: str) -> DataFrame:
    """The answers to the questions of all ``rows`` (``ask``), by ``ranges(buckets)``. The table ``name`` is written on the way where there are two levels."""
    questions = ask(rows, make, bits, ranges(buckets), *columns)
    return answer(questions) if buckets <= DIRECT else two_levels(stages, name, questions, bits, ranges(buckets), rows.count())


def bits_told(keys: np.ndarray, answers: dict[int, bytes], bits: int, buckets: int) -> np.ndarray:
    """The bits that all buckets told about a shard's keys."""
    cuts = np.searchsorted(keys, edges(bits, buckets))
    out = np.zeros(len(keys), bool)
    for b, blob in answers.items():
        out[cuts[b] : cuts[b + 1]] = np.unpackbits(np.frombuffer(zstandard.decompress(blob), np.uint8), count=cuts[b + 1] - cuts[b])
    return out


def counts_told(keys: np.ndarray, answers: dict[int, bytes], bits: int, buckets: int) -> np.ndarray:
    cuts = np.searchsorted(keys, edges(bits, buckets))
    out = np.zeros(len(keys), np.uint16)
    for b, blob in answers.items():
        out[cuts[b] : cuts[b + 1]] = unsqueeze(blob, np.uint16)
    return out


def with_answers(rows: DataFrame, answers: DataFrame, fn: Callable[[int, list[bytes], dict[int, bytes]], Iterator[pa.RecordBatch]], schema: str, *columns: str) -> DataFrame:
    """``fn(shard, blobs, answers by bucket)`` for each shard. ``columns``: the blobs of ``rows``, one row a shard."""
    parts = [rows.select("shard", F.lit(-1 - i).alias("bucket"), F.col(c).alias("blob")) for i, c in enumerate(columns)]
    for part in (*parts[1:], answers.select("shard", "bucket", "blob")):
        parts[0] = parts[0].unionByName(part)

    def run(table: pa.Table) -> pa.Table:
        blobs: list = [None] * len(columns)
        told = {}
        shard = table.column("shard")[0].as_py()
        for b, x in zip(table.column("bucket").to_pylist(), table.column("blob"), strict=True):
            if b < 0:
                blobs[-1 - b] = x.as_py()
            else:
                told[b] = x.as_py()
        return pa.Table.from_batches(list(fn(shard, blobs, told)), arrow_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    return parts[0].groupBy("shard").applyInArrow(run, schema)


def sized(total_bytes: int, per_key: float) -> tuple[int, int]:
    """Bits that tell keys apart well enough for a filter (one in 500 by chance), and buckets, for texts of so many bytes."""
    n = max(1024, int(total_bytes / per_key))
    return min(64, n.bit_length() + 9), max(12, -(-n // BUCKET_KEYS))
