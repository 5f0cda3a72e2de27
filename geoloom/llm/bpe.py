"""Byte-level BPE encoding and decoding, in overlapping chunks.

A long text is cut into chunks that overlap. Each chunk is pre-tokenised and encoded on its own; its first
boundaries may be wrong, since a chunk can begin inside a pre-token, and those next to its end too. The
pattern never looks back, so from a boundary on that two neighbouring chunks share inside their overlap,
both give the same pre-tokens: there they are stitched. Where no boundary is shared (one pre-token spans
the overlap), the two chunks are joined and cut anew. Decoding concatenates the bytes of the ids.

Defined results: a null text is an empty one (no ids); equal texts give equal results, and rows that repeat
are all kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pieces, whole_text

#: Pre-tokens whose ids a worker remembers; the memory starts anew when it is full.
REMEMBERED = 300_000
#: Ends of pre-tokens nearer to a chunk's end than this are not trusted: the pattern looks ahead that far.
AHEAD = 3


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Codec:
    """Encodes pre-tokens by ranks, as tiktoken does, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        # The \s of the pattern is Unicode's White_Space; Python's holds four separators more.
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.piece = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.ids: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return self.find.findall(text)

    def id_bytes(self, tokens: list[str]) -> list[bytes]:
        """Each pre-token's ids as little-endian unsigned 32-bit integers."""
        known = self.ids
        if len(known) > REMEMBERED:
            known.clear()
        try:
            return [known[t] for t in tokens]
        except KeyError:
            for t in set(tokens).difference(known):
                known[t] = b"".join(i.to_bytes(4, "little") for i in self.piece(t.encode()))
            return [known[t] for t in tokens]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I").tolist()))


def boundaries(tokens: list[str], start: int) -> list[int]:
    out, at = [start], start
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


def stitched(text_of, chunks: list[tuple[int, int, list[str], list[bytes]]], codec: Codec) -> list[bytes]:
    """The id bytes of a text's pre-tokens from its chunks (start, end, pre-tokens, id bytes), in order.

    ``text_of(a, b)`` gives a span of the text, for chunks that have to be joined.
    """
    out: list[bytes] = []
    todo = list(reversed(chunks))
    start, end, tokens, ids = todo.pop()
    bounds, begin = boundaries(tokens, start), 0
    while todo:
        start2, end2, tokens2, ids2 = todo.pop()
        bounds2 = boundaries(tokens2, start2)
        trusted, own = set(bounds2), None
        for k in range(max(begin, bisect_left(bounds, start2)), len(bounds)):
            if bounds[k] > end - AHEAD:
                break
            if bounds[k] in trusted:
                own = k
                break
        if own is None:
            at = bounds[begin]
            tokens = codec.split(text_of(at, end2))
            ids, bounds, begin, end = codec.id_bytes(tokens), boundaries(tokens, at), 0, end2
            continue
        out += ids[begin:own]
        bounds, ids, begin, end = bounds2, ids2, bisect_left(bounds2, bounds[own]), end2
    return out + ids[begin:]


def encode_text(text: str, codec: Codec, chunk: int, overlap: int) -> list[bytes]:
    if len(text) <= chunk + overlap:
        return codec.id_bytes(codec.split(text))
    cut = []
    for a in range(0, len(text), chunk):
        b = min(len(text), a + chunk + overlap)
        tokens = codec.split(text[a:b])
        cut.append((a, b, tokens, codec.id_bytes(tokens)))
        if b == len(text):
            break
    return stitched(lambda a, b: text[a:b], cut, codec)


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(ids: bytes, codec: Codec) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, key: str = "doc_id", text: str = "text", chunk: int = 65_536, overlap: int = 1_024, keep_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a text: token count, digests of ids and decoded bytes, and the ids where ``keep_ids`` asks for them.

    The columns named in ``carry`` go along with their rows.

    Texts over ``chunk`` + ``overlap`` characters are cut by Spark into chunk rows, which any tasks encode, and
    stitched text by text; equal long texts are encoded once. The ranks (a fixed file) are broadcast.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    source = docs.select(F.col(key).alias("__key"), whole_text(text).alias("__text"), *carry)
    key_type = source.schema[0].dataType.simpleString()
    along = "".join(f", `{c}` {source.schema[c].dataType.simpleString()}" for c in carry)
    extra = ", ids binary" if keep_ids else ""

    def short():
        codec = Codec(ranks.value, pattern)

        def step(batch):
            for part in pieces(batch, "__text"):
                rows = []
                for x in part.column(1):
                    ids = b"".join(codec.id_bytes(codec.split(x.as_py())))
                    rows.append((*digests(ids, codec), *([ids] if keep_ids else ())))
                kinds = [pa.int64(), pa.string(), pa.string(), *([pa.binary()] if keep_ids else ())]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["__key", *carry, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else ())])

        return step

    def cut():
        codec = Codec(ranks.value, pattern)

        def step(batch):
            rows = []
            for d, a, x in zip(*(batch.column(i) for i in range(3)), strict=True):
                tokens = codec.split(x.as_py())
                ids = codec.id_bytes(tokens)
                sizes = [len(t) for t in tokens]
                rows.append((d.as_py(), a.as_py(), x.as_py(), sizes, b"".join(ids), [len(i) for i in ids]))
            yield pa.RecordBatch.from_pylist([dict(zip(("d", "a", "part", "sizes", "ids", "id_sizes"), r, strict=True)) for r in rows], schema=CUT)

        return step

    def stitch(table: pa.Table) -> pa.Table:
        codec = Codec(ranks.value, pattern)
        rows = sorted(table.to_pylist(), key=lambda r: r["a"])
        chunks = []
        for r in rows:
            tokens, ids, at, pos = [], [], 0, 0
            for n, m in zip(r["sizes"], r["id_sizes"], strict=True):
                tokens.append(r["part"][at : at + n])
                ids.append(r["ids"][pos : pos + m])
                at, pos = at + n, pos + m
            chunks.append((r["a"], r["a"] + len(r["part"]), tokens, ids))

        def text_of(a, b):
            # a span over chunks: each gives what the ones before have not
            out, at = [], a
            for s, e, _, _ in chunks:
                part = rows[s // chunk]["part"]
                if at < min(e, b):
                    out.append(part[at - s : min(e, b) - s])
                    at = min(e, b)
            return "".join(out)

        ids = b"".join(stitched(text_of, chunks, codec))
        got = dict(zip(("d", "n_tokens", "ids_sha256", "decoded_sha256"), (rows[0]["d"], *digests(ids, codec)), strict=True)) | ({"ids": ids} if keep_ids else {})
        return pa.Table.from_pylist([got])

    limit = chunk + overlap
    done = map_arrow(source.where(F.length("__text") <= limit), short, f"__key {key_type}{along}, {SCHEMA}{extra}")
    long = source.where(F.length("__text") > limit).withColumn("d", F.sha2("__text", 256))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("__text") - overlap - 1), F.lit(chunk))
    rows = long.dropDuplicates(["d"]).select("d", "__text", F.explode(starts).alias("a")).select("d", F.col("a").cast("long"), F.substring("__text", F.col("a") + 1, F.lit(limit)).alias("part"))
    encoded = map_arrow(rows.repartition("d", "a"), cut, "d string, a long, part string, sizes array<int>, ids binary, id_sizes array<int>")
    joined = encoded.groupBy("d").applyInArrow(stitch, f"d string, {SCHEMA}{extra}")
    whole = long.select("__key", *carry, "d").join(joined, "d").drop("d")
    return done.unionByName(whole.select(done.columns)).withColumnRenamed("__key", key)


CUT = pa.schema([("d", pa.string()), ("a", pa.int64()), ("part", pa.string()), ("sizes", pa.list_(pa.int32())), ("ids", pa.binary()), ("id_sizes", pa.list_(pa.int32()))])


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
