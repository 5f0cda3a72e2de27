"""Removal of repeated passages by hash-named prefix doubling over content-defined phrases.

This stands in for a merge of shard Burrows-Wheeler transforms: no transform or rank is built, no suffix is
sorted, nothing is interleaved and no common prefix is computed. Every byte covered by a string of ``least``
bytes that also starts anywhere else is removed. Texts are cut into phrases at window minima of hashed
8-grams, so equal passages are cut alike, whatever stands around them. A suffix is named by a hash, its
block, of its first h phrases; a shard holds its suffixes in text order.

In a round each block is paired with the block h phrases on in the text, so that h doubles, and all shards
are asked which of the new blocks they share: a block that only one suffix has has no repeat, and is
followed no further. Rounds end when the blocks span ``least`` bytes.

A second rule may go with the first: passages of ``words`` words that stand in another row too, whatever their bytes. Windows
of so many words whose inner phrases are all shared (or that are too short to have any) are compared as
strings, by one more question among the same keys.

From the shared blocks follows, for each byte, whether the string of ``least`` bytes that starts there is
repeated for sure (the phrases around it are one shared interval), certainly not (the phrases inside it are
not), or open by some bytes at the ends of a repeat. The open ones are settled by one question about the
strings themselves.

Hashes have 64 bits, those of strings 63; two different strings among n are taken for equal with probability n * n / 2 ** 64 at most.

Defined results: null and empty texts and texts under ``least`` bytes stay as they are; equal texts of ``least``
bytes or more are removed whole, each of them; rows that repeat are equal texts; words are runs of bytes other
than blanks, and a text of fewer than ``words`` has no passage; an empty table gives an empty result; other columns
travel along, but for those with a result column's name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Stages
from .exchange import CACHED, U64, Spans, bits_told, counts_told, from_blob, mix, pack, ranges, sized, squeeze, text_bytes, to_blob, told_by, unsqueeze, with_answers, words_in

LEAST = 400
#: Words of a passage that may stand in one row only; every passage of over 50 words holds one of so many.
WORDS = 50
#: Window and gram of the cuts; a phrase has WINDOW bytes at most.
WINDOW, GRAM = 56, 8
#: Where a string of LEAST bytes is repeated, cuts from its byte AHEAD on, up to BEHIND before its end, are equal.
AHEAD, BEHIND = WINDOW - 1, WINDOW + GRAM - 2


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbours, by blocks with running values from both ends."""
    n = len(values)
    fill = np.full(-n % width, values[-1] if n else 0, values.dtype)
    blocks = np.concatenate((values, fill)).reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1 : n])


def cuts_of(data: np.ndarray) -> np.ndarray:
    """Flags of the bytes where a phrase begins: minima (all of them, where equal) of some window."""
    flags = np.zeros(len(data), bool)
    around = WINDOW + GRAM  # what lies further off does not matter for a cut
    for at in range(0, len(data), CACHED):
        begin, end = max(0, at - around), min(len(data), at + CACHED + around)
        flags[at : at + CACHED] = cuts_in(data[begin:end])[at - begin : at - begin + CACHED]
    return flags


def cuts_in(data: np.ndarray) -> np.ndarray:
    flags = np.zeros(len(data), bool)
    if len(data) < 2 * WINDOW + GRAM:
        return flags
    grams = np.ndarray((len(data) - GRAM + 1,), "<u8", np.ascontiguousarray(data).tobytes(), 0, (1,))
    values = ((grams * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32)
    least = sliding(values, WINDOW, np.minimum)
    most = sliding(least, WINDOW, np.maximum)  # of the windows that hold a place
    inner = slice(WINDOW - 1, WINDOW - 1 + len(most))
    flags[inner] = values[inner] == most
    return flags


class Parse:
    """The phrases of some texts in one array. A row's first and last phrase touch its ends and match nothing."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        flags = cuts_of(data)
        inner = bounds[:-1][bounds[:-1] < len(data)]
        flags[inner] = True
        self.starts = np.flatnonzero(flags)
        self.ends = np.append(self.starts[1:], len(data)) if len(self.starts) else self.starts
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        self.whole = ~(edge[self.starts] | edge[self.ends]) if len(self.starts) else np.zeros(0, bool)
        self.data, self.bounds = data, bounds

    def symbols(self) -> np.ndarray:
        return np.where(self.whole, Spans(self.data).hash(self.starts, self.ends), U64(0))


def parse(batch: pa.RecordBatch, text: str) -> Parse:
    return Parse(*text_bytes(batch.column(text)))


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Names of the blocks of pairs of blocks; 0 where one has none."""
    both = mix(first * U64(0xD6E8FEB86659FD93) + mix(second))
    return np.where((first != 0) & (second != 0), both, U64(0))


def whole_keys(blocks: np.ndarray, shift) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of the blocks that are not 0, how often this shard has each, and each block's key (past the last one: none)."""
    there = blocks != 0
    keys, back, counts = np.unique(blocks[there] >> shift, return_inverse=True, return_counts=True)
    place = np.full(len(blocks), len(keys))
    place[there] = back
    return keys, counts, place


def shared_blocks(blocks: np.ndarray, told, bits: int, buckets: int) -> np.ndarray:
    """Which suffixes' blocks several suffixes have, here or in other shards."""
    keys, counts, place = whole_keys(blocks, U64(64 - bits))
    return np.append(bits_told(keys, told, bits, buckets) | (counts > 1), False)[place]


def word_windows(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of every window of so many words that lies in one row."""
    starts, ends = words_in(data, bounds)
    rows = np.searchsorted(bounds, starts, "right") - 1
    if len(starts) < words:
        return starts[:0], ends[:0], rows[:0]
    inside = np.flatnonzero(rows[words - 1 :] == rows[: len(rows) - words + 1])
    return starts[inside], ends[inside + words - 1], rows[inside]


def open_windows(p: Parse, shared: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the windows of so many words whose inner phrases are all shared, and the rows of all windows; a window without inner phrases is open too."""
    s, e, row = word_windows(p.data, p.bounds, words)
    alone = np.concatenate(([0], np.cumsum(~shared)))
    first = np.searchsorted(p.starts, s + AHEAD - 1, "right")
    last = np.maximum(np.searchsorted(p.starts, e - BEHIND - 1, "right") - 1, first)
    return alone[last] == alone[first], row


def in_several_rows(names: np.ndarray, rows: np.ndarray, told, buckets: int, keys: np.ndarray) -> np.ndarray:
    """Which names several rows have, here or in other shards; ``keys`` are all that the shard asked about."""
    if not len(names):
        return np.zeros(0, bool)
    order = np.lexsort((rows, names))
    n, r = names[order], rows[order]
    new = np.concatenate(([True], n[1:] != n[:-1]))
    many = np.maximum.reduceat(r, np.flatnonzero(new)) != np.minimum.reduceat(r, np.flatnonzero(new))
    out = np.empty(len(names), bool)
    out[order] = many[np.cumsum(new) - 1]
    return out | bits_told(keys, told, 64, buckets)[np.searchsorted(keys, names)]


def covered(first: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that spans (sorted by start) cover in rows; spans that touch are one run."""
    if not len(first):
        return first, end
    reach = np.maximum.accumulate(end)
    row = np.searchsorted(bounds, first, "right")
    gap = np.flatnonzero((first[1:] > reach[:-1]) | (row[1:] != row[:-1])) + 1
    return first[np.concatenate(([0], gap))], reach[np.append(gap, len(first)) - 1]


def stepped(blocks: np.ndarray, h: int) -> np.ndarray:
    """Each suffix's block of 2h phrases: the LF step back by h from the block that follows."""
    follows = np.zeros_like(blocks)
    follows[: max(0, len(blocks) - h)] = blocks[h:]
    return joined(blocks, follows)


def levels(symbols: np.ndarray, masks: list[np.ndarray]) -> list[np.ndarray]:
    """Blocks of 1, 2, 4 ... phrases; 0 where only one suffix has the block."""
    out = [np.where(masks[0], symbols, U64(0))]
    for k, mask in enumerate(masks[1:]):
        out.append(np.where(mask, stepped(out[-1], 1 << k), U64(0)))
    return out


def to_state(symbols: np.ndarray, sizes: np.ndarray, masks: list[np.ndarray], bounds: np.ndarray) -> bytes:
    """What a shard remembers between rounds: phrases (0: none that is shared), sizes, a bit a round, and rows' bounds."""
    shared = masks[0]
    columns = [squeeze(symbols[shared]), squeeze(sizes.astype(np.uint32)), squeeze(bounds.astype(np.int64)), *(squeeze(np.packbits(m)) for m in masks)]
    return pa.RecordBatch.from_arrays([pa.array(columns, pa.binary())], ["x"]).serialize().to_pybytes()


STATE = pa.schema([("x", pa.binary())])


def from_state(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    columns = pa.ipc.read_record_batch(pa.py_buffer(blob), STATE).column(0).to_pylist()
    sizes, bounds = unsqueeze(columns[1], np.uint32).astype(np.int64), unsqueeze(columns[2], np.int64)
    masks = [np.unpackbits(unsqueeze(c, np.uint8), count=len(sizes)).astype(bool) for c in columns[3:]]
    symbols = np.zeros(len(sizes), np.uint64)
    symbols[masks[0]] = unsqueeze(columns[0], np.uint64)
    return symbols, sizes, masks, bounds


def candidate_rows(p: Parse, shared: np.ndarray, least: int) -> np.ndarray:
    """Rows with a run of shared phrases as long as those that lie inside any repeated string of ``least`` bytes, or longer."""
    out = np.zeros(len(p.bounds) - 1, bool)
    if not len(p.starts):
        return out
    change = np.diff(np.concatenate(([0], shared.astype(np.int8), [0])))
    first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1) - 1
    long = p.ends[last] - p.starts[first] >= least - AHEAD - BEHIND - 2 * WINDOW
    out[np.searchsorted(p.bounds, p.starts[first[long]], "right") - 1] = True
    return out


def window_states(sizes: np.ndarray, bounds: np.ndarray, blocks: list[np.ndarray], least: int):
    """Stretches of neighbouring strings of ``least`` bytes that have the same phrases inside, and the same around them, where the
    inner phrases are shared: first start, number of starts, name of the inner phrases, name of the phrases around (0: not shared), and the
    phrase that the strings begin in."""
    none = np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1] if len(sizes) else none
    table = np.stack(blocks) if blocks else np.zeros((1, 0), np.uint64)
    top = len(blocks) - 1
    # a stretch ends where a phrase's start comes to one of four places in the string, and with the row
    offsets = (AHEAD - 1, least - BEHIND - 1, 0, least - 1)
    first = np.unique(np.concatenate([starts - k for k in offsets] + [bounds[:-1]])).astype(np.int64)
    first = first[(first >= 0) & (first < bounds[-1])]
    row = np.searchsorted(bounds, first, "right") - 1
    count = np.minimum(np.append(first[1:], bounds[-1]), bounds[row + 1] - least + 1) - first
    first, count = first[count > 0], count[count > 0]
    if not len(first) or not len(sizes):
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none

    def interval(first, last):
        """The name of phrases first to last - 1, from two overlapping blocks that cover them; 0 if one is not shared."""
        n = last - first
        level = np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), top)
        width = 1 << level
        end = len(sizes)
        a = table[level, np.minimum(first, end - 1)]
        b = table[level, np.clip(last - width, 0, end - 1)]
        # no suffix has a shared block of more phrases than the top level's two cover
        return np.where((n >= 1) & (n <= 2 * width) & (a != 0) & (b != 0), mix(joined(a, b) + n.astype(np.uint64)) | U64(1), U64(0))

    at = [np.searchsorted(starts, first + k, "right") for k in offsets]  # phrases that begin at or before a byte
    inner = interval(at[0], at[1] - 1)
    kept = np.flatnonzero(inner)
    around = interval(at[2][kept] - 1, np.minimum(at[3][kept], len(sizes)))
    return first[kept], count[kept], inner[kept], around, at[2][kept] - 1


def places_of(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All starts of stretches."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(int(count.sum()))


def fields_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def dedupe(docs: DataFrame, *, text: str = "text", least: int = LEAST, words: int | None = None, cut_passages: bool = False, as_text: bool = False) -> DataFrame:
    """``docs`` with ``n_removed`` (bytes), ``n_spans`` (maximal removed runs) and ``kept``: the remaining bytes, or with
    ``as_text`` a string of them without the bytes of characters that were cut apart.

    ``words``: counts in ``n_passage_words`` the words covered by passages of so many words that stand in another row too;
    ``cut_passages``: they are removed like the repeated strings of ``least`` bytes."""
    if least < 2 * WINDOW + AHEAD + BEHIND:
        raise ValueError("strings must be longer than the windows of the cuts")
    spark, stages = docs.sparkSession, Stages(docs.sparkSession, "repeats")
    docs = docs.drop("n_removed", "n_spans", "n_passage_words", "kept")
    result = f"{fields_of(docs)}, n_removed long, n_spans long, n_passage_words long, kept {'string' if as_text else 'binary'}"
    result_schema = to_arrow_schema(spark.createDataFrame([], result).schema)
    shards = stages.keep(pack(docs, text), "shards")
    total = shards.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits, buckets = sized(total, WINDOW / 2)
    parts = ranges(buckets)
    shift = U64(64 - bits)

    def done(batch, removed, runs, passages, raw):
        kept = [x.decode("utf-8", "ignore") for x in raw] if as_text else raw
        counts = [pa.array(x, pa.int64()) for x in (removed, runs, passages)]
        return pa.RecordBatch.from_arrays([*batch.columns, *counts, pa.array(kept, result_schema.field("kept").type)], schema=result_schema)

    def first_keys():
        def keys(blob):
            symbols = parse(from_blob(blob), text).symbols()
            return whole_keys(symbols, shift)[0], None

        return keys

    def first_told(shard, blobs, told):
        batch = from_blob(blobs[0])
        p = parse(batch, text)
        symbols = p.symbols()
        shared = shared_blocks(symbols, told, bits, parts)
        rows = candidate_rows(p, shared, least)
        if words:
            open_, of = open_windows(p, shared, words)
            rows[of[open_]] = True
        kinds, out = [], []
        if not rows.all():
            part = batch.filter(pa.array(~rows))
            raw = [(x.as_py() or "").encode() for x in part.column(text)]
            none = [0] * len(raw)
            kinds.append("done")
            out.append(to_blob(done(part, none, none, none, raw)))
        if rows.any():
            part = batch.filter(pa.array(rows))
            q = parse(part, text)
            # cuts next to a row's ends hang on its neighbours, which have changed; no string's inner phrases touch them
            again = q.symbols()
            mask = np.isin(again, symbols[shared])
            kinds += ["text", "state"]
            out += [to_blob(part), to_state(again, q.ends - q.starts, [mask], q.bounds)]
            if words:
                kinds.append("windows")
                out.append(squeeze(np.packbits(open_windows(q, mask, words)[0])))
        yield pa.RecordBatch.from_arrays([pa.array([shard] * len(kinds), pa.int64()), pa.array(kinds, pa.string()), pa.array(out, pa.binary())], ["shard", "kind", "blob"])

    told = told_by(stages, "asked", shards, first_keys, bits, buckets, "blob")
    first = with_answers(shards, told, first_told, "shard long, kind string, blob binary", "blob")
    kept = stages.keep(first, "first", by="kind")
    stages.drop("shards", "asked")
    clean, texts, state, windows_open = (kept.where(F.col("kind") == k).select("shard", "blob") for k in ("done", "text", "state", "windows"))

    # Rounds: blocks of 2, 4, 8 ... phrases.
    h, at = 1, 0
    while True:

        def round_keys(h=h):
            def keys(blob):
                symbols, _, masks, _ = from_state(blob)
                return whole_keys(stepped(levels(symbols, masks)[-1], h), shift)[0], None

            return keys

        def round_told(shard, blobs, told, h=h):
            symbols, sizes, masks, bounds = from_state(blobs[0])
            blocks = levels(symbols, masks)[-1]
            longer = stepped(blocks, h)
            mask = shared_blocks(longer, told, bits, parts)
            at = np.concatenate(([0], np.cumsum(sizes)))
            spans = at[np.minimum(np.arange(len(sizes)) + 4 * h, len(sizes))] - at[:-1]
            more = int((mask & (spans <= least + 2 * WINDOW)).sum())
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([to_state(symbols, sizes, [*masks, mask], bounds)], pa.binary()), pa.array([more])], ["shard", "blob", "more"])

        told = told_by(stages, f"asked-{at}", state, round_keys, bits, buckets, "blob")
        state = stages.keep(with_answers(state, told, round_told, "shard long, blob binary, more long", "blob"), f"round-{at}")
        stages.drop(f"asked-{at}", *([f"round-{at - 1}"] if at else []))
        more = state.agg(F.coalesce(F.sum("more"), F.lit(0))).first()[0]
        h, at = 2 * h, at + 1
        if not more:
            break

    # Which strings lie in one shared interval? The others whose inner phrases are shared are open.
    def windows(blob):
        symbols, sizes, masks, bounds = from_state(blob)
        return *window_states(sizes, bounds, levels(symbols, masks), least), int(bounds[-1])

    def runs_of(names, phrase):
        """Names, once for each phrase that strings of that name begin in."""
        if not len(names):
            return names
        return names[np.concatenate(([True], (names[1:] != names[:-1]) | (phrase[1:] != phrase[:-1])))]

    def around_keys():
        def keys(blob):
            _, _, _, around, phrase, _ = windows(blob)
            return whole_keys(runs_of(around, phrase), U64(0))[0], None

        return keys

    def around_told(shard, blobs, told):
        first, count, _, around, phrase, total = windows(blobs[0])
        keys, counts, _ = whole_keys(runs_of(around, phrase), U64(0))
        several = np.append(bits_told(keys, told, 64, parts) | (counts > 1), False)
        sure = np.zeros(total, bool)
        found = several[np.searchsorted(keys, around)] & (around != 0)
        sure[places_of(first[found], count[found])] = True
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array(blobs, pa.binary()), pa.array([squeeze(np.packbits(sure))], pa.binary())], ["shard", "state", "sure"])

    told = told_by(stages, "asked-around", state, around_keys, 64, buckets, "blob")
    sure = stages.keep(with_answers(state, told, around_told, "shard long, state binary, sure binary", "blob"), "sure")
    stages.drop(f"round-{at - 1}", "asked-around")

    # Open strings are compared with each other and with the sure ones that have the inner phrases of an open one.
    def inner_names(state_blob, sure_blob):
        first, count, inner, _, _, total = windows(state_blob)
        sure = np.unpackbits(unsqueeze(sure_blob, np.uint8), count=total).astype(bool)
        certain = sure[first]  # the strings of a stretch are sure together
        keys, place = np.unique(inner, return_inverse=True)
        return first, count, keys, place, certain, np.bincount(place, weights=~certain, minlength=len(keys)), sure

    def inner_keys():
        def keys(state_blob, sure_blob):
            _, _, keys, _, _, opened, _ = inner_names(state_blob, sure_blob)
            return keys, np.minimum(opened, 65535)

        return keys

    def inner_told(shard, blobs, told):
        first, count, keys, place, certain, _, sure = inner_names(*blobs)
        open_ = ~certain | (counts_told(keys, told, 64, parts)[place] > 0) if len(first) else certain
        flags = np.stack([sure, np.zeros(len(sure), bool)])
        flags[1, places_of(first[open_], count[open_])] = True
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([squeeze(np.packbits(flags))], pa.binary())], ["shard", "blob"])

    told = told_by(stages, "asked-inner", sure, inner_keys, 64, buckets, "state", "sure")
    flags = stages.keep(with_answers(sure, told, inner_told, "shard long, blob binary", "state", "sure"), "flags")
    stages.drop("sure", "asked-inner")
    both = texts.select("shard", F.col("blob").alias("texts")).join(flags.select("shard", F.col("blob").alias("flags")), "shard")
    both = both.join(windows_open.select("shard", F.col("blob").alias("windows")), "shard", "left")
    both = stages.keep(both, "both")
    stages.drop("flags", "first/kind=text", "first/kind=state", "first/kind=windows")

    def strings(texts_blob, flags_blob, windows_blob):
        data, bounds = text_bytes(from_blob(texts_blob).column(text))
        sure, open_ = np.unpackbits(unsqueeze(flags_blob, np.uint8), count=2 * len(data)).reshape(2, -1).astype(bool)
        s = np.flatnonzero(open_)
        spans = Spans(data)
        names = spans.hash(s, s + least) | U64(1) if len(s) else np.zeros(0, np.uint64)
        passages = [np.zeros(0, np.int64)] * 3
        if windows_blob is not None:
            passages = word_windows(data, bounds, words)
            chosen = np.unpackbits(unsqueeze(windows_blob, np.uint8), count=len(passages[0])).astype(bool)
            passages = [x[chosen] for x in passages]
        # even names for passages, odd ones for strings
        named = spans.hash(passages[0], passages[1]) & ~U64(1) if len(passages[0]) else np.zeros(0, np.uint64)
        return data, bounds, np.flatnonzero(sure), s, names, passages, named

    def open_keys():
        def keys(*blobs):
            _, _, _, _, names, _, named = strings(*blobs)
            return np.unique(np.concatenate((names, named))), None

        return keys

    def open_told(shard, blobs, told):
        batch = from_blob(blobs[0])
        data, bounds, sure, s, names, (a, b, row), named = strings(*blobs)
        keys, counts = np.unique(np.concatenate((names, named)), return_counts=True)
        if len(s):
            s = s[(bits_told(keys, told, 64, parts) | (counts > 1))[np.searchsorted(keys, names)]]
        found = in_several_rows(named, row, told, parts, keys)
        a, b = covered(a[found], b[found], bounds)
        starts = np.union1d(sure, s)
        begin, end = covered(starts, starts + least, bounds)
        n_words = np.zeros(len(data) + 1, np.int64)
        if len(a):
            n_words[words_in(data, bounds)[0]] = 1
            n_words = np.concatenate(([0], np.cumsum(n_words)))
        if cut_passages and len(a):
            begin, end = np.concatenate((begin, a)), np.concatenate((end, b))
            order = np.argsort(begin, kind="stable")
            begin, end = covered(begin[order], end[order], bounds)
        cut, seen = np.searchsorted(begin, bounds), np.searchsorted(a, bounds)
        removed, runs, passages, left = [], [], [], []
        for i in range(batch.num_rows):
            at, pieces = int(bounds[i]), []
            spans = list(zip(begin[cut[i] : cut[i + 1]].tolist(), end[cut[i] : cut[i + 1]].tolist(), strict=True))
            for x, y in spans:
                pieces.append(data[at:x].tobytes())
                at = y
            pieces.append(data[at : bounds[i + 1]].tobytes())
            removed.append(sum(y - x for x, y in spans))
            runs.append(len(spans))
            mine = slice(seen[i], seen[i + 1])
            passages.append(int((n_words[b[mine]] - n_words[a[mine]]).sum()))
            left.append(b"".join(pieces))
        yield done(batch, removed, runs, passages, left)

    columns = ("texts", "flags", "windows")
    told = told_by(stages, "asked-open", both, open_keys, 64, buckets, *columns)
    settled = with_answers(both, told, open_told, result, *columns)

    def unpack(batches):
        for batch in batches:
            for x in batch.column(0):
                part = from_blob(x.as_py())
                yield pa.RecordBatch.from_arrays(part.columns, schema=result_schema)

    return clean.select("blob").mapInArrow(unpack, result).unionByName(settled)


def op6_repeats(spark, sf_dir: str) -> DataFrame:
    """Each row of ``documents`` without the bytes that strings of 400 bytes standing elsewhere too cover: ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256``; and ``n_passage_words``, the words of passages of 50 words or more that stand in another
    document too, many of which have fewer than 400 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = dedupe(docs, words=WORDS)
    return found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def without_repeats(docs: DataFrame, *, text: str = "text", least: int = LEAST, words: int = WORDS) -> DataFrame:
    """``docs`` with the repeated strings of ``least`` bytes and the passages of ``words`` words that stand in another row too cut
    out of the texts, each copy of them; rows whose text was nothing else go."""
    columns = docs.columns
    aside = docs.withColumnsRenamed({c: f"c_{c}" for c in columns})
    found = dedupe(aside, text=f"c_{text}", least=least, words=words, cut_passages=True, as_text=True).where((F.col("n_removed") == 0) | (F.length("kept") > 0))
    cut = found.withColumn(f"c_{text}", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"c_{text}")))
    return cut.select(*(F.col(f"c_{c}").alias(c) for c in columns))
