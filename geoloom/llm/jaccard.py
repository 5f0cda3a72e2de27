"""N-gram Jaccard join with set-relation skipping.

Sets are the distinct word shingles of texts. Whole sets are told apart first: one question to all shards
tells which shingles occur in several texts, and a text with too few of them has no links; equal sets
are one class. Among the classes that remain the question is asked again, with counts, which gives the
global order of shingles (rarest first, then by hash). Each set's prefix in that order goes to an index.

Index lists are sorted by set size and position, so that blocks which the length filter or the positional
filter excludes are skipped as a whole. Answers are derived from similar sets' answers: first each
set of a list is compared with the list's pivot only; the sets linked to one pivot form a class, whose
inner pairs need no comparison for the classes to be right, and a list that holds one class only is skipped.
Then pivots of other classes are tried, until nothing new is found; at last all pairs of different
classes that pass the filters are compared, so no link between classes is lost.

Defined results: null, empty and word-less texts have no shingles and are linked with nothing; texts with
fewer words than ``n`` have one shingle, their whole sequence; equal texts are linked; repeated rows all
give a row; a row without id has the least id of its class, or none; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Stages
from .exchange import U64, Spans, bits_told, counts_told, from_blob, mix, pack, ranges, sized, text_bytes, told_by, with_answers, words_in
from .links import components

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Rounds in which pivots of other classes are tried before all pairs of different classes are compared.
PIVOT_ROUNDS = 4
#: Pivots of a list in each round but the first, which has one.
PIVOTS = 16
#: Bytes of text a question's pass hashes at a time.
PASS = 1 << 20


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row."""
    data, bounds = text_bytes(column)
    out: list[np.ndarray] = []
    row = 0
    while row < len(bounds) - 1:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + PASS, "right")) - 1)
        out += sets_in(data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row], n)
        row = end
    return out


def sets_in(data: np.ndarray, bounds: np.ndarray, n: int) -> list[np.ndarray]:
    data = LOWER[data]
    starts, ends = words_in(data, bounds)
    words = Spans(data).hash(starts, ends)
    cuts = np.searchsorted(starts, bounds)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        grams += words[k : k + len(grams)] * U64((0x9E3779B97F4A7C15 * (2 * k + 3)) & (1 << 64) - 1)
        grams = mix(grams) if k == n - 1 else grams
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            whole = U64(xxhash.xxh3_64_intdigest(words[a:b].tobytes(), seed=int(b - a)))
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_shared(size: np.ndarray | int, percent: int):
    """A set of this size shares at least so many shingles with any set it is linked with."""
    return -(-(size * percent) // 100)


def class_rows(stages: Stages, shards: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """One row for each row of the shards (which hold ``id`` and ``text``): its ``shard`` and ``row`` there, ``id``, ``n`` shingles, ``mark``
    (a hash of the text), ``print`` (of its set; null: no shingles), ``class`` (the least print of its class) and ``least`` (id of the class)."""
    total = shards.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits, buckets = sized(total, 6.0)
    parts = ranges(buckets)
    shift = U64(64 - bits)

    # Which shingles occur in one text only? A text with more than a fifth of such is linked with nothing.
    def keys_in_texts():
        return lambda blob: (distinct_keys(shingle_sets(from_blob(blob).column(text), n), shift), None)

    def tell_texts(shard, blobs, told):
        batch = from_blob(blobs[0])
        sets = shingle_sets(batch.column(text), n)
        marks = [xxhash.xxh3_64_intdigest(x.as_py() or "") - (1 << 63) for x in batch.column(text)]
        keys, counts = shard_keys(sets, shift)
        several = bits_told(keys, told, bits, parts) | (counts > 1)
        here: set[bytes] = set()
        prints, kept = [], []
        for s in sets:
            prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            shared = int(several[np.searchsorted(keys, s >> shift)].sum())
            fresh = len(s) and prints[-1] not in here and shared >= least_shared(len(s), percent)
            kept.append(s.tobytes() if fresh else None)
            if fresh:
                here.add(prints[-1])
        columns = [pa.array([shard] * len(sets), pa.int64()), pa.array(range(len(sets)), pa.int64()), batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.int64()), pa.array(prints, pa.binary()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "row", "id", "n", "mark", "print", "hashes"])

    answers = told_by(stages, "asked-texts", shards, keys_in_texts, bits, buckets, "blob")
    told = with_answers(shards, answers, tell_texts, "shard long, row long, id long, n long, mark long, print binary, hashes binary", "blob")
    told = stages.keep(told, "told")
    texts = told.drop("hashes")

    # The classes of equal sets that are left, asked again with counts.
    left = told.where("hashes is not null").select("print", "hashes").dropDuplicates(["print"])
    sets = stages.keep(pack(left, "hashes"), "sets")
    hashed = sets.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    _, buckets2 = sized(hashed, 8.0)
    parts2 = ranges(buckets2)

    def arrays(batch):
        return [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("hashes")]

    def keys_in_sets():
        return lambda blob: shard_keys(arrays(from_blob(blob)), U64(0))

    def tell_sets(shard, blobs, told):
        batch = from_blob(blobs[0])
        mine = arrays(batch)
        keys, _ = shard_keys(mine, U64(0))
        counts = counts_told(keys, told, 64, parts2)
        out = []
        for i, s in enumerate(mine):
            often = counts[np.searchsorted(keys, s)]
            if int((often > 1).sum()) < least_shared(len(s), percent):
                continue
            order = np.lexsort((s, often))
            prefix = order[: len(s) - least_shared(len(s), percent) + 1]
            places = np.flatnonzero(often[prefix] > 1)
            out.append(((shard << 20) + i, batch.column("print")[i].as_py(), len(s), s.tobytes(), s[prefix[places]].tobytes(), places.astype(np.int32).tobytes()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["set", "print", "n", "hashes", "prefix", "places"])

    def entries_of(batches):
        for batch in batches:
            if batch.num_rows:
                sets, sizes = (batch.column(c).to_numpy() for c in ("set", "n"))
                prefix, places = ([np.frombuffer(x.as_buffer(), kind) for x in batch.column(c)] for c, kind in (("prefix", np.int64), ("places", np.int32)))
                counts = [len(x) for x in prefix]
                yield pa.RecordBatch.from_arrays([np.repeat(sets, counts), np.repeat(sizes, counts), np.concatenate(prefix), np.concatenate(places)], ["set", "n", "shingle", "place"])

    found = with_answers(sets, told_by(stages, "asked-sets", sets, keys_in_sets, 64, buckets2, "blob"), tell_sets, "set long, print binary, n long, hashes binary, prefix binary, places binary", "blob")
    found = stages.keep(found, "found")
    stages.drop("sets", "asked-texts", "asked-sets")
    members = found.select("set", "n", "hashes")
    index = found.select("set", "n", "prefix", "places").mapInArrow(entries_of, "set long, n long, shingle long, place int")
    index = stages.keep(index, "index")

    comp = linked(stages, members, index, percent)
    smallest = texts.where("print is not null").groupBy("print").agg(F.min("id").alias("own"))
    joined = found.select("set", "print").join(comp.withColumnRenamed("node", "set"), "set").join(smallest, "print")
    reach = joined.join(joined.groupBy("comp").agg(F.min("own").alias("reached"), F.min("print").alias("class")), "comp").select("print", "reached", "class")
    whole = smallest.join(reach, "print", "left").select("print", F.coalesce("reached", "own").alias("least"), F.coalesce("class", "print").alias("class"))
    whole = stages.keep(whole, "whole")
    alone = texts.where("print is null").withColumns({"least": F.col("id"), "class": F.lit(None).cast("binary")})
    result = told_of(stages, texts.where("print is not null"), whole, "print").unionByName(alone)
    return stages.keep(result, "rows")


def told_of(stages: Stages, left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key. Keys with a thousandth of all rows or more, a thousand at most, are told by a broadcast."""
    total = left.count()
    hot = left.groupBy(key).count().where(F.col("count") * share >= total).select(key)
    hot = F.broadcast(stages.keep(hot, f"hot-{key}"))
    spread = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key)
    return left.join(hot, key, "left_anti").join(right, key).unionByName(spread)


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row a text: ``n_shingles`` and ``component_id``, the least key reachable by links of Jaccard similarity ``percent`` / 100 or more."""
    stages = Stages(docs.sparkSession, "jaccard")
    shards = stages.keep(pack(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "text"), "shards")
    rows = class_rows(stages, shards, "text", n, percent)
    stages.drop_all_but("rows")
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def shard_keys(sets: list[np.ndarray], shift) -> tuple[np.ndarray, np.ndarray]:
    if not sets:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = np.unique(np.concatenate(sets) >> shift, return_counts=True)
    return keys, np.minimum(counts, 65535)


def distinct_keys(sets: list[np.ndarray], shift) -> np.ndarray:
    return shard_keys(sets, shift)[0]


PAIRS = "a long, b long"


def pairs_of_lists(entries: DataFrame, percent: int, turn: int, every: bool) -> DataFrame:
    """Pairs (a < b) of sets of different classes to compare, from index entries (set, n, shingle, place, comp).

    ``every``: all pairs that pass the length and positional filters; else each set with the turn's pivots of its lists and with neighbours in size.
    """
    ratio = percent / 100

    def run(table: pa.Table) -> pa.Table:
        t, s, n, p, c = (table.column(x).to_numpy() for x in ("shingle", "set", "n", "place", "comp"))
        order = np.lexsort((s, p, n, t))
        t, s, n, p, c = (x[order] for x in (t, s, n, p, c))
        number = np.cumsum(np.concatenate(([0], t[1:] != t[:-1])))
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        # a list that holds one class is skipped: its answers are known
        mixed_lists = np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)
        keep = mixed_lists[number]
        s, n, p, c, number = (x[keep] for x in (s, n, p, c, number))
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def add(i, j):
            """Of the pairs of places i, j: those of different classes whose sizes and positions leave room for enough shared shingles."""
            low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            need = np.ceil((n[i] + n[j]) * (ratio / (1 + ratio)) - 1e-6)
            room = np.minimum(n[i] - p[i], n[j] - p[j])
            ok = (number[i] == number[j]) & (c[i] != c[j]) & (low * 100 >= high * percent) & (room >= need)
            a, b = s[i[ok]], s[j[ok]]
            pairs = np.unique(np.stack([np.append(out[0], np.minimum(a, b)), np.append(out[1], np.maximum(a, b))], axis=1).view("i8,i8").ravel())
            out[:] = pairs["f0"], pairs["f1"]

        if len(s):
            here, width = np.arange(len(s)), int(n.max()) * 100 // percent + 2
            at = number * width + n  # sorted: in a list, sets of a range of sizes are one block
            if every:
                # the partners of a set stand in the block behind it, up to the largest size that the length filter lets through
                ends = np.searchsorted(at, number * width + n * 100 // percent, "right")
                left, counts = 0, np.maximum(ends - here - 1, 0)
                upto = np.cumsum(counts)
                while left < len(s):
                    right = max(left + 1, int(np.searchsorted(upto, (upto[left - 1] if left else 0) + (1 << 20), "right")))
                    i = np.repeat(here[left:right], counts[left:right])
                    before = np.repeat(upto[left:right] - counts[left:right], counts[left:right])
                    add(i, i + 1 + np.arange(len(i)) + (upto[left - 1] if left else 0) - before)
                    left = right
            else:
                # pivots by a hash of the set, so that lists of similar sets have the same ones; other ones in each turn
                by = np.lexsort((mix(s.astype(np.uint64) + U64(turn << 56)), number))
                start = np.searchsorted(number[by], number)
                last = np.searchsorted(number[by], number, "right") - 1
                for k in range(PIVOTS if turn else 1):
                    add(here, by[np.minimum(start + k, last)])
                add(here, np.searchsorted(at, number * width + least_shared(n, percent)))
                add(here[1:], here[:-1])
        return pa.table({"a": out[0], "b": out[1]})

    lists = entries.withColumn("bucket", F.pmod(F.xxhash64("shingle"), F.lit(list_buckets(entries))))
    return lists.groupBy("bucket").applyInArrow(run, PAIRS).distinct()


def list_buckets(entries: DataFrame) -> int:
    return max(12, -(-entries.count() // 200_000))


def linked(stages: Stages, members: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """``node`` and ``comp`` of the sets that have links."""

    def shared(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(c).to_numpy() for c in ("a", "b", "na", "nb"))
            both = np.fromiter((len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)) for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([a, b, pa.array(both * 100 >= (na + nb - both) * percent)], ["a", "b", "link"])

    def compared(pairs: DataFrame) -> DataFrame:
        right = members.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
        left = members.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
        return pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "ha", "hb").mapInArrow(shared, "a long, b long, link boolean")

    tried, comp = None, None
    for turn in range(PIVOT_ROUNDS + 1):
        every = turn == PIVOT_ROUNDS
        if comp is None:
            entries = index.withColumn("comp", F.col("set"))
        else:
            entries = index.join(comp.withColumnRenamed("node", "set"), "set", "left").withColumn("comp", F.coalesce("comp", "set"))
            several = entries.groupBy("shingle").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("shingle")
            entries = entries.join(several, "shingle", "left_semi")
        pairs = pairs_of_lists(entries, percent, turn, every)
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        new = stages.keep(compared(pairs), f"compared-{turn}")
        tried = new if tried is None else tried.unionByName(new)
        if every or new.where("link").limit(1).count():
            comp = components(stages, tried.where("link"), f"links-{turn}")
            if every:
                break
    return comp


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    """Each row of ``documents`` with ``n_shingles`` (5 words) and ``component_id``, by links of Jaccard similarity 0.8 or more."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near copies: of the rows of each class the one with the least key stays (rows without key come last; ties go by
    the text's hash); every row without shingles stays. Rows are told apart by their place in the shards, so a key may repeat."""
    stages = Stages(docs.sparkSession, "jaccard")
    aside = docs.withColumnsRenamed({c: f"c_{c}" for c in docs.columns})
    shards = stages.keep(pack(aside.withColumn("id", F.col(f"c_{key}").cast("long")), f"c_{text}"), "shards")
    rows = class_rows(stages, shards, f"c_{text}", n, percent)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "print", "mark", "shard", "row")
    first = rows.where("print is not null").groupBy("class").agg(F.min(order).alias("r")).select("r.shard", "r.row")
    stay = first.unionByName(rows.where("print is null").select("shard", "row")).groupBy("shard").agg(F.collect_list("row").alias("rows"))
    schema = to_arrow_schema(aside.schema)

    def unpack(batches):
        for batch in batches:
            for blob, chosen in zip(batch.column("blob"), batch.column("rows"), strict=True):
                part = from_blob(blob.as_py()).take(pa.array(sorted(chosen.as_py()), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in schema], schema=schema)

    kept = stages.keep(shards.select("shard", "blob").join(stay, "shard").select("blob", "rows").mapInArrow(unpack, aside.schema), "kept")
    stages.drop_all_but("kept")
    return kept.select(*(F.col(f"c_{c}").alias(c) for c in docs.columns))
