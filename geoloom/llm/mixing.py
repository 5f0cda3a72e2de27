"""Mixing sources to target weights by Pfair scheduling.

A source's rows, in seeded random order, form blocks. While a set of sources is active, source ``s`` with
exact weight ``a`` of a total ``A`` gets one block in each window [floor(iA/a), ceil((i+1)A/a)): these
are the releases and deadlines of its blocks, and earliest-deadline-first serves one block a slot, so at
every slot each source is less than one block away from its target. Weights are the targets as exact fractions,
brought to whole numbers; the driver gives out the slots of all blocks. When a source has given all its blocks, the others go on
with their weights against the new total: no row is dropped or repeated.

Defined results: a null source is a source of its own, sorted by the name ``""`` with a flag; null texts
and ids are rows like any others; repeated rows each keep a place; an empty table gives an empty result;
extra columns travel along unless they begin with ``__`` or have a
result column's name.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stages


def served(weights: dict[str, int]) -> Iterator[str]:
    """The source of each slot, without end, by earliest deadline among released blocks (ties: by name)."""
    total = sum(weights.values())
    waiting = [(0, -(-total // a), s, 0) for s, a in weights.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    for slot in itertools.count():
        while waiting and waiting[0][0] <= slot:
            _, deadline, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, i))
        deadline, s, i = heapq.heappop(ready)
        if deadline <= slot:
            raise ArithmeticError("a block missed its deadline")
        yield s
        i, a = i + 1, weights[s]
        heapq.heappush(waiting, (i * total // a, -(-(i + 1) * total // a), s, i))


def period(weights: dict[str, int]) -> list[str]:
    """The sources of one period's slots."""
    return list(itertools.islice(served(weights), sum(weights.values())))


def integer_weights(targets: dict[str, float | Fraction]) -> dict[str, int]:
    """Whole numbers in exactly the ratio of the targets, of any size."""
    exact = {s: Fraction(w) for s, w in targets.items()}
    whole = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * whole) for s, w in exact.items()}


def slots(weights: dict[str, int], blocks: dict[str, int]) -> dict[str, array]:
    """The slot of each block of each source; when a source ends, a new schedule of the others begins."""
    left, start, out = {s: n for s, n in blocks.items() if n}, 0, {s: array("q") for s in blocks}
    while left:
        active = {s: weights[s] for s in sorted(left)}
        divisor = math.gcd(*active.values())
        for slot, s in enumerate(served({s: a // divisor for s, a in active.items()}), start):
            out[s].append(slot)
            left[s] -= 1
            if not left[s]:
                del left[s]
                start = slot + 1
                break
    return out


def plan_table(spark: SparkSession, given: dict[str, array], run: int) -> DataFrame:
    """The slots as rows of ``run`` blocks of a source."""
    sources, runs, parts, ends = [], [], [], [0]
    for s, at in given.items():
        for k in range(0, len(at), run):
            sources.append(s)
            runs.append(k // run)
            ends.append(ends[-1] + min(run, len(at) - k))
        parts.append(np.frombuffer(at, np.int64))
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    at = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), values)
    return spark.createDataFrame(pa.table({"__s": pa.array(sources, pa.string()), "__run": pa.array(runs, pa.int64()), "__at": at}))


def mix_sources(df: DataFrame, targets: dict[str, float] | None = None, *, source: str = "source", block_rows: int = 64, seed: int = 29, part_rows: int = 20_000, run_blocks: int = 64, most_blocks: int = 1_000_000) -> DataFrame:
    """``df`` with ``block`` (of its source), ``slot`` (of the block in the mix, gapless) and ``place`` (in the block).

    ``targets``: a weight for each source name (those not named, or named with 0, weigh 1 in a million of the total); without it
    a source weighs the square root of its rows. The driver holds 8 bytes a block and takes some microseconds for it;
    a block has more rows than ``block_rows`` where there would be over ``most_blocks`` blocks.
    """
    spark, stages = df.sparkSession, Stages(df.sparkSession, "mixing")
    columns = [c for c in df.columns if not c.startswith("__") and c not in ("block", "slot", "place")]
    content = [F.to_json(F.struct(F.col(c))) if df.schema[c].dataType.typeName() in ("map", "variant") else F.col(c) for c in columns]
    name = F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source).cast("string")))
    keyed = df.select(*columns, name.alias("__s"), F.xxhash64(F.lit(seed), *content).alias("__h"))
    counts = {r[0]: r[1] for r in keyed.groupBy("__s").count().collect()}
    block_rows = max(block_rows, -(-sum(counts.values()) // most_blocks))
    parts = max(64, -(-max(counts.values(), default=0) // part_rows))
    rows = keyed.withColumn("__part", F.pmod(F.xxhash64(F.lit(seed + 1), "__h"), F.lit(parts)))
    before = Window.partitionBy("__s").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__s", "__part").count().select("__s", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    starts = stages.keep(starts, "starts")
    if targets is None:
        wanted = {s: math.sqrt(n) for s, n in counts.items()}
    else:
        floor = sum(map(Fraction, targets.values())) / 1_000_000 or 1
        wanted = {s: targets.get(s[1:] if s[0] == "1" else None, 0) or floor for s in counts}
    given = slots(integer_weights(wanted), {s: -(-n // block_rows) for s, n in counts.items()})
    plan = plan_table(spark, given, run_blocks)
    local = Window.partitionBy("__s", "__part").orderBy("__h")
    ranked = (
        rows.withColumn("__r", F.row_number().over(local) - 1)
        .join(starts, ["__s", "__part"])
        .withColumn("__r", F.col("__r") + F.col("__start"))
        .withColumn("block", F.floor(F.col("__r") / block_rows).cast("long"))
        .withColumn("place", (F.col("__r") % block_rows).cast("int"))
        .withColumn("__run", F.floor(F.col("block") / run_blocks).cast("long"))
    )
    slot = F.element_at("__at", (F.col("block") % run_blocks + 1).cast("int"))
    return ranked.join(plan, ["__s", "__run"]).select(*columns, "block", slot.cast("long").alias("slot"), "place")


def in_mixed_order(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` in the order of the mix: ranges of slots, each sorted; the columns of ``df``."""
    mixed = mix_sources(df.withColumnsRenamed({c: f"c_{c}" for c in df.columns}), source=f"c_{options.pop('source', 'source')}", **options)
    ordered = mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
    return ordered.select(*(F.col(f"c_{c}").alias(c) for c in df.columns))


def part_number(path: str) -> tuple:
    """Orders the files of one table as they were written: part-<task>-<job>-c<file of the task>."""
    found = re.search(r"part-(\d+)(?:-.*?-c(\d+))?[^/]*$", path)
    if not found:
        raise ValueError(f"no part number: {path}")
    return int(found[1]), int(found[2] or 0), path


def with_rank(df: DataFrame, rank: str = "rank") -> DataFrame:
    """``df``, a table as it was read from its files, with each row's place (from 0) in the order ``in_mixed_order`` wrote.

    Writers number their files by range: the order is that of the part numbers, then of the rows in a file,
    however a reader splits or packs the files. The driver holds one row a file.
    """
    found = {r[0]: r[1] for r in df.groupBy(F.col("_metadata.file_path")).count().collect()}
    start, starts = 0, []
    for path in sorted(found, key=part_number):
        starts.append((path, start))
        start += found[path]
    starts = df.sparkSession.createDataFrame(starts, "__path string, __start long")
    placed = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row"))
    return placed.join(F.broadcast(starts), "__path").select(*df.columns, (F.col("__start") + F.col("__row")).alias(rank))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs.select("doc_id", "source", "n_chars")).select("doc_id", "source", "block", "slot", "place")
