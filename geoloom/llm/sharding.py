"""Sharding by a hypergeometric communication matrix.

A uniform shuffle with exact shard sizes: rows fall into parts by a seeded hash of their content; the
driver sees only the parts' row counts and draws, part by part, how many rows go to which shard
(a multivariate hypergeometric row of the communication matrix, so that every shard's capacity is met
exactly). Each part permutes its rows locally and deals them out by its matrix row; after the exchange
each shard permutes again, in blocks, for gapless slots.

Defined results: a null text counts as empty (size 1, CRC 0); null ids are rows like any others; repeated
rows each get their own slot; an empty table gives an empty result; extra columns travel along unless
they begin with ``__`` or have a result column's name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages, utf8

#: numpy's hypergeometric generator takes populations below this.
POPULATION = 900_000_000


def capacities(n: int, shards: int) -> np.ndarray:
    return np.array([n // shards + (s < n % shards) for s in range(shards)], dtype=np.int64)


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows: parts, columns: shards; row sums are ``counts``, column sums differ by one at most.

    Populations over numpy's bound are dealt in strata of consecutive parts, each with its own exact capacities.
    """
    rng, out, at = np.random.default_rng(seed), np.zeros((len(counts), shards), np.int64), 0
    done = 0
    while at < len(counts):
        end, total = at, 0
        while end < len(counts) and (end == at or total + counts[end] <= POPULATION):
            total += counts[end]
            end += 1
        left = capacities(done + total, shards) - capacities(done, shards)
        for i in range(at, end):
            out[i] = rng.multivariate_hypergeometric(left, counts[i], method="marginals") if counts[i] else 0
            left -= out[i]
        at, done = end, done + total
    return out


def shuffle_shards(df: DataFrame, shards: int, *, seed: int = 17, part_rows: int = 20_000) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    ``part_rows`` bounds the rows a task permutes; the driver holds one count and one matrix row a part.
    """
    spark, stages = df.sparkSession, Stages(df.sparkSession, "sharding")
    columns = [c for c in df.columns if not c.startswith("__") and c not in ("shard", "slot")]
    content = [F.to_json(F.struct(F.col(c))) if df.schema[c].dataType.typeName() in ("map", "variant") else F.col(c) for c in columns]
    keyed = df.select(*columns, F.xxhash64(F.lit(seed), *content).alias("__h"))
    keyed = stages.keep(keyed, "keyed")
    n = keyed.count()
    parts = max(64, -(-n // part_rows))
    part = F.pmod("__h", F.lit(parts))
    rows = keyed.withColumn("__part", part)
    counts = {r[0]: r[1] for r in rows.groupBy("__part").count().collect()}
    order = sorted(counts)
    matrix = communication_matrix([counts[p] for p in order], shards, seed)
    bounds = spark.createDataFrame([(int(p), [int(x) for x in np.cumsum(m)]) for p, m in zip(order, matrix, strict=True)], "__part long, __bounds array<long>")
    permuted = Window.partitionBy("__part").orderBy(F.xxhash64(F.lit(seed + 1), "__h"), "__h")
    dealt = (
        rows.withColumn("__r", F.row_number().over(permuted) - 1)
        .join(bounds, "__part")
        .withColumn("shard", F.size(F.filter("__bounds", lambda b: b <= F.col("__r"))).cast("int"))
        .withColumn("__block", F.pmod(F.xxhash64(F.lit(seed + 2), "__h", "__r"), F.lit(max(8, -(-parts // shards)))))
        .select(*columns, "__h", "__r", "shard", "__block")
    )
    dealt = stages.keep(dealt, "dealt")
    stages.drop("keyed")
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "__block").count().select("shard", "__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    again = Window.partitionBy("shard", "__block").orderBy(F.xxhash64(F.lit(seed + 3), "__h", "__r"), "__h", "__r")
    return dealt.withColumn("__k", F.row_number().over(again) - 1).join(starts, ["shard", "__block"]).select(*columns, "shard", (F.col("__start") + F.col("__k")).cast("long").alias("slot"))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    digests = docs.select("doc_id", (F.octet_length(utf8()) + 1).cast("long").alias("size"), F.crc32(utf8()).cast("long").alias("text_crc32"))
    return shuffle_shards(digests, 16).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
