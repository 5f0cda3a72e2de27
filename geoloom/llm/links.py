"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages


def components(stages: Stages, links: DataFrame, name: str = "links") -> DataFrame:
    """``node`` and ``comp`` (the least node reachable) of each node in ``links`` (a, b), by alternating large and small stars.

    Every round is a written table; a hub's links are only aggregated and joined, never gathered.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = stages.keep(edges, f"{name}-0")
    mark, k = None, 0
    while True:
        print_of = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(print_of) == mark:
            break
        mark, k = tuple(print_of), k + 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stages.keep(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{k}")
        stages.drop(f"{name}-{k - 1}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
