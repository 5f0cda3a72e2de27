"""Standing questions over one profile table: (area, mode, category, n, nearest_m), computed for all areas and modes in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import routing


def profiles(areas: DataFrame, networks: dict[str, DataFrame], services: DataFrame, minutes: float, categories: DataFrame) -> DataFrame:
    """``areas``: area, node. Every area and mode at once."""
    parts = []
    for mode, edges in networks.items():
        budget = routing.budget_m(minutes, routing.SPEED_KMH[mode])
        costs = routing.shortest_paths(areas.select(F.col("area").alias("origin"), "node", F.lit(0.0).alias("cost")), routing.symmetric(edges), budget)
        reached = routing.reachable_services(costs, services, budget)
        found = routing.category_profile(areas.select(F.col("area").alias("origin")), reached, categories)
        parts.append(found.select(F.col("origin").alias("area"), F.lit(mode).alias("mode"), "category", "n", "nearest_m"))
    return reduce(DataFrame.unionByName, parts)


def poorest_access(p: DataFrame, category: str, mode: str, limit: int = 10) -> DataFrame:
    rows = p.where((F.col("category") == category) & (F.col("mode") == mode))
    return rows.orderBy("n", F.col("nearest_m").desc_nulls_first(), "area").limit(limit).select("area", "n", "nearest_m")


def wide(p: DataFrame, mode: str, **columns: str) -> DataFrame:
    return p.where(F.col("mode") == mode).groupBy("area").agg(*(F.sum(F.when(F.col("category") == c, F.col("n")).otherwise(0)).alias(name) for name, c in columns.items()))


def median_gap(p: DataFrame, good: str, poor: str, mode: str, least: float | None = None, most: float | None = None) -> DataFrame:
    """Areas with at least the median of one category and at most the median of another (or the limits given), widest gap first."""
    rows = wide(p, mode, good=good, poor=poor)
    medians = rows.agg(F.median("good").alias("mg"), F.median("poor").alias("mp"))
    low = F.col("mg") if least is None else F.lit(least)
    high = F.col("mp") if most is None else F.lit(most)
    found = rows.crossJoin(F.broadcast(medians)).where((F.col("good") >= low) & (F.col("poor") <= high))  # one row of medians
    return found.select("area", "good", "poor", (F.col("good") - F.col("poor")).alias("gap")).orderBy(F.desc("gap"), "area")


def adjacent_contrasts(p: DataFrame, adjacency: DataFrame, mode: str, essential: list[str]) -> DataFrame:
    """Each adjacent pair once: totals over the essential categories, their difference and ratio, the category that differs most (ties: the
    first), and the signed difference of each category."""
    rank = F.array_position(F.array(*map(F.lit, essential)), F.col("category"))
    rows = p.where((F.col("mode") == mode) & F.col("category").isin(*essential)).withColumn("rank", rank)
    a = rows.select(F.col("area").alias("src"), "category", "rank", F.col("n").alias("an"))
    b = rows.select(F.col("area").alias("dst"), "category", F.col("n").alias("bn"))
    both = adjacency.where("src < dst").join(a, "src").join(b, ["dst", "category"])
    gap = F.max(F.struct(F.abs(F.col("an") - F.col("bn")).alias("gap"), (-F.col("rank")).alias("r"), "category"))
    signed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "category", (F.col("an") - F.col("bn")).alias("d")))), lambda x: F.struct(x["category"].alias("category"), x["d"].alias("difference")))
    out = both.groupBy("src", "dst").agg(F.sum("an").alias("a_total"), F.sum("bn").alias("b_total"), gap.alias("g"), signed.alias("by_category"))
    low, high = F.least("a_total", "b_total"), F.greatest("a_total", "b_total")
    out = out.select("src", "dst", "a_total", "b_total", (high - low).alias("difference"), F.round(high / F.nullif(low, F.lit(0)), 2).alias("ratio"), F.col("g.category").alias("widest"), F.col("g.gap").alias("widest_gap"), "by_category")
    return out.orderBy(F.desc("difference"), "src", "dst")


def category_inequality(p: DataFrame, mode: str, categories: list[str]) -> DataFrame:
    """Spread of the counts over all areas, by category: the most uneven first. Ties: the first area is worst, the last is best."""
    rows = p.where((F.col("mode") == mode) & F.col("category").isin(*categories)).groupBy("category")
    out = rows.agg(
        F.round(F.avg("n"), 1).alias("mean"), F.round(F.stddev_pop("n"), 1).alias("stdev"), F.round(F.stddev_pop("n") / F.nullif(F.avg("n"), F.lit(0.0)), 3).alias("cv"), F.min("n").alias("low"), F.max("n").alias("high"),
        F.count_if(F.col("n") == 0).alias("zeros"), F.min(F.struct("n", "area"))["area"].alias("worst"), F.max(F.struct("n", "area"))["area"].alias("best"),
    )
    return out.orderBy(F.coalesce("cv", F.lit(0.0)).desc(), "category")


def mode_gain(p: DataFrame, base: str, others: list[str], essential: list[str]) -> DataFrame:
    """A row for each area and other mode: what is gained over the base in the essential categories; ``best`` marks an area's best mode."""
    total = p.where(F.col("category").isin(*essential)).groupBy("area", "mode").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("present"))
    b = total.where(F.col("mode") == base).select("area", F.col("total").alias("base_total"), F.col("present").alias("base_present"))
    rows = total.where(F.col("mode").isin(*others)).join(b, "area").withColumn("gain", F.col("total") - F.col("base_total"))
    order = F.array_position(F.array(*map(F.lit, others)), F.col("mode"))
    first = Window.partitionBy("area").orderBy(F.desc("gain"), order)
    multiplier = F.round(F.col("total") / F.nullif(F.col("base_total"), F.lit(0)), 2)
    out = rows.select("area", "mode", "base_total", F.col("total").alias("other_total"), "gain", multiplier.alias("multiplier"), (F.col("present") - F.col("base_present")).alias("completeness_gain"), (F.row_number().over(first) == 1).alias("best"))
    return out.orderBy(F.desc("gain"), "area", "mode")


def underserved(p: DataFrame, areas: DataFrame, category: str, mode: str, structural: DataFrame, least: float | None = None) -> DataFrame:
    """Areas over the median of a statistic (area, people), or over ``least``, and under the medians of a category reached and of stops (area, stops)."""
    rows = areas.join(wide(p, mode, reached=category), "area").join(structural, "area", "left").withColumn("stops", F.coalesce("stops", F.lit(0)))
    m = rows.agg(F.median("people").alias("mp"), F.median("reached").alias("mr"), F.median("stops").alias("ms"))
    high = F.col("mp") if least is None else F.lit(least)
    found = rows.crossJoin(F.broadcast(m)).where((F.col("people") > high) & (F.col("reached") < F.col("mr")) & (F.col("stops") < F.col("ms")))  # one row of medians
    return found.select("area", "people", "reached", "stops").orderBy(F.desc("people"), "area")
