"""Network operators: shortest paths for many origins in one plan, reach, coverage, routes, components.

Two ways give the same costs. ``grouped`` runs a heap search for each origin in Python workers against the
adjacency of one network, which is broadcast: only for networks up to ``BROADCAST_EDGES``, which is
checked. ``relational`` relaxes all origins' frontiers with joins and has no bound. ``auto`` picks by size.
"""

from __future__ import annotations

import heapq
import math
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataUnavailableError
from ..functions.exprs import snap_quality

#: The largest adjacency that is broadcast (about 100 MB of Python objects).
BROADCAST_EDGES = 500_000
SPEED_KMH = {"walk": 4.8, "bike": 15.0}


def budget_m(minutes: float, speed_kmh: float) -> float:
    return speed_kmh * 1000 * minutes / 60


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of undirected edges (u, v, length_m), the shortest of parallel ones, without loops and empty lengths."""
    one = shortest_parallel(edges)
    return one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "length_m"))


def shortest_parallel(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v and length_m > 0").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("length_m").alias("length_m"))


def repaired_lengths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Missing, NaN or non-positive lengths replaced by the straight distance of the end points."""
    a, b = nodes.select(F.col("node").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy")), nodes.select(F.col("node").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    good = F.when((F.col("length_m") > 0) & ~F.isnan("length_m"), F.col("length_m"))
    return edges.join(a, "u").join(b, "v").withColumn("length_m", F.coalesce(good, F.hypot(F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy")))).select("u", "v", "length_m").where("length_m > 0")


def shortest_paths(seeds: DataFrame, edges: DataFrame, cutoff: float | None = None, method: str = "auto") -> DataFrame:
    """(origin, node, cost, pred) from seeds (origin, node, cost), which may be many an origin. ``edges``: u, v, length_m, both directions.

    ``pred`` is the node before on a cheapest path (null at a seed). Costs over ``cutoff`` are left out.
    """
    if method == "relational":
        return _relational(seeds, edges, cutoff)
    found = edges.select("u", "v", "length_m").limit(BROADCAST_EDGES + 1).collect()
    if len(found) <= BROADCAST_EDGES:
        return _grouped(seeds, found, cutoff)
    if method == "grouped":
        raise ValueError(f"a network of over {BROADCAST_EDGES} edges is not broadcast")
    return _relational(seeds, edges, cutoff)


def _grouped(seeds: DataFrame, edges: list, cutoff: float | None) -> DataFrame:
    out: dict = {}
    for u, v, length in edges:  # at most BROADCAST_EDGES
        out.setdefault(u, []).append((v, length))
    net = seeds.sparkSession.sparkContext.broadcast(out)
    schema = f"origin {seeds.schema['origin'].dataType.simpleString()}, node {seeds.schema['node'].dataType.simpleString()}, cost double, pred {seeds.schema['node'].dataType.simpleString()}"

    def search(table: pa.Table) -> pa.Table:
        adjacent, best, queue = net.value, {}, []
        for node, cost in zip(table.column("node").to_pylist(), table.column("cost").to_pylist(), strict=True):
            heapq.heappush(queue, (float(cost), -1, node, None))
        turn = 0
        while queue:
            cost, _, node, pred = heapq.heappop(queue)
            if node in best or (cutoff is not None and cost > cutoff):
                continue
            best[node] = (cost, pred)
            for other, length in adjacent.get(node, ()):
                if other not in best:
                    turn += 1
                    heapq.heappush(queue, (cost + length, turn, other, node))
        origin = table.column("origin")[0].as_py()
        kind = table.schema.field("node").type
        return pa.table({"origin": pa.array([origin] * len(best), table.schema.field("origin").type), "node": pa.array(list(best), kind), "cost": pa.array([c for c, _ in best.values()], pa.float64()), "pred": pa.array([p for _, p in best.values()], kind)})

    return seeds.select("origin", "node", "cost").groupBy("origin").applyInArrow(search, schema)


def cutter(spark):
    """Cuts a loop's lineage: to the shared checkpoint folder where one is told, so that a lost executor does not replay the loop."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(told)
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise DataUnavailableError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="geoloom-"))
    return lambda df: df.checkpoint()


def _relational(seeds: DataFrame, edges: DataFrame, cutoff: float | None) -> DataFrame:
    cut = cutter(seeds.sparkSession)
    pick = F.min(F.struct("cost", "pred")).alias("b")
    state = seeds.select("origin", "node", F.col("cost").cast("double"), F.lit(None).cast(seeds.schema["node"].dataType).alias("pred"))
    state = cut(state.groupBy("origin", "node").agg(pick).select("origin", "node", "b.cost", "b.pred"))
    frontier = state
    while True:
        step = frontier.join(edges, F.col("node") == F.col("u")).select("origin", F.col("v").alias("node"), (F.col("cost") + F.col("length_m")).alias("cost"), F.col("u").alias("pred"))
        if cutoff is not None:
            step = step.where(F.col("cost") <= cutoff)
        step = step.groupBy("origin", "node").agg(pick).select("origin", "node", "b.cost", "b.pred")
        old = state.select("origin", "node", F.col("cost").alias("old"))
        frontier = cut(step.join(old, ["origin", "node"], "left").where("old is null or cost < old").drop("old"))
        if not frontier.limit(1).count():
            return state
        state = cut(state.join(frontier.select("origin", "node"), ["origin", "node"], "left_anti").unionByName(frontier))


def nearest_facility(facilities: DataFrame, edges: DataFrame, cutoff: float | None = None) -> DataFrame:
    """Distance of each node to its nearest facility (node, distance_m): one search from all of them, offset by their way to the network."""
    seeds = facilities.groupBy("node").agg(F.min("distance_m").alias("cost")).select(F.lit(0).alias("origin"), "node", "cost")
    return shortest_paths(seeds, edges, cutoff).select("node", "cost")


def merged_seeds(*parts: DataFrame) -> DataFrame:
    """Seeds (origin, node, cost) of several kinds, the cheapest of each node."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("origin", "node").agg(F.min("cost").alias("cost"))


def network_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and their whole length."""
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(shortest_parallel(edges).agg(F.count("*").alias("edges"), F.coalesce(F.sum("length_m"), F.lit(0.0)).alias("total_m")))  # one row a side


def detours(reached: DataFrame, straight: DataFrame) -> DataFrame:
    """(origin, service, detour): way on the network through the straight distance (origin, service, straight_m); 1 where there is none."""
    ratio = F.round(F.col("distance_m") / F.nullif(F.col("straight_m"), F.lit(0.0)), 2)
    return reached.join(straight, ["origin", "service"]).withColumn("detour", F.coalesce(ratio, F.lit(1.0)))


def reachable_points(costs: DataFrame, points: DataFrame, budget: float) -> DataFrame:
    """(origin, n): points (node, distance_m), such as accidents, whose node and way to it are within the budget."""
    return costs.join(points.select("node", "distance_m"), "node").where(F.col("cost") + F.col("distance_m") <= budget).groupBy("origin").agg(F.count("*").alias("n"))


def areas_touched(costs: DataFrame, edges: DataFrame, nodes: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """(origin, area) of the areas that an origin's reachable edges meet. Each edge is tested against areas once, whoever reaches it."""
    from . import spatial

    one = shortest_parallel(edges)
    at = lambda n, p: nodes.select(F.col("node").alias(n), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    segments = one.join(at("u", "a"), "u").join(at("v", "b"), "v").select("u", "v", "ax", "ay", "bx", "by")
    return reachable_edges(costs, edges).join(spatial.segments_in(segments, areas, cell), ["u", "v"]).select("origin", "area").distinct()


def reachable_edges(costs: DataFrame, edges: DataFrame) -> DataFrame:
    """(origin, u, v, length_m) of the edges whose both ends an origin reaches, each once."""
    a, b = costs.select("origin", F.col("node").alias("u")), costs.select("origin", F.col("node").alias("v"))
    return shortest_parallel(edges).join(a, "u").join(b, ["origin", "v"]).select("origin", "u", "v", "length_m")


def route(costs: DataFrame, target) -> list:
    """The nodes of a cheapest path to ``target``, from one origin's costs (a city-sized search result)."""
    back = {r["node"]: r["pred"] for r in costs.select("node", "pred").collect()}
    path, at = [], target
    while at is not None and at in back:
        path.append(at)
        at = back[at]
    return path[::-1]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, size) by least-label propagation with pointer jumping."""
    cut = cutter(nodes.sparkSession)
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    labels = nodes.select("node", F.col("node").alias("component"))
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("m"))
        low = labels.join(near, F.col("node") == F.col("u"), "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        jump = low.select(F.col("node").alias("j"), F.col("component").alias("jc"))
        low = cut(low.join(jump, F.col("component") == F.col("j")).select("node", F.col("jc").alias("component"), "old"))
        labels = low.drop("old")
        if not low.where("component <> old").limit(1).count():
            return labels.withColumn("size", F.count("*").over(Window.partitionBy("component")))


def reachable_services(costs: DataFrame, services: DataFrame, budget: float) -> DataFrame:
    """(origin, service, category, distance_m): cost of the service's node plus its way to the network, within the budget."""
    found = costs.join(services.select("service", "category", "node", "distance_m"), "node").withColumn("total", F.col("cost") + F.col("distance_m"))
    return found.where(F.col("total") <= budget).select("origin", "service", "category", F.col("total").alias("distance_m"))


def category_profile(origins: DataFrame, reached: DataFrame, categories: DataFrame) -> DataFrame:
    """A row for each origin and category, also where nothing is reached: count, nearest distance and service."""
    best = reached.groupBy("origin", "category").agg(F.count("*").alias("n"), F.min("distance_m").alias("nearest_m"), F.min(F.struct("distance_m", "service"))["service"].alias("nearest"))
    every = origins.select("origin").distinct().crossJoin(F.broadcast(categories.select("category")))  # the domain of categories is fixed
    return every.join(best, ["origin", "category"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def completeness(profile: DataFrame, essential: list[str]) -> DataFrame:
    """How many of the essential categories an origin reaches, their share, and which are missing."""
    part = profile.where(F.col("category").isin(*essential))
    missing = F.array_sort(F.collect_list(F.when(F.col("n") == 0, F.col("category"))))
    return part.groupBy("origin").agg(F.count_if(F.col("n") > 0).alias("present"), F.round(F.count_if(F.col("n") > 0) / len(essential), 3).alias("ratio"), missing.alias("missing"))


def top_services(reached: DataFrame, limit: int) -> DataFrame:
    """The nearest ``limit`` services of each origin and category, and whether there are more."""
    near = Window.partitionBy("origin", "category").orderBy("distance_m", "service")
    ranked = reached.withColumn("rank", F.row_number().over(near)).withColumn("truncated", F.count("*").over(Window.partitionBy("origin", "category")) > limit)
    return ranked.where(F.col("rank") <= limit)


def coverage(areas: DataFrame, distances: DataFrame, budget: float) -> DataFrame:
    """Of the nodes of each area (area, node): how many are within the budget of a facility, median and largest distance, how many have none."""
    rows = areas.join(distances, "node", "left")
    none = F.count_if(F.col("cost").isNull())
    return rows.groupBy("area").agg(F.count("*").alias("nodes"), F.count_if(F.col("cost") <= budget).alias("covered"), F.round(F.count_if(F.col("cost") <= budget) / F.count("*"), 4).alias("ratio"), F.median("cost").alias("median_m"), F.when(none == 0, F.max("cost")).alias("max_m"), none.alias("unreachable"))


def thinned(points: DataFrame, apart_m: float, limit: int, page: int = 1000) -> DataFrame:
    """Greedy choice of up to ``limit`` points (node, x, y, cost), worst first, no two nearer than ``apart_m``.

    The points come in pages of that order, without those near a chosen one; mostly one page, a top-k scan, is enough.
    """
    kept: list = []
    left = points.select("node", "x", "y", F.col("cost").cast("double").alias("cost"))
    order = F.coalesce("cost", F.lit(float("inf")))  # what cannot be reached at all is worst
    while len(kept) < limit:
        found = left.orderBy(order.desc(), "node").limit(page).collect()
        for row in found:
            if len(kept) < limit and all(math.hypot(row["x"] - k["x"], row["y"] - k["y"]) >= apart_m for k in kept):
                kept.append(row)
        if len(found) < page:
            break
        for k in kept:
            left = left.where(F.hypot(F.col("x") - k["x"], F.col("y") - k["y"]) >= apart_m)
        last = found[-1]
        edge = float("inf") if last["cost"] is None else last["cost"]
        left = left.where((order < edge) | ((order == edge) & (F.col("node") > last["node"])))
    return points.sparkSession.createDataFrame(kept, left.schema)


def graded(services: DataFrame) -> DataFrame:
    return services.withColumn("quality", snap_quality(F.col("distance_m")))
