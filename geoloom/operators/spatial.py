"""Spatial joins: containment, range, nearest neighbour, proximity, adjacency. Cells make them equi-joins; exact tests follow."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import crosses_ring, edges_of, haversine_m, inside, snap_quality


def with_bounds(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return polygons.withColumns({"x0": F.array_min(x), "x1": F.array_max(x), "y0": F.array_min(y), "y1": F.array_max(y)})


def contained(points: DataFrame, polygons: DataFrame, cell: float, boundary: bool = False) -> DataFrame:
    """(point, area) with the first area (by ``ord``) that holds the point; both sides meet in grid cells."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    tiles = with_bounds(polygons).select("*", span("x0", "x1").alias("cx")).select("*", span("y0", "y1").alias("cy"))
    at = points.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    box = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return at.join(tiles, ["cx", "cy"]).where(box & inside(F.col("x"), F.col("y"), F.col("ring"), boundary)).groupBy("point").agg(F.min_by("area", "ord").alias("area"))


def in_box(points: DataFrame, west: float, south: float, east: float, north: float, x: str = "x", y: str = "y") -> DataFrame:
    """Points inside a box or on its sides; a range on two columns, which reaches the scan."""
    return points.where(F.col(x).between(west, east) & F.col(y).between(south, north))


def segments_in(segments: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """(u, v, area) of segments (u, v, ax, ay, bx, by) that meet an area: an end lies in it or on its boundary, or they cross it.

    A segment and an area meet in the grid cells that both boxes cover; segments are short against areas.
    """
    low, high = (lambda a, b: F.floor(F.least(a, b) / cell)), (lambda a, b: F.floor(F.greatest(a, b) / cell))
    span = lambda a, b: F.explode(F.sequence(low(a, b), high(a, b)))
    tiles = with_bounds(polygons).select("area", "ring", "y0", "y1", span("x0", "x1").alias("cx")).select("area", "ring", "cx", span("y0", "y1").alias("cy"))
    parts = segments.select("*", span("ax", "bx").alias("cx")).select("*", span("ay", "by").alias("cy"))
    meet = inside(F.col("ax"), F.col("ay"), F.col("ring"), True) | inside(F.col("bx"), F.col("by"), F.col("ring"), True) | crosses_ring(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.col("ring"))
    return parts.join(tiles, ["cx", "cy"]).where(meet).select("u", "v", "area").distinct()


def _near_cells(df: DataFrame, cell: float) -> DataFrame:
    near = lambda c: F.explode(F.array(*(F.floor(F.col(c) / cell) + d for d in (-1, 0, 1))))
    return df.select("*", near("x").alias("cx")).select("*", near("y").alias("cy"))


def within_distance(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(left id, right id, distance) of points (id, x, y) at most ``radius`` apart; cells of the radius's width."""
    a = left.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    b = _near_cells(right, radius).select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy")
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return a.join(b, ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius).select("a", "b", "distance")


def within_haversine(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Like within_distance for points (id, lon, lat), in metres on the sphere; cells in degrees of latitude, wide enough for longitudes up to 80 degrees north or south."""
    deg = math.degrees(radius_m / 6_371_000.0)
    wide = deg / math.cos(math.radians(80))
    a = left.select(F.col("id").alias("a"), F.col("lon").alias("alon"), F.col("lat").alias("alat"), F.floor(F.col("lon") / wide).alias("cx"), F.floor(F.col("lat") / deg).alias("cy"))
    cells = lambda c, w: F.explode(F.array(*(F.floor(F.col(c) / w) + d for d in (-1, 0, 1))))
    b = right.select("*", cells("lon", wide).alias("cx")).select(F.col("id").alias("b"), F.col("lon").alias("blon"), F.col("lat").alias("blat"), "cx", cells("lat", deg).alias("cy"))
    d = haversine_m(F.col("alon"), F.col("alat"), F.col("blon"), F.col("blat"))
    return a.join(b, ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius_m).select("a", "b", "distance")


def snapped(points: DataFrame, nodes: DataFrame, most: float = 500.0, poor: float = 150.0) -> DataFrame:
    """(id, node, distance, quality): the nearest node (ties: the least) up to ``most`` away, else unreachable without node."""
    near = within_distance(points, nodes.select(F.col("node").alias("id"), "x", "y"), most)
    best = near.groupBy(F.col("a").alias("id")).agg(F.min(F.struct("distance", "b")).alias("m"))
    return points.select("id").join(best, "id", "left").select("id", F.col("m.b").alias("node"), F.col("m.distance").alias("distance"), F.when(F.col("m").isNull(), "unreachable").otherwise(snap_quality(F.col("m.distance"), poor, most)).alias("quality"))


def snapped_outline(services: DataFrame, nodes: DataFrame, most: float = 500.0, poor: float = 150.0, vertices: int = 400) -> DataFrame:
    """``snapped`` for services (id, x, y, ring): an area service takes the nearest node of its outline's first ``vertices`` corners
    where that is nearer than the one of its own place. Corners are rows, so one join snaps all of them."""
    corners = services.where("ring is not null").select("id", F.explode(F.slice("ring", 1, vertices)).alias("p")).select("id", "p.x", "p.y")
    near = within_distance(services.select("id", "x", "y").unionByName(corners), nodes.select(F.col("node").alias("id"), "x", "y"), most)
    best = near.groupBy(F.col("a").alias("id")).agg(F.min(F.struct("distance", "b")).alias("m"))
    grade = F.when(F.col("m").isNull(), "unreachable").otherwise(snap_quality(F.col("m.distance"), poor, most))
    return services.select("id").join(best, "id", "left").select("id", F.col("m.b").alias("node"), F.col("m.distance").alias("distance"), grade.alias("quality"))


def duplicate_pairs(services: DataFrame, radius: float = 25.0) -> DataFrame:
    """Pairs of services (id, x, y, category, key) of one category within ``radius`` whose name keys agree or are missing on one side."""
    pairs = within_distance(services, services, radius).where("a < b")
    side = lambda n: services.select(F.col("id").alias(n), F.col("category").alias(f"c{n}"), F.col("key").alias(f"k{n}"))
    same = pairs.join(side("a"), "a").join(side("b"), "b").where("ca = cb")
    return same.where(F.col("ka").isNull() | F.col("kb").isNull() | (F.col("ka") == F.col("kb"))).select("a", "b", "distance")


def keep_first(rows: DataFrame, key: str = "id", order: str = "_ord") -> DataFrame:
    first = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def adjacent(polygons: DataFrame) -> DataFrame:
    """(src, dst, shared): areas that share boundary segments, both directions, with the shared length; by equal segments, whichever way round."""
    e = polygons.select("area", F.explode(edges_of(F.col("ring"))).alias("e")).select("area", F.col("e.a").alias("p"), F.col("e.b").alias("q"))
    seg = e.select("area", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    both = seg.join(seg.select(F.col("area").alias("dst"), "p", "q"), ["p", "q"]).where("area <> dst")
    length = F.hypot(F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y"))
    return both.groupBy(F.col("area").alias("src"), "dst").agg(F.sum(length).alias("shared"))


def interior_point(polygons: DataFrame) -> DataFrame:
    """A point inside each ring: the middle of the widest stretch of the scan line through the middle of its height."""
    y = (F.col("y0") + F.col("y1")) / 2
    hits = with_bounds(polygons).withColumn("my", y + (F.col("y1") - F.col("y0")) * 1e-9)
    crossing = F.filter(edges_of(F.col("ring")), lambda e: (e["a"]["y"] > F.col("my")) != (e["b"]["y"] > F.col("my")))
    at = F.array_sort(F.transform(crossing, lambda e: e["a"]["x"] + (F.col("my") - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])))
    spans = F.transform(F.sequence(F.lit(1), F.floor(F.size("at") / 2).cast("int")), lambda i: F.struct((F.element_at("at", (2 * i).cast("int")) - F.element_at("at", (2 * i - 1).cast("int"))).alias("w"), ((F.element_at("at", (2 * i).cast("int")) + F.element_at("at", (2 * i - 1).cast("int"))) / 2).alias("x")))
    return hits.withColumn("at", at).select("area", F.array_max(spans)["x"].alias("x"), F.col("my").alias("y"))


def touching(polygons: DataFrame, cell: float) -> DataFrame:
    """(src, dst, shared): areas whose boundaries meet, be it in one point, both directions, with the length they share (0 for points).

    Boundary segments meet in grid cells; each pair of segments counts once, however many cells it shares.
    """
    e = polygons.select("area", "ord", F.posexplode(edges_of(F.col("ring"))).alias("i", "e")).select("area", "ord", "i", *(F.col(f"e.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"))
    span = lambda c: F.explode(F.sequence(F.floor(F.least(f"a{c}", f"b{c}") / cell), F.floor(F.greatest(f"a{c}", f"b{c}") / cell)))
    tiles = e.select("*", span("x").alias("cx")).select("*", span("y").alias("cy"))
    other = tiles.select("cx", "cy", F.col("area").alias("dst"), F.col("ord").alias("ord2"), F.col("i").alias("i2"), F.col("ax").alias("cx0"), F.col("ay").alias("cy0"), F.col("bx").alias("dx0"), F.col("by").alias("dy0"))
    near = tiles.join(other, ["cx", "cy"]).where("ord < ord2").dropDuplicates(["area", "i", "dst", "i2"])
    at = lambda p, x, y: (F.col("bx") - F.col("ax")) * (y - F.col("ay")) - (F.col("by") - F.col("ay")) * (x - F.col("ax")) if p == "ab" else (F.col("dx0") - F.col("cx0")) * (y - F.col("cy0")) - (F.col("dy0") - F.col("cy0")) * (x - F.col("cx0"))
    sides = near.withColumns({"o1": at("ab", F.col("cx0"), F.col("cy0")), "o2": at("ab", F.col("dx0"), F.col("dy0")), "o3": at("cd", F.col("ax"), F.col("ay")), "o4": at("cd", F.col("bx"), F.col("by"))})
    boxes = (F.least("ax", "bx") <= F.greatest("cx0", "dx0")) & (F.least("cx0", "dx0") <= F.greatest("ax", "bx")) & (F.least("ay", "by") <= F.greatest("cy0", "dy0")) & (F.least("cy0", "dy0") <= F.greatest("ay", "by"))
    meet = sides.where(boxes & (F.signum("o1") * F.signum("o2") <= 0) & (F.signum("o3") * F.signum("o4") <= 0))
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    along = lambda x, y: ((F.col(x) - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col(y) - F.col("ay")) * (F.col("by") - F.col("ay"))) / F.nullif(length, F.lit(0.0))
    c, d = along("cx0", "cy0"), along("dx0", "dy0")
    overlap = F.when((F.col("o1") == 0) & (F.col("o2") == 0), F.greatest(F.lit(0.0), F.least(length, F.greatest(c, d)) - F.greatest(F.lit(0.0), F.least(c, d)))).otherwise(0.0)
    one = meet.groupBy(F.col("area").alias("src"), "dst").agg(F.sum(F.coalesce(overlap, F.lit(0.0))).alias("shared"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "shared"))
