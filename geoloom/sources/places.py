"""Places and streets from tagged map data and from records of open-data datasets, as tables of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.exprs import first_nonempty, in_range, normalize_name, position_id, ring_area, ring_centroid, safe_id, to_lv95
from ..operators import routing, spatial

# The tags of the categories, the least area of area places, access that is closed to the public, the tolerance of outlines.
TAGS = {
    "grocery": {"shop": ["supermarket", "convenience", "greengrocer", "grocery"]},
    "pharmacy": {"amenity": ["pharmacy"]},
    "healthcare": {"amenity": ["doctors", "clinic", "hospital"], "healthcare": ["doctor", "centre", "general"]},
    "park": {"leisure": ["park"], "landuse": ["village_green", "recreation_ground"]},
    "library": {"amenity": ["library"]},
}
AREA_ONLY = {"park": 500.0}
CLOSED = ["private", "no", "permit"]
OUTLINE_M = 5.0

RING = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))


def first_scalar(c: Column) -> Column:
    """The first of a tag's values, which may be a list; null where there is none."""
    return F.try_element_at(c, F.lit(1))


def network_of(nodes: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A street network from map nodes (id, lon, lat) and ways (u, v, tags: map of lists).

    Nodes without usable coordinates go, and with them their ways; of parallel and reversed ways the shortest stays; a way
    without a length has the straight distance of its ends.
    """
    kept = nodes.where(in_range(F.col("lon"), F.col("lat"))).select(F.col("id").cast("string").alias("node"), "lon", "lat")
    east, north = to_lv95(F.col("lon"), F.col("lat"))
    told = ways.select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), first_scalar(F.try_element_at("tags", F.lit("length"))).try_cast("double").alias("length_m"))
    return kept, routing.shortest_parallel(routing.repaired_lengths(told, kept.withColumns({"x": east, "y": north})))


def _metric(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(to_lv95(p["x"], p["y"])[0].alias("x"), to_lv95(p["x"], p["y"])[1].alias("y")))


@F.udf(RING, useArrow=True)
def simplified(ring, tolerance):
    """The outline with corners left out that lie within ``tolerance`` of the line between kept ones (Douglas and Peucker); one ring a call."""
    if ring is None or len(ring) < 4:
        return ring
    keep, todo = {0, len(ring) - 1}, [(0, len(ring) - 1)]
    far = max(range(len(ring)), key=lambda i: (ring[i]["x"] - ring[0]["x"]) ** 2 + (ring[i]["y"] - ring[0]["y"]) ** 2)
    if 0 < far < len(ring) - 1:  # a closed ring is cut at its first corner and the one furthest from it
        keep.add(far)
        todo = [(0, far), (far, len(ring) - 1)]
    while todo:
        a, b = todo.pop()
        p, q = ring[a], ring[b]
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        length = (dx * dx + dy * dy) ** 0.5
        away = [(abs(dx * (ring[i]["y"] - p["y"]) - dy * (ring[i]["x"] - p["x"])) / length if length else ((ring[i]["x"] - p["x"]) ** 2 + (ring[i]["y"] - p["y"]) ** 2) ** 0.5, -i) for i in range(a + 1, b)]
        if away and max(away)[0] > tolerance:
            i = -max(away)[1]
            keep.add(i)
            todo += [(a, i), (i, b)]
    return [ring[i] for i in sorted(keep)]


def tagged(raw: DataFrame, plan: dict = TAGS, area_only: dict = AREA_ONLY) -> DataFrame:
    """Services from features (id, tags: map, lon, lat, and ring for areas): id, category, name, lon, lat, area_m2, ring.

    A feature counts for every category whose tags it has. In a category that wants areas, points, areas under its least size and
    places closed to the public go. An area stands at a point inside it and keeps its outline without corners that matter
    less than 5 m.
    """
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    matches = [F.when(F.reduce(F.array(*(F.coalesce(tag(k).isin(*v), F.lit(False)) for k, v in keys.items())), F.lit(False), lambda s, x: s | x), F.lit(c)) for c, keys in plan.items()]
    rows = raw.withColumn("category", F.explode(F.array_compact(F.array(*matches))))
    rows = rows.withColumn("metric", _metric(F.col("ring"))).withColumn("area_m2", F.when(F.col("ring").isNotNull(), ring_area(F.col("metric"))))
    least = F.create_map(*(F.lit(x) for kv in area_only.items() for x in kv))
    wanted = F.try_element_at(least, F.col("category"))
    fine = wanted.isNull() | ((F.col("area_m2") >= wanted) & ~F.coalesce(F.lower(tag("access")).isin(*CLOSED), F.lit(False)))
    rows = rows.where(fine)
    inner = spatial.interior_point(rows.where("ring is not null").select(F.col("id").alias("area"), "ring").dropDuplicates(["area"])).select(F.col("area").alias("id"), F.col("x").alias("ix"), F.col("y").alias("iy"))
    rows = rows.join(inner, "id", "left")
    corners = simplified(F.col("metric"), F.lit(OUTLINE_M))
    return rows.select(
        safe_id(F.lit("service"), F.col("category"), F.lit("map"), F.col("id").cast("string")).alias("id"), "category", normalize_name(tag("name")).alias("name"), F.coalesce("ix", "lon").alias("lon"), F.coalesce("iy", "lat").alias("lat"),
        F.round("area_m2").cast("long").alias("area_m2"), F.when(F.col("ring").isNotNull(), corners).alias("outline"),
    )


def point_of(geometry: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a GeoJSON geometry (text): a point's own, else the centroid of its first ring; null where it does not parse."""
    kind = F.get_json_object(geometry, "$.type")
    ring = F.transform(F.from_json(F.get_json_object(geometry, "$.coordinates[0]"), "array<array<double>>"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    x, y = ring_centroid(ring)
    usable = (kind == "Polygon") & (F.size(ring) >= 4)
    at = lambda i: F.get_json_object(geometry, f"$.coordinates[{i}]").try_cast("double")
    return F.when(kind == "Point", at(0)).when(usable, x), F.when(kind == "Point", at(1)).when(usable, y)


def dataset_places(records: DataFrame, category: str, dataset: str, name_keys: list[str], id_keys: list[str]) -> DataFrame:
    """Services from a dataset's records (value: JSON text): id, category, name, lon, lat. A record without own key is named by its place."""
    field = lambda k: F.get_json_object("value", f"$.{k}")
    geometry = F.coalesce(field("geo_shape.geometry"), field("geometry"))
    lon, lat = point_of(geometry)
    point = F.get_json_object("value", "$.geo_point_2d.lon").try_cast("double"), F.get_json_object("value", "$.geo_point_2d.lat").try_cast("double")
    rows = records.select("value", F.coalesce(lon, point[0]).alias("lon"), F.coalesce(lat, point[1]).alias("lat")).where(in_range(F.col("lon"), F.col("lat")))
    place = position_id(F.format_string("%.7f", F.col("lon")), F.format_string("%.7f", F.col("lat")))
    names = F.coalesce(*(normalize_name(field(k)) for k in name_keys))
    own = F.coalesce(first_nonempty(*(field(k) for k in id_keys)), place)
    return rows.select(safe_id(F.lit("service"), F.lit(category), F.lit("data"), F.lit(dataset), own).alias("id"), F.lit(category).alias("category"), names.alias("name"), "lon", "lat")
