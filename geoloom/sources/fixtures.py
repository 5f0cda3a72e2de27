"""Small deterministic inputs: a street grid with a barrier, areas, a timetable."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The grid, the rows where the barrier is open on foot, the areas, and the trips below.
COLUMNS, ROWS, EDGE_M = 7, 5, 450.0


def grid_nodes(spark: SparkSession) -> DataFrame:
    n = spark.range(COLUMNS * ROWS).select(F.col("id").alias("node"))
    i, j = F.col("node") % COLUMNS, F.floor(F.col("node") / COLUMNS)
    return n.select("node", (i * EDGE_M).alias("x"), (j * EDGE_M).cast("double").alias("y"))


def grid_edges(spark: SparkSession, mode: str) -> DataFrame:
    """Neighbours in a grid of 7 by 5; on foot the columns 2 and 3 meet in rows 1 and 4 only."""
    n = spark.range(COLUMNS * ROWS).select("id", (F.col("id") % COLUMNS).alias("i"), F.floor(F.col("id") / COLUMNS).alias("j"))
    across = n.where(F.col("i") < COLUMNS - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), "i", "j")
    if mode == "walk":
        across = across.where("i <> 2 or j in (1, 4)")
    up = n.where(F.col("j") < ROWS - 1).select(F.col("id").alias("u"), (F.col("id") + COLUMNS).alias("v"))
    return across.select("u", "v").unionByName(up).withColumn("length_m", F.lit(EDGE_M))


AREAS = [("west", 0, [(-10.0, -10.0), (1100.0, -10.0), (1100.0, 2000.0), (-10.0, 2000.0), (-10.0, -10.0)]), ("east", 1, [(1100.0, -10.0), (2800.0, -10.0), (2800.0, 2000.0), (1100.0, 2000.0), (1100.0, -10.0)])]


def areas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, o, [{"x": x, "y": y} for x, y in r]) for a, o, r in AREAS], "area string, ord int, ring array<struct<x:double,y:double>>")


def clock(text: str) -> int:
    h, m = text.split(":")
    return int(h) * 3600 + int(m) * 60


def trips_and_calls() -> tuple[list, list]:
    """Trips (trip, route, service) and calls (trip, seq, stop, arr, dep)."""
    trips, calls = [], []

    def add(trip, route, service, *stops):
        trips.append((trip, route, service))
        calls.extend((trip, i, s, t, t) for i, (s, t) in enumerate(stops))

    for k in range(6):
        t = clock("9:45") + 600 * k
        add(f"T1-{k}", "T1", "weekday", ("A", t), ("B", t + 240), ("C", t + 480))
    for k, at in enumerate(("10:12", "10:32")):
        add(f"T2-{k}", "T2", "weekday", ("B", clock(at)), ("D", clock(at) + 240))
    add("W1", "W1", "weekend", ("A", clock("10:05")), ("D", clock("10:05") + 360))
    add("N1", "N1", "daily", ("A", clock("25:05")), ("C", clock("25:05") + 480))
    return trips, calls


def timetable(spark: SparkSession) -> dict[str, DataFrame]:
    trips, calls = trips_and_calls()
    week = {"weekday": [1, 1, 1, 1, 1, 0, 0], "weekend": [0, 0, 0, 0, 0, 1, 1], "daily": [1] * 7}
    first, last, special = date(2026, 1, 1), date(2026, 12, 31), date(2026, 7, 1)
    return {
        "trips": spark.createDataFrame(trips, "trip string, route string, service string"),
        "stop_times": spark.createDataFrame(calls, "trip string, pos int, stop string, arr int, dep int"),
        "calendar": spark.createDataFrame([(s, d, first, last) for s, d in week.items()], "service string, days array<int>, start date, end date"),
        "exceptions": spark.createDataFrame([("weekday", special, 2), ("weekend", special, 1)], "service string, date date, type int"),
        "transfers": spark.createDataFrame([("C", "D", 330), ("D", "C", 330)], "src string, dst string, seconds int"),
    }


# Fixed values of a small city: areas by their corners, residents, services (category, name, lon, lat), stops, routes, schools, accidents.
CITY_AREAS = [("area:a", "Fixture West", "a", 7.57, 7.59), ("area:b", "Fixture East", "b", 7.59, 7.61)]
SOUTH, NORTH = 47.55, 47.565
RESIDENTS = [("a", 2024, 10000, 2000, 2200, 6000, 2000, 500), ("a", 2025, 10200, 2100, 2300, 6000, 2100, 520), ("b", 2024, 4000, 400, 450, 2600, 1000, 260), ("b", 2025, 4100, 420, 470, 2650, 1030, 270)]
SERVICES = [
    ("grocery", "Fixture Grocery West", 7.5745, 47.5505),
    ("grocery", "Fixture Grocery Centre", 7.5865, 47.5585),
    ("grocery", "Fixture Grocery East", 7.6045, 47.5585),
    ("pharmacy", "Fixture Pharmacy Centre", 7.5805, 47.5585),
    ("pharmacy", "Fixture Pharmacy East", 7.6045, 47.5625),
    ("healthcare", "Fixture Practice", 7.5865, 47.5545),
    ("school", "Fixture School One", 7.582, 47.557),
    ("school", "Fixture School Two", 7.6, 47.558),
    ("park", None, 7.5745, 47.5585),
    ("sport", "Fixture Sports Hall", 7.5925, 47.5505),
    ("library", "Fixture Library", 7.5805, 47.5545),
    ("culture", "Fixture Museum", 7.5865, 47.5625),
]
STOPS = [("stopA", "Fixture A", 47.55, 7.574), ("stopB", "Fixture B", 47.55, 7.592), ("stopC", "Fixture C", 47.558, 7.604), ("stopD", "Fixture D", 47.562, 7.604)]
ROUTES = [("T1", "8", "Fixture tram line", 900, "Fixture Transit"), ("T2", "30", "Fixture bus line", 700, "Fixture Transit"), ("W1", "2", "Fixture weekend tram", 900, "Fixture Transit"), ("N1", "N1", "Fixture night bus", 700, "Fixture Transit")]
SCHOOLS = [("school:1", 7.582, 47.557), ("school:2", 7.6, 47.558)]
ACCIDENTS = [("accident:1", 7.583, 47.558), ("accident:2", 7.584, 47.556), ("accident:3", 7.601, 47.559)]
WEST, STEP_LON, STEP_LAT = 7.574, 0.006, 0.004


def city_network(spark: SparkSession, mode: str) -> tuple[DataFrame, DataFrame]:
    """The grid in degrees; lengths are left open, so that they come from the nodes' places."""
    prefix = {"walk": "fixture"}.get(mode, mode)
    name = lambda n: F.concat_ws(":", F.lit(prefix), n % COLUMNS, F.floor(n / COLUMNS))
    k = F.col("node")
    nodes = grid_nodes(spark).select(name(k).alias("node"), (F.lit(WEST) + (k % COLUMNS) * STEP_LON).alias("lon"), (F.lit(SOUTH) + F.floor(k / COLUMNS) * STEP_LAT).alias("lat"))
    return nodes, grid_edges(spark, mode).select(name(F.col("u")).alias("u"), name(F.col("v")).alias("v"), F.lit(None).cast("double").alias("length_m"))


def city(spark: SparkSession):
    """The small city as inputs of the graph builder."""
    from ..city import City

    corners = lambda w, e: [{"x": x, "y": y} for x, y in ((w, SOUTH), (e, SOUTH), (e, NORTH), (w, NORTH), (w, SOUTH))]
    areas_ = spark.createDataFrame([(a, i, name, wov, corners(w, e)) for i, (a, name, wov, w, e) in enumerate(CITY_AREAS)], "area string, ord int, name string, wov_id string, ring array<struct<x:double,y:double>>")
    services = [(f"service:{c}:fixture:{i}", i, c, name, lon, lat, "synthetic fixture") for i, (c, name, lon, lat) in enumerate(SERVICES)]
    t = timetable(spark)
    station = F.concat(F.lit("stop"), F.col("stop"))
    t |= {
        "stop_times": t["stop_times"].withColumn("stop", station),
        "transfers": t["transfers"].select(F.concat(F.lit("stop"), "src").alias("src"), F.concat(F.lit("stop"), "dst").alias("dst"), "seconds"),
        "stops": spark.createDataFrame(STOPS, "stop string, name string, lat double, lon double"),
        "routes": spark.createDataFrame(ROUTES, "route string, short_name string, long_name string, route_type int, agency string"),
    }
    return City(
        spark,
        areas_,
        spark.createDataFrame(RESIDENTS, "wov_id string, year int, total long, children long, young long, working_age long, elderly long, elderly_80_plus long"),
        spark.createDataFrame(services, "id string, ord long, category string, name string, lon double, lat double, source string"),
        {m: city_network(spark, m) for m in ("walk", "bike")},
        t,
        spark.createDataFrame(SCHOOLS, "id string, lon double, lat double"),
        spark.createDataFrame(ACCIDENTS, "id string, lon double, lat double"),
    )


def page_of(offset: int, limit: int, order_by: str | None = None) -> list[dict]:
    """A service of 253 records that knows no order."""
    from .readers import BadRequest

    if order_by:
        raise BadRequest(order_by)
    return [{"k": k, "name": f"record {k}"} for k in range(offset, min(offset + limit, 253))]


# The size of a published city (walking nodes, cycling nodes, areas, services, stops, lines, trips a line and day).
SIZES = {"walk": 119, "bike": 77}
LARGE_AREAS, LARGE_SERVICES, LARGE_STOPS, LARGE_LINES, LARGE_TRIPS = (7, 3), 1308, 283, 200, 100


def large_city(spark: SparkSession):
    """A city of the published size: 14,161 and 5,929 street nodes, 21 areas, 1,308 services, 20,000 trips of 12 calls a day."""
    from ..catalog import CATEGORY_LABELS
    from ..city import City

    wide, high = 0.14, 0.105  # degrees
    k = F.col("id")

    def network(mode: str) -> tuple[DataFrame, DataFrame]:
        n = SIZES[mode]
        name = lambda x: F.concat(F.lit(f"{mode}:"), x)
        at = spark.range(n * n)
        nodes = at.select(name(k).alias("node"), (F.lit(WEST) + k % n * (wide / (n - 1))).alias("lon"), (F.lit(SOUTH) + F.floor(k / n) * (high / (n - 1))).alias("lat"))
        across, up = at.where(k % n < n - 1).select(k.alias("u"), (k + 1).alias("v")), at.where(k < n * (n - 1)).select(k.alias("u"), (k + n).alias("v"))
        return nodes, across.unionByName(up).select(name(F.col("u")).alias("u"), name(F.col("v")).alias("v"), F.lit(None).cast("double").alias("length_m"))

    def spread(x, a: int, b: int):
        return (F.lit(WEST) + x * a % 9973 / 9973 * wide), (F.lit(SOUTH) + x * b % 9967 / 9967 * high)

    nx, ny = LARGE_AREAS
    corner = lambda i, j: {"x": WEST + i * wide / nx, "y": SOUTH + j * high / ny}
    ring = lambda i, j: [corner(i, j), corner(i + 1, j), corner(i + 1, j + 1), corner(i, j + 1), corner(i, j)]
    areas_ = spark.createDataFrame([(f"area:{i}-{j}", i * ny + j, f"Area {i}-{j}", f"{i}-{j}", ring(i, j)) for i in range(nx) for j in range(ny)], "area string, ord int, name string, wov_id string, ring array<struct<x:double,y:double>>")
    lon, lat = spread(k + 1, 5741, 3301)
    category = F.element_at(F.array(*map(F.lit, CATEGORY_LABELS)), (k % 8 + 1).cast("int"))
    services = spark.range(LARGE_SERVICES).select(F.concat(F.lit("service:"), k).alias("id"), k.alias("ord"), category.alias("category"), F.concat(F.lit("Place "), k).alias("name"), lon.alias("lon"), lat.alias("lat"), F.lit("made up").alias("source"))
    lon, lat = spread(k + 1, 7919, 4099)
    stops = spark.range(LARGE_STOPS).select(F.concat(F.lit("stop"), k).alias("stop"), F.concat(F.lit("Stop "), k).alias("name"), lat.alias("lat"), lon.alias("lon"))
    line, run = F.floor(k / LARGE_TRIPS), k % LARGE_TRIPS
    trips = spark.range(LARGE_LINES * LARGE_TRIPS).select(F.concat_ws("-", F.lit("t"), line, run).alias("trip"), F.concat(F.lit("l"), line).alias("route"), F.lit("daily").alias("service"))
    calls = spark.range(LARGE_LINES * LARGE_TRIPS * 12).select(F.floor(k / 12).alias("id"), (k % 12).cast("int").alias("pos"))
    at = (F.lit(5 * 3600) + run * 720 + line % 12 * 60 + F.col("pos") * 120).cast("int")
    calls = calls.select(F.concat_ws("-", F.lit("t"), line, run).alias("trip"), "pos", F.concat(F.lit("stop"), (line * 37 + F.col("pos") * (line % 7 + 1)) % LARGE_STOPS).alias("stop"), at.alias("arr"), at.alias("dep"))
    t = timetable(spark)
    t = {"calendar": t["calendar"], "exceptions": t["exceptions"], "transfers": spark.createDataFrame([], "src string, dst string, seconds int"), "trips": trips, "stop_times": calls, "stops": stops}
    t["routes"] = spark.range(LARGE_LINES).select(F.concat(F.lit("l"), k).alias("route"), F.col("id").cast("string").alias("short_name"), F.lit("").alias("long_name"), F.lit(900).alias("route_type"), F.lit("Made up").alias("agency"))
    people = areas_.select("wov_id", F.lit(2025).alias("year"), *((F.lit(1000) + F.col("ord") * 10).cast("long").alias(c) for c in ("total", "children", "young", "working_age", "elderly", "elderly_80_plus")))
    return City(spark, areas_, people, services, {m: network(m) for m in SIZES}, t)
