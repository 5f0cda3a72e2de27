"""A zipped timetable feed, cut to a box and turned into the tables of a timetable.

Every step is a join or a group; the calls of a trip meet in one group, which a trip bounds. Small tables
shrink the large one by semi joins, which Spark broadcasts where they are small enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataUnavailableError
from ..functions.exprs import parse_service_date, parse_service_time, to_lv95
from ..operators import spatial, transit
from .readers import zip_member

WEEK = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
TRANSFER_RADIUS_M = 300.0


def _clean(df: DataFrame) -> DataFrame:
    """Trimmed texts; empty ones are null."""
    return df.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) for c in df.columns))


def extract(spark: SparkSession, path: str | DataFrame, box: tuple[float, float, float, float]) -> dict[str, DataFrame]:
    """stops, routes, trips, stop_times, calendar, exceptions, transfers of the stations inside ``box`` (south, west, north, east), and rejected rows by file.

    Platforms count as their parent station, placed at the mean of its platforms. Of a trip's calls those inside the
    box stay, without repeats of a station and without times that run backwards; trips of two calls or more with a known
    route stay. Transfers are the official ones between different stations and walks of up to 300 m, the shorter of both.
    """
    read = lambda name, *cols: _clean(zip_member(spark, path, f"{name}.txt", list(cols)))
    south, west, north, east = box
    raw = read("stops", "stop_id", "stop_name", "stop_lat", "stop_lon", "parent_station").withColumns({"lat": F.col("stop_lat").try_cast("double"), "lon": F.col("stop_lon").try_cast("double")})
    bad_stop = F.col("lat").isNull() | F.col("lon").isNull() | F.col("stop_id").isNull()
    inside = raw.where(~bad_stop & F.col("lat").between(south, north) & F.col("lon").between(west, east)).withColumn("station", F.coalesce("parent_station", "stop_id"))
    station_of = inside.select("stop_id", "station")
    own = F.struct((F.col("stop_id") != F.col("station")).alias("other"), "stop_id", "stop_name")
    stops = inside.groupBy(F.col("station").alias("stop")).agg(F.min(F.when(F.col("stop_name").isNotNull(), own)).alias("m"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.slice(F.array_sort(F.collect_set("stop_id")), 1, 8).alias("source_ids"))
    stops = stops.select("stop", F.coalesce("m.stop_name", "stop").alias("name"), "lat", "lon", "source_ids")

    calls = read("stop_times", "trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time").join(station_of, "stop_id")
    arr = parse_service_time(F.col("arrival_time"))
    dep = F.when(F.col("departure_time").isNull(), arr).otherwise(parse_service_time(F.col("departure_time")))
    calls = calls.select(F.col("trip_id").alias("trip"), F.col("stop_sequence").try_cast("int").alias("seq"), F.col("station").alias("stop"), arr.alias("arr"), dep.alias("dep"))
    bad_call = F.col("arr").isNull() | F.col("dep").isNull() | F.col("seq").isNull()
    folded = transit.folded_calls(calls.where(~bad_call))

    agencies = read("agency", "agency_id", "agency_name").dropDuplicates(["agency_id"])
    routes = read("routes", "route_id", "route_short_name", "route_long_name", "route_type", "agency_id").dropDuplicates(["route_id"])
    trips = read("trips", "trip_id", "route_id", "service_id", "trip_headsign").dropDuplicates(["trip_id"])
    trips = trips.join(routes.select("route_id"), "route_id", "left_semi").join(folded.select(F.col("trip").alias("trip_id")).distinct(), "trip_id", "left_semi")
    trips = trips.select(F.col("trip_id").alias("trip"), F.col("route_id").alias("route"), F.col("service_id").alias("service"), F.col("trip_headsign").alias("headsign"))
    if not trips.limit(1).count():
        raise DataUnavailableError("no usable trip lies inside the box", box=box)
    kind = F.coalesce(F.col("route_type").try_cast("int"), F.lit(3))
    lines = routes.join(trips.select(F.col("route").alias("route_id")).distinct(), "route_id", "left_semi").join(agencies, "agency_id", "left")
    lines = lines.select(F.col("route_id").alias("route"), F.coalesce("route_short_name", F.lit("")).alias("short_name"), F.coalesce("route_long_name", F.lit("")).alias("long_name"), kind.alias("route_type"), F.col("agency_name").alias("agency"))

    services = trips.select("service").distinct()
    days = F.array(*(F.when(F.col(d) == "1", 1).otherwise(0) for d in WEEK))
    first, last = (F.coalesce(parse_service_date(F.col(c)), F.to_date(F.lit(d))) for c, d in (("start_date", "1900-01-01"), ("end_date", "2100-12-31")))
    calendar = read("calendar", "service_id", *WEEK, "start_date", "end_date").select(F.col("service_id").alias("service"), days.alias("days"), first.alias("start"), last.alias("end")).join(services, "service", "left_semi")
    told = read("calendar_dates", "service_id", "date", "exception_type").select(F.col("service_id").alias("service"), parse_service_date(F.col("date")).alias("date"), F.col("exception_type").try_cast("int").alias("type")).join(services, "service", "left_semi")
    bad_date = F.col("date").isNull() | F.col("type").isNull()

    side = lambda c, to: station_of.select(F.col("stop_id").alias(c), F.col("station").alias(to))
    official = read("transfers", "from_stop_id", "to_stop_id", "min_transfer_time").join(side("from_stop_id", "src"), "from_stop_id").join(side("to_stop_id", "dst"), "to_stop_id")
    official = official.select("src", "dst", F.col("min_transfer_time").try_cast("int").alias("seconds"))
    x, y = to_lv95(F.col("lon"), F.col("lat"))
    at = stops.select(F.col("stop").alias("id"), x.alias("x"), y.alias("y"))
    walks = transit.geometric_transfers(spatial.within_distance(at, at, TRANSFER_RADIUS_M).where("distance > 0"))

    rejected = lambda name, df, bad: df.agg(F.count_if(bad).alias("rows")).select(F.lit(name).alias("file"), "rows")
    return {
        "stops": stops,
        "routes": lines,
        "trips": trips,
        "stop_times": folded.join(trips.select("trip"), "trip", "left_semi"),
        "calendar": calendar,
        "exceptions": told.where(~bad_date),
        "transfers": transit.minimal_transfers(official, walks),
        "rejected": rejected("stops", raw, bad_stop).unionByName(rejected("stop_times", calls, bad_call)).unionByName(rejected("calendar_dates", told, bad_date)),
    }
