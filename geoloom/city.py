"""A city as a typed graph: areas, residents, services, streets and a timetable, and what can be reached from where.

Stored relations come from joins in grid cells and on keys. Reach is never stored: it is computed for all areas
asked for at once, by walking, by bicycle, or by walking and riding.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import CATEGORY_LABELS, CITY, ESSENTIAL
from .errors import DataUnavailableError, QuerySpecError
from .functions.exprs import format_service_time, in_range, ring_area, share, to_lv95
from .graph import PropertyGraph
from .operators import questions, routing, spatial, transit

try:
    from zoneinfo import ZoneInfo

    ZONE = ZoneInfo("Europe/Zurich")
except Exception:  # no time zone data on this machine
    ZONE = None

# What the numbers of a feed's route types mean.
VEHICLES = {
    0: "Tram", 1: "Metro", 2: "Train", 3: "Bus", 4: "Ferry", 5: "Cable tram", 6: "Aerial lift", 7: "Funicular", 11: "Trolleybus", 12: "Monorail",
    100: "Train", 102: "Train", 103: "Train", 106: "Train", 109: "S-Bahn", 400: "Metro", 700: "Bus", 704: "Bus", 715: "On-demand bus", 900: "Tram",
    1000: "Ferry", 1300: "Aerial lift", 1400: "Funicular", 1501: "Shared taxi",
}
CELL_DEG = 0.01
MOST_SNAP_M = 1000.0
AGES = ("total", "children", "young", "working_age", "elderly", "elderly_80_plus")


def vehicle(route_type: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in VEHICLES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, route_type), F.lit("Transit"))


def parse_departure(value, now: datetime | None = None) -> datetime:
    """Nothing or "now", HH:MM, HH:MM:SS or an ISO time, as local time of the timetable."""
    now = now or (datetime.now(ZONE) if ZONE else datetime.now())
    if value in (None, "", "now"):
        return now
    if isinstance(value, datetime):
        return value.astimezone(ZONE) if value.tzinfo and ZONE else value
    text = str(value).strip()
    for form in ("%H:%M", "%H:%M:%S"):
        try:
            return datetime.combine(now.date(), datetime.strptime(text, form).time(), tzinfo=ZONE)
        except ValueError:
            pass
    try:
        told = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise QuerySpecError(f"cannot read the departure time {value!r}: HH:MM or ISO", departure_time=text) from None
    return told.astimezone(ZONE) if told.tzinfo and ZONE else told.replace(tzinfo=ZONE)


@dataclass(frozen=True)
class City:
    """Inputs. ``areas``: area, ord, name, wov_id, ring (points x, y in degrees). ``population``: wov_id, year and the age groups.
    ``services``: id, ord, category, name, lon, lat, source. ``networks``: by mode, nodes (node, lon, lat) and edges (u, v, length_m).
    ``timetable``: stops, routes, trips, stop_times, calendar, exceptions, transfers; None where there is none. ``schools``, ``accidents``: id, lon, lat."""

    spark: SparkSession
    areas: DataFrame
    population: DataFrame
    services: DataFrame
    networks: dict[str, tuple[DataFrame, DataFrame]]
    timetable: dict[str, DataFrame] | None = None
    schools: DataFrame | None = None
    accidents: DataFrame | None = None

    def prepared(self, path: str) -> PreparedCity:
        """This city with what every request needs written to ``path`` once: networks, attachments of services and stops, origins."""
        from .sources import caches

        made = {"access": self.access(), "origins": self.origins()} | ({"stop_access": self.stop_access()} if self.timetable and "walk" in self.networks else {})
        for m in self.networks:
            made |= {f"nodes_{m}": self.nodes(m), f"edges_{m}": self.edges(m)}
        caches.write_cache(self.spark, path, made)
        return PreparedCity(**{f.name: getattr(self, f.name) for f in fields(City)}, tables=caches.read_cache(self.spark, path, ("origins",))[0])

    # Places and networks

    @property
    def modes(self) -> list[str]:
        return [*self.networks, *(["transit"] if self.timetable and "walk" in self.networks else [])]

    @staticmethod
    def placed(points: DataFrame) -> DataFrame:
        """Points with usable coordinates, and their place in metres."""
        east, north = to_lv95(F.col("lon"), F.col("lat"))
        return points.where(in_range(F.col("lon"), F.col("lat"))).withColumns({"x": east, "y": north})

    def nodes(self, mode: str) -> DataFrame:
        return self.placed(self.networks[mode][0])

    def edges(self, mode: str) -> DataFrame:
        return routing.symmetric(routing.repaired_lengths(self.networks[mode][1], self.nodes(mode)))

    def area_of(self, points: DataFrame, boundary: bool = False) -> DataFrame:
        """(id, area) of points (id, lon, lat) strictly inside an area; the first area by order."""
        at = points.select(F.col("id").alias("point"), F.col("lon").alias("x"), F.col("lat").alias("y"))
        return spatial.contained(at, self.areas, CELL_DEG, boundary).withColumnRenamed("point", "id")

    def access(self) -> DataFrame:
        """(id, network, node, distance_m, quality) of each service on each network."""
        rows = self.placed(self.services)
        if "ring" in rows.columns:  # outlines of area services, in degrees
            metric = F.transform("ring", lambda p: F.struct(to_lv95(p["x"], p["y"])[0].alias("x"), to_lv95(p["x"], p["y"])[1].alias("y")))
            rows = rows.withColumn("ring", metric)
        snap = spatial.snapped_outline if "ring" in rows.columns else spatial.snapped
        one = lambda m: snap(rows, self.nodes(m)).select("id", F.lit(m).alias("network"), "node", F.col("distance").alias("distance_m"), "quality")
        return reduce(DataFrame.unionByName, (one(m) for m in self.networks))

    def _timetable(self) -> dict[str, DataFrame]:
        if not self.timetable:
            raise DataUnavailableError("no timetable is prepared", modes=self.modes)
        return self.timetable

    def stop_access(self) -> DataFrame:
        rows = self.placed(self._timetable()["stops"].withColumnRenamed("stop", "id"))
        return spatial.snapped(rows, self.nodes("walk")).select("id", "node", F.col("distance").alias("distance_m"), "quality")

    def origins(self) -> DataFrame:
        """(area, lon, lat, method): the walking node inside an area nearest to its inner point, else that point."""
        inner = spatial.interior_point(self.areas).select("area", F.col("x").alias("ilon"), F.col("y").alias("ilat"))
        if "walk" not in self.networks:
            return inner.select("area", F.col("ilon").alias("lon"), F.col("ilat").alias("lat"), F.lit("representative point of the area").alias("method"))
        n = self.networks["walk"][0].select(F.col("node").alias("id"), "lon", "lat")
        held = self.area_of(n).join(n, "id").join(inner, "area")
        away = F.pow(F.col("lon") - F.col("ilon"), 2) + F.pow(F.col("lat") - F.col("ilat"), 2)
        best = held.groupBy("area").agg(F.min(F.struct(away.alias("d"), "id", "lon", "lat")).alias("m"))
        rows = inner.join(best, "area", "left")
        method = F.when(F.col("m").isNull(), "representative point of the area").otherwise("walking node nearest to the representative point of the area")
        return rows.select("area", F.coalesce("m.lon", "ilon").alias("lon"), F.coalesce("m.lat", "ilat").alias("lat"), method.alias("method"))

    # Nodes

    def neighborhoods(self) -> DataFrame:
        metric = F.transform("ring", lambda p: F.struct(to_lv95(p["x"], p["y"])[0].alias("x"), to_lv95(p["x"], p["y"])[1].alias("y")))
        km2 = F.round(ring_area(metric) / 1e6, 4)
        outline = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("ring", lambda p: F.array(F.round(p["x"], 6), F.round(p["y"], 6)))).alias("coordinates")))
        rows = self.areas.select("area", F.col("ord").cast("long").alias("_ord"), "name", "wov_id", km2.alias("area_km2"), outline.alias("geometry"))
        latest = self.population.where(F.col("year") == self.population.agg(F.max("year")).scalar()).drop("name")
        o = self.origins().select("area", F.round("lat", 6).alias("representative_lat"), F.round("lon", 6).alias("representative_lon"), F.col("method").alias("origin_method"))
        rows = rows.join(latest, "wov_id", "left").join(o, "area", "left")
        return rows.select(
            F.col("area").alias("id"), "_ord", "name", "wov_id", "area_km2", F.col("total").alias("population_total"), *AGES[1:], share(F.col("children"), F.col("total")).alias("child_share"), share(F.col("elderly"), F.col("total")).alias("elderly_share"),
            share(F.col("total"), F.col("area_km2"), 1).alias("population_density_km2"), F.col("year").alias("reference_year"), "representative_lat", "representative_lon", "origin_method", "geometry",
        )

    def observations(self) -> DataFrame:
        rows = self.population.drop("name").join(self.areas.select("wov_id", "area", "ord"), "wov_id")
        return rows.select(F.concat_ws(":", F.lit("population"), "wov_id", "year").alias("id"), (F.col("ord") * 10_000 + F.col("year")).cast("long").alias("_ord"), F.col("area").alias("neighborhood_id"), "year", *AGES)

    def categories(self) -> DataFrame:
        return self.spark.createDataFrame([(c, i, label, c in ESSENTIAL) for i, (c, label) in enumerate(CATEGORY_LABELS.items())], "category string, _ord long, label string, essential boolean")

    def category_nodes(self) -> DataFrame:
        n = self.services.groupBy("category").agg(F.count("*").alias("count"))
        return self.categories().join(n, "category", "left").select(F.concat(F.lit("category:"), "category").alias("id"), "_ord", "category", "label", "essential", F.coalesce("count", F.lit(0)).alias("count"))

    def service_nodes(self) -> DataFrame:
        on = self.access().where("node is not null").groupBy("id").agg(F.bool_or(F.col("network") == "walk").alias("w"), F.bool_or(F.col("network") == "bike").alias("b"))
        rows = self.services.join(self.area_of(self.services), "id", "left").join(on, "id", "left").join(self.categories().select("category", "label"), "category", "left")
        lat, lon = F.round("lat", 6), F.round("lon", 6)
        shown = F.coalesce("name", F.concat(F.regexp_replace("label", "s$", ""), F.lit(" (unnamed)")))
        return rows.select("id", F.col("ord").cast("long").alias("_ord"), "name", shown.alias("display_name"), "category", lat.alias("lat"), lon.alias("lon"), F.col("area").alias("neighborhood_id"), "source", F.coalesce("w", F.lit(False)).alias("routable_walk"), F.coalesce("b", F.lit(False)).alias("routable_bike"), _point(lon, lat))

    def _stop_rows(self) -> DataFrame:
        """Stops inside an area or near the walking network."""
        t = self._timetable()["stops"].withColumnRenamed("stop", "id")
        rows = t.join(self.area_of(t), "id", "left").join(self.stop_access(), "id", "left")
        return rows.where("area is not null or node is not null")

    def _served(self) -> DataFrame:
        """Distinct (stop, route) of the stops in the graph."""
        t = self._timetable()
        pairs = t["stop_times"].join(t["trips"].select("trip", "route"), "trip").select("stop", "route").distinct()
        return pairs.join(self._stop_rows().select(F.col("id").alias("stop")), "stop", "left_semi")

    def stop_nodes(self) -> DataFrame:
        lines = self._served().join(self._timetable()["routes"].select("route", vehicle(F.col("route_type")).alias("v")), "route", "left")
        lines = lines.groupBy(F.col("stop").alias("id")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("v")).alias("vehicles"))
        rows = self._stop_rows().join(lines, "id", "left")
        lat, lon = F.round("lat", 6), F.round("lon", 6)
        return rows.select(
            F.concat(F.lit("stop:"), "id").alias("id"), F.xxhash64("id").alias("_ord"), F.col("id").alias("stop_id"), "name", lat.alias("lat"), lon.alias("lon"), F.col("area").alias("neighborhood_id"), F.coalesce("n", F.lit(0)).alias("route_count"),
            F.coalesce("vehicles", F.array().cast("array<string>")).alias("vehicles"), F.col("node").isNotNull().alias("walk_access"), _point(lon, lat),
        )

    def route_nodes(self) -> DataFrame:
        n = self._served().groupBy("route").agg(F.count("*").alias("stop_count"))
        v = vehicle(F.col("route_type"))
        label = F.concat_ws(" ", v, F.coalesce(F.nullif("short_name", F.lit("")), F.nullif("long_name", F.lit(""))))
        return self._timetable()["routes"].join(n, "route").select(F.concat(F.lit("route:"), "route").alias("id"), F.xxhash64("route").alias("_ord"), F.col("route").alias("route_id"), "short_name", label.alias("label"), v.alias("vehicle"), "agency", "stop_count")

    def attached(self) -> DataFrame:
        """(src, dst, network, node, distance_m) of services and stops on street nodes."""
        parts = [self.access().where("node is not null").select(F.col("id").alias("src"), "network", "node", "distance_m")]
        if self.timetable:
            parts.append(self._stop_rows().where("node is not null").select(F.concat(F.lit("stop:"), "id").alias("src"), F.lit("walk").alias("network"), "node", "distance_m"))
        rows = reduce(DataFrame.unionByName, parts)
        return rows.select("src", F.concat_ws(":", F.lit("access"), "network", "node").alias("dst"), "network", "node", F.round("distance_m", 1).alias("distance_m"))

    def access_nodes(self) -> DataFrame:
        n = self.attached().groupBy("dst", "network", "node").agg(F.count("*").alias("attached_count"))
        where = reduce(DataFrame.unionByName, (nodes.select(F.lit(m).alias("network"), "node", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")) for m, (nodes, _) in self.networks.items()))
        return n.join(where, ["network", "node"]).select(F.col("dst").alias("id"), F.xxhash64("dst").alias("_ord"), F.col("node").alias("node_id"), "network", "lat", "lon", "attached_count")

    def graph(self) -> PropertyGraph:
        pair = lambda df, a, b, *more: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), *more)
        back = lambda df: df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in df.columns if c not in ("src", "dst")))
        how = F.lit("point in polygon").alias("method")
        has_service = lambda: pair(self.service_nodes().where("neighborhood_id is not null"), "neighborhood_id", "id", how)
        no_edges = self.spark.createDataFrame([], "src string, dst string")
        no_stop = self.spark.createDataFrame([], ", ".join(["id string", "_ord long", *(f"{f.name} {f.type}" for f in CITY.node("TransitStop").fields)]))
        no_route = self.spark.createDataFrame([], ", ".join(["id string", "_ord long", *(f"{f.name} {f.type}" for f in CITY.node("TransitRoute").fields)]))
        riding = self.timetable is not None
        has_stop = lambda: pair((self.stop_nodes() if riding else no_stop).where("neighborhood_id is not null"), "neighborhood_id", "id", how)
        observed = lambda: pair(self.observations(), "neighborhood_id", "id")
        of = lambda: self.services.select(F.col("id").alias("src"), F.concat(F.lit("category:"), "category").alias("dst"))
        serves = lambda: self._served().select(F.concat(F.lit("route:"), "route").alias("src"), F.concat(F.lit("stop:"), "stop").alias("dst")) if riding else no_edges
        at = lambda: self.attached().select("src", "dst", "network", "distance_m")
        nodes = {"Neighborhood": self.neighborhoods, "PopulationObservation": self.observations, "ServiceCategory": self.category_nodes, "ServiceLocation": self.service_nodes, "StreetAccessPoint": self.access_nodes, "TransitStop": self.stop_nodes if riding else lambda: no_stop, "TransitRoute": self.route_nodes if riding else lambda: no_route}
        edges = {
            "LOCATED_IN": lambda: back(has_service()).unionByName(back(has_stop())),
            "HAS_SERVICE": has_service,
            "HAS_TRANSIT_STOP": has_stop,
            "HAS_POPULATION_OBSERVATION": observed,
            "OBSERVES": lambda: back(observed()),
            "ADJACENT_TO": lambda: spatial.touching(self.areas, CELL_DEG).select("src", "dst", F.round("shared", 6).alias("shared_boundary_degrees")),
            "OF_CATEGORY": of,
            "HAS_MEMBER": lambda: back(of()),
            "ACCESS_POINT": at,
            "ATTACHES": lambda: back(at()).drop("distance_m"),
            "SERVED_BY": lambda: back(serves()),
            "SERVES": serves,
        }
        return PropertyGraph(self.spark, CITY, nodes, edges, {"accessibility": self.accessibility})

    # Reach

    def seeds(self, origins: DataFrame, mode: str) -> DataFrame:
        """(origin, node, snap_m) of points (id, lon, lat); a point over 1,000 m off the network reaches nothing."""
        return spatial.snapped(self.placed(origins), self.nodes(mode), MOST_SNAP_M).where("node is not null").select(F.col("id").alias("origin"), "node", F.col("distance").alias("snap_m"))

    def service_day(self, wanted: date) -> date:
        """The day asked for, or the nearest one that the timetable serves."""
        t = self._timetable()
        window = transit.service_window(t["calendar"], t["exceptions"]).first()
        if window["first_day"] is None:
            raise DataUnavailableError("the timetable has no calendar")
        first, last = window["first_day"], window["last_day"]
        near = {wanted + timedelta(days=k) for k in range(-14, 15)}
        far = {first + timedelta(days=k) if wanted < first else last - timedelta(days=k) for k in range(400)}
        days = F.broadcast(self.spark.createDataFrame([(d, d.weekday() + 1) for d in sorted(near | far)], "day date, w int"))  # at most 429 rows
        runs = t["calendar"].join(days, F.col("day").between(F.col("start"), F.col("end")) & (F.element_at("days", F.col("w")) == 1)).select("service", "day")
        told = t["exceptions"].join(days, F.col("date") == F.col("day"))
        runs = runs.join(told.where("type = 2").select("service", "day"), ["service", "day"], "left_anti").unionByName(told.where("type = 1").select("service", "day"))
        found = transit.resolve_day(wanted, {r["day"] for r in runs.select("day").distinct().collect()}, (first, last))
        if found is None:
            raise DataUnavailableError("the timetable serves no usable day", window=[str(first), str(last)])
        return found

    def _walks(self, origins: DataFrame, minutes: float) -> tuple[DataFrame, DataFrame, DataFrame, float]:
        """Seeds and edges in seconds of walking, and when each stop in walking range is reached."""
        per_m = 3.6 / routing.SPEED_KMH["walk"]
        seeds = self.seeds(origins, "walk").select("origin", "node", (F.col("snap_m") * per_m).alias("cost"))
        edges = self.edges("walk").withColumn("length_m", F.col("length_m") * per_m)
        stops = self.stop_access().where("node is not null").select(F.col("id").alias("stop"), "node", "distance_m")
        at = F.col("cost") + F.col("distance_m") * per_m
        near = routing.shortest_paths(seeds, edges, minutes * 60.0).join(stops, "node").where(at <= minutes * 60.0)
        return seeds, edges, near.groupBy("origin", "stop").agg(F.min(at).alias("at")), per_m

    def stops_in_range(self, origins: DataFrame, minutes: float) -> DataFrame:
        return self._walks(origins, minutes)[2].groupBy("origin").agg(F.count("*").alias("stops"))

    def reached(self, origins: DataFrame, mode: str, minutes: float, departure=None, max_transfers: int = 1) -> DataFrame:
        """(origin, service, category, minutes) for points (id, lon, lat), unrounded. The way from a point to the network counts in transit only."""
        if mode not in self.modes:
            raise QuerySpecError(f"the travel mode {mode!r} is not available", known=self.modes)
        access = self.access().join(self.services.select("id", "category"), "id").where("node is not null")
        on = lambda m: access.where(F.col("network") == m).select(F.col("id").alias("service"), "category", "node", "distance_m")
        if mode != "transit":
            speed = routing.SPEED_KMH[mode]
            budget = routing.budget_m(minutes, speed)
            costs = routing.shortest_paths(self.seeds(origins, mode).select("origin", "node", F.lit(0.0).alias("cost")), self.edges(mode), budget)
            return routing.reachable_services(costs, on(mode), budget).select("origin", "service", "category", (F.col("distance_m") / (speed * 1000 / 60)).alias("minutes"))
        t, budget = self._timetable(), minutes * 60.0
        start, calls = self._departures(departure)
        seeds, edges, near, per_m = self._walks(origins, minutes)
        there = transit.earliest_arrivals(near.select("origin", "stop", (F.lit(start) + F.col("at")).cast("int").alias("ready")), calls, t["transfers"], int(start + budget), max_transfers)
        elapsed = F.col("arrival") - start + F.col("distance_m") * per_m
        off = there.join(self.stop_access().where("node is not null").select(F.col("id").alias("stop"), "node", "distance_m"), "stop").where(elapsed <= budget)
        again = routing.merged_seeds(seeds, off.select("origin", "node", elapsed.cast("double").alias("cost")))
        costs = routing.shortest_paths(again, edges, budget)
        walk = on("walk").withColumn("distance_m", F.col("distance_m") * per_m)
        return routing.reachable_services(costs, walk, budget).select("origin", "service", "category", (F.col("distance_m") / 60).alias("minutes"))

    def _departures(self, departure) -> tuple[int, DataFrame]:
        """When a journey begins, in seconds of the service day, and that day's calls."""
        moment, t = parse_departure(departure), self._timetable()
        day = self.service_day(moment.date())
        start = int((moment.replace(tzinfo=None) - datetime.combine(day, datetime.min.time())).total_seconds())
        if day != moment.date():  # another day's timetable, at the same time of the day
            start = moment.hour * 3600 + moment.minute * 60 + moment.second
        run = lambda d: transit.active_services(t["calendar"], t["exceptions"], d)
        return start, transit.day_view(t["stop_times"], t["trips"], run(day), run(day - timedelta(days=1)))

    def transit_routes(self, origins: DataFrame, services: DataFrame, minutes: float = 60, departure=None, max_transfers: int = 1) -> DataFrame:
        """(origin, service, minutes, vehicles, steps) of the quickest way from points to services (id), on foot or with vehicles.

        The way from a last stop is found backwards from the services, so that all pairs share two searches.
        """
        start, calls = self._departures(departure)
        budget = minutes * 60.0
        seeds, edges, near, per_m = self._walks(origins, minutes)
        at = self.access().where("network = 'walk' and node is not null").join(services.select("id"), "id", "left_semi")
        back = routing.shortest_paths(at.select(F.col("id").alias("origin"), "node", (F.col("distance_m") * per_m).alias("cost")), edges, budget).select(F.col("origin").alias("service"), "node", F.col("cost").alias("egress"))
        walked = seeds.join(back, "node").groupBy("origin", "service").agg(F.min(F.col("cost") + F.col("egress")).alias("seconds")).where(F.col("seconds") <= budget)
        rides = transit.journeys(near.select("origin", "stop", (F.lit(start) + F.col("at")).cast("int").alias("ready")), calls, self._timetable()["transfers"], int(start + budget), max_transfers).where("vehicles > 0")
        off = self.stop_access().where("node is not null").select(F.col("id").alias("stop"), "node", "distance_m")
        total = F.col("arrival") - start + F.col("distance_m") * per_m + F.col("egress")
        ridden = rides.join(off, "stop").join(back, "node").withColumn("seconds", total).where(F.col("seconds") <= budget)
        steps = transit.steps(F.lit(start), F.col("legs"), F.col("distance_m") * per_m + F.col("egress"))
        walk = F.array(F.struct(F.lit("walk").alias("kind"), F.lit(None).cast("string").alias("run"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.round("seconds").cast("int").alias("seconds")))
        both = walked.select("origin", "service", "seconds", F.lit(0).alias("vehicles"), walk.alias("steps")).unionByName(ridden.select("origin", "service", "seconds", "vehicles", steps.alias("steps")))
        best = both.groupBy("origin", "service").agg(F.min(F.struct("seconds", "vehicles", "steps")).alias("m"))
        return best.select("origin", "service", F.round(F.col("m.seconds") / 60, 1).alias("minutes"), F.col("m.vehicles").alias("vehicles"), F.col("m.steps").alias("steps"))

    def transit_features(self, origins: DataFrame, minutes: float = 15, departure=None, max_transfers: int = 1) -> DataFrame:
        """(origin, kind, value): GeoJSON features of the streets in walking reach, the rides taken and the stops reached by vehicle."""
        start, calls = self._departures(departure)
        budget = minutes * 60.0
        seeds, edges, near, _ = self._walks(origins, minutes)
        t = self._timetable()
        nodes = self.networks["walk"][0]
        end = lambda n: nodes.select(F.col("node").alias(n), F.array(F.round("lon", 6), F.round("lat", 6)).alias(f"{n}_at"))
        line = lambda a, b: F.struct(F.lit("LineString").alias("type"), F.array(a, b).alias("coordinates"))
        feature = lambda geometry, **more: F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*(v.alias(k) for k, v in more.items())).alias("properties")))
        streets = routing.reachable_edges(routing.shortest_paths(seeds, edges, budget), edges).join(end("u"), "u").join(end("v"), "v")
        streets = streets.select("origin", F.lit("reachable_edge").alias("kind"), feature(line(F.col("u_at"), F.col("v_at")), kind=F.lit("reachable_edge")).alias("value"))
        found = transit.journeys(near.select("origin", "stop", (F.lit(start) + F.col("at")).cast("int").alias("ready")), calls, t["transfers"], int(start + budget), max_transfers)
        place = lambda n: t["stops"].select(F.col("stop").alias(n), F.array(F.round("lon", 6), F.round("lat", 6)).alias(f"{n}_at"))
        rides = found.select("origin", F.explode("legs").alias("x")).where("x.kind = 'ride'").select("origin", "x.run", "x.src", "x.dst").distinct()
        lines = t["trips"].join(t["routes"], "route").select(F.col("trip").alias("run"), vehicle(F.col("route_type")).alias("vehicle"))
        rides = rides.withColumn("run", F.regexp_replace("run", "<$", "")).join(lines, "run").select("origin", "src", "dst", "vehicle").distinct().join(place("src"), "src").join(place("dst"), "dst")
        rides = rides.select("origin", F.lit("transit_segment").alias("kind"), feature(line(F.col("src_at"), F.col("dst_at")), kind=F.lit("transit_segment"), vehicle=F.col("vehicle")).alias("value"))
        point = F.struct(F.lit("Point").alias("type"), F.col("stop_at").alias("coordinates"))
        stops = found.where("vehicles > 0").join(place("stop"), "stop")
        stops = stops.select("origin", F.lit("transit_stop").alias("kind"), feature(point, kind=F.lit("transit_stop"), arrival=format_service_time(F.col("arrival")), minutes=F.round((F.col("arrival") - start) / 60, 1)).alias("value"))
        return streets.unionByName(rides).unionByName(stops)

    def profile(self, origins: DataFrame, mode: str, minutes: float = 15, departure=None, max_transfers: int = 1) -> DataFrame:
        """(origin, category, n, nearest_minutes, nearest_name) for each point and each of the categories, also those not reached."""
        found = self.reached(origins, mode, minutes, departure, max_transfers)
        best = found.groupBy("origin", "category").agg(F.count("*").alias("n"), F.min(F.struct("minutes", "service")).alias("m"))
        every = origins.select(F.col("id").alias("origin")).crossJoin(F.broadcast(self.categories().select("category", "label")))  # eight categories
        names = self.services.select(F.col("id").alias("service"), "name")
        rows = every.join(best, ["origin", "category"], "left").withColumn("service", F.col("m.service")).join(names, "service", "left")
        shown = F.when(F.col("m").isNotNull(), F.coalesce("name", F.concat(F.regexp_replace("label", "s$", ""), F.lit(" (unnamed)"))))
        return rows.select("origin", "category", F.coalesce("n", F.lit(0)).alias("n"), F.round("m.minutes", 1).alias("nearest_minutes"), shown.alias("nearest_name"), F.col("service").alias("nearest_id"))

    def accessibility(self, graph: PropertyGraph, origins: DataFrame, params: dict) -> DataFrame:
        """The analysis of the query language: for all areas asked for at once."""
        points = self.area_points().join(origins.select("id"), "id", "left_semi")
        rows = self.profile(points, params.get("mode", "walk"), float(params.get("minutes", 15)), params.get("departure_time"), int(params.get("max_transfers", 1)))
        wanted = params.get("category")
        one = lambda c, f: F.max(F.when(F.col("category") == c, F.col(f)))
        essential = F.col("category").isin(*ESSENTIAL)
        missing = F.array_intersect(F.array(*map(F.lit, ESSENTIAL)), F.collect_set(F.when(essential & (F.col("n") == 0), F.col("category"))))
        each = [(F.lit(None) if wanted else one(c, f)).cast(k).alias(f"per_category.{c}.{g}") for c in CATEGORY_LABELS for f, g, k in (("n", "count", "bigint"), ("nearest_minutes", "nearest_minutes", "double"), ("nearest_name", "nearest_name", "string"))]
        return rows.groupBy(F.col("origin").alias("id")).agg(
            (one(wanted, "n") if wanted else F.sum("n")).alias("count"),
            (one(wanted, "nearest_minutes") if wanted else F.max(F.lit(None).cast("double"))).alias("nearest_minutes"),
            (one(wanted, "nearest_name") if wanted else F.max(F.lit(None).cast("string"))).alias("nearest_name"),
            F.count_if(essential & (F.col("n") > 0)).alias("completeness.reachable_count"),
            F.max(F.lit(len(ESSENTIAL))).alias("completeness.total"),
            missing.alias("completeness.missing"),
            *(c if not wanted else F.max(c).alias(f"per_category.{k}") for c, k in zip(each, (f"{c}.{g}" for c in CATEGORY_LABELS for g in ("count", "nearest_minutes", "nearest_name")), strict=True)),
        )

    def area_points(self) -> DataFrame:
        return self.origins().select(F.col("area").alias("id"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))

    # Questions over all areas

    def profiles(self, modes: list[str], minutes: float = 15, departure=None) -> DataFrame:
        """(area, mode, category, n, nearest_m): here the nearest is told in minutes."""
        one = lambda m: self.profile(self.area_points(), m, minutes, departure).select(F.col("origin").alias("area"), F.lit(m).alias("mode"), "category", "n", F.col("nearest_minutes").alias("nearest_m"))
        return reduce(DataFrame.unionByName, (one(m) for m in modes))

    def ask(self, question: str, mode: str = "walk", minutes: float = 15, limit: int = 10, departure=None, **told) -> DataFrame:
        """One of the standing questions; ``told`` are its own thresholds and categories."""
        essential = list(ESSENTIAL)
        names = self.areas.select("area", "name")
        if question == "poorest_access":
            return questions.poorest_access(self.profiles([mode], minutes, departure), told.get("category", "pharmacy"), mode, limit).withColumnRenamed("nearest_m", "nearest_minutes").join(names, "area")
        if question == "good_schools_poor_healthcare":
            found = questions.median_gap(self.profiles([mode], minutes, departure), "school", "healthcare", mode, told.get("school_min"), told.get("healthcare_max"))
        elif question == "adjacent_contrasts":
            found = questions.adjacent_contrasts(self.profiles([mode], minutes, departure), spatial.touching(self.areas, CELL_DEG).select("src", "dst"), mode, essential)
        elif question == "category_inequality":
            return questions.category_inequality(self.profiles([mode], minutes, departure), mode, told.get("categories") or essential)
        elif question == "mode_gain":
            others = [m for m in told.get("compare_modes", ("bike", "transit")) if m in self.modes]
            found = questions.mode_gain(self.profiles([mode, *others], minutes, departure), mode, others, essential)
        elif question == "children_underserved":
            people = self.neighborhoods().select(F.col("id").alias("area"), F.col("children").alias("people"))
            if "transit" in self.modes:
                stops = self.stops_in_range(self.area_points(), minutes).withColumnRenamed("origin", "area")
            else:
                stops = self.graph().edges("HAS_TRANSIT_STOP").groupBy(F.col("src").alias("area")).agg(F.count("*").alias("stops"))
            found = questions.underserved(self.profiles([mode], minutes, departure), people, "pharmacy", mode, stops, told.get("min_children"))
        else:
            raise QuerySpecError(f"unknown question {question!r}", known=list(QUESTIONS))
        return found.limit(limit)

    def gaps(self, category: str, minutes: float = 15, limit: int = 25) -> dict[str, DataFrame]:
        """Of the walking network: coverage by area, of the whole, and the worst uncovered points, thinned to 400 m."""
        budget = routing.budget_m(minutes, routing.SPEED_KMH["walk"])
        access = self.access().where("network = 'walk' and node is not null").join(self.services.where(F.col("category") == category).select("id"), "id", "left_semi")
        near = routing.nearest_facility(access, self.edges("walk"))
        nodes = self.nodes("walk")
        inside = self.area_of(nodes.withColumnRenamed("node", "id")).withColumnRenamed("id", "node")
        rows = nodes.join(near, "node", "left")
        whole = rows.agg(F.count("*").alias("nodes"), F.count_if(F.col("cost") <= budget).alias("covered")).withColumn("ratio", share(F.col("covered"), F.col("nodes")))
        far = rows.where(F.col("cost").isNull() | (F.col("cost") > budget))
        return {"areas": routing.coverage(inside, near, budget), "network": whole, "worst": routing.thinned(far, 400.0, limit)}

    def reachable_accidents(self, origins: DataFrame, mode: str = "walk", minutes: float = 15) -> DataFrame:
        """(origin, n): accidents within the budget, each counted from its street node and the way to it."""
        budget = routing.budget_m(minutes, routing.SPEED_KMH[mode])
        costs = routing.shortest_paths(self.seeds(origins, mode).select("origin", "node", F.lit(0.0).alias("cost")), self.edges(mode), budget)
        at = spatial.snapped(self.placed(self.accidents), self.nodes(mode)).where("node is not null").select("node", F.col("distance").alias("distance_m"))
        return routing.reachable_points(costs, at, budget)

    def reachable_areas(self, origins: DataFrame, mode: str = "walk", minutes: float = 15) -> DataFrame:
        """(origin, area) of the areas that the streets in reach meet."""
        budget = routing.budget_m(minutes, routing.SPEED_KMH[mode])
        edges = self.edges(mode)
        costs = routing.shortest_paths(self.seeds(origins, mode).select("origin", "node", F.lit(0.0).alias("cost")), edges, budget)
        at = self.networks[mode][0].select("node", F.col("lon").alias("x"), F.col("lat").alias("y"))
        return routing.areas_touched(costs, edges, at, self.areas, CELL_DEG)

    def network_stats(self) -> DataFrame:
        one = lambda m: routing.network_stats(self.nodes(m), self.edges(m)).select(F.lit(m).alias("network"), "*")
        return reduce(DataFrame.unionByName, map(one, self.networks))

    def service_sources(self, category: str | None = None) -> DataFrame:
        """(source, dataset, url) that services come from; a URL only where a source and dataset has one."""
        rows = self.services if category is None else self.services.where(F.col("category") == category)
        for c in ("dataset", "url"):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
        return rows.groupBy("source", "dataset").agg(F.when(F.countDistinct("url") == 1, F.max("url")).alias("url")).orderBy("source", "dataset")

    def service_summary(self) -> DataFrame:
        """A row for each category: services, those on any network, on foot and by bicycle, those without a name, and their sources."""
        on = self.access().where("node is not null").groupBy("id").agg(F.bool_or(F.col("network") == "walk").alias("w"), F.bool_or(F.col("network") == "bike").alias("b"))
        rows = self.services.join(on, "id", "left")
        found = rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("w") | F.col("b")).alias("routable"), F.count_if("w").alias("walk"), F.count_if("b").alias("bike"), F.count_if(F.col("name").isNull()).alias("unnamed"), F.array_sort(F.collect_set("source")).alias("sources"))
        return self.categories().select("category", "label").join(found, "category", "left").fillna(0, ["n", "routable", "walk", "bike", "unnamed"])

    def areas_by_accidents(self) -> DataFrame:
        n = self.area_of(self.accidents, boundary=True).groupBy("area").agg(F.count("*").alias("accidents"))
        return self.areas.select("area", "name").join(n, "area", "left").withColumn("accidents", F.coalesce("accidents", F.lit(0))).orderBy(F.desc("accidents"), "area")

    def schools_by_nearby_accidents(self, radius_m: float = 250.0) -> DataFrame:
        near = spatial.within_haversine(self.schools, self.accidents, radius_m)
        found = near.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("accidents"), F.array_sort(F.collect_list(F.struct(F.round("distance", 1).alias("distance_m"), F.col("b").alias("accident")))).alias("nearby"))
        return self.schools.join(found, "id", "left").withColumn("accidents", F.coalesce("accidents", F.lit(0))).orderBy(F.desc("accidents"), "id")


@dataclass(frozen=True)
class PreparedCity(City):
    """A city whose networks, attachments and origins were computed once and are read from storage."""

    tables: dict[str, DataFrame] | None = None

    def nodes(self, mode: str) -> DataFrame:
        return self.tables[f"nodes_{mode}"]

    def edges(self, mode: str) -> DataFrame:
        return self.tables[f"edges_{mode}"]

    def access(self) -> DataFrame:
        return self.tables["access"]

    def stop_access(self) -> DataFrame:
        self._timetable()
        return self.tables["stop_access"]

    def origins(self) -> DataFrame:
        return self.tables["origins"]


QUESTIONS = ("poorest_access", "good_schools_poor_healthcare", "adjacent_contrasts", "category_inequality", "mode_gain", "children_underserved")


def _point(lon: Column, lat: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))).alias("geometry")
