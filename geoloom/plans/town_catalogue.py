"""Queries over a town that is made from the driver's tables by rules, each with SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import CATEGORY_LABELS
from ..operators import routing, spatial
from ..quality import service_report
from ..sources import town as T
from .catalogue import _years, flat, query
from .compile import compile_query


def _east(lon: str, lat: str) -> str:
    p, q = f"(({lat} * 3600 - 169028.66) / 10000)", f"(({lon} * 3600 - 26782.5) / 10000)"
    return f"(2600072.37 + 211455.93 * {q} - 10938.51 * {q} * {p} - 0.36 * {q} * {p} * {p} - 44.54 * {q} * {q} * {q})::DOUBLE"


def _north(lon: str, lat: str) -> str:
    p, q = f"(({lat} * 3600 - 169028.66) / 10000)", f"(({lon} * 3600 - 26782.5) / 10000)"
    return f"(1200147.07 + 308807.95 * {p} + 3745.25 * {q} * {q} + 76.63 * {p} * {p} - 194.56 * {q} * {q} * {p} + 119.79 * {p} * {p} * {p})::DOUBLE"


def _grid(mode: str) -> str:
    c, r, dx, dy = T.GRIDS[mode]
    return f"SELECT '{mode}' AS m, '{mode[0]}:' || k % {c} || ':' || k // {c} AS node, {T.CORNER[0]}::DOUBLE + (k % {c}) * {dx}::DOUBLE AS lon, {T.CORNER[1]}::DOUBLE + (k // {c}) * {dy}::DOUBLE AS lat FROM range({c * r}) t(k)"


def _half(mode: str) -> str:
    c, r, _, _ = T.GRIDS[mode]
    name = lambda n: f"'{mode[0]}:' || ({n}) % {c} || ':' || ({n}) // {c}"
    return f"SELECT '{mode}' AS m, {name('k')} AS u, {name('k + 1')} AS v FROM range({c * r}) t(k) WHERE k % {c} < {c - 1} UNION ALL SELECT '{mode}', {name('k')}, {name(f'k + {c}')} FROM range({c * (r - 1)}) t(k)"


_categories = ", ".join(f"({i}, '{c}', '{label}')" for i, (c, label) in enumerate(CATEGORY_LABELS.items()))
_in_area = lambda lon, lat: f"CASE WHEN {lon} > 7.5 AND {lon} < 7.6 AND {lat} > 47.5 AND {lat} < 47.57 THEN 'area:' || (floor(({lon} - 7.5::DOUBLE) / 0.02::DOUBLE) + 5 * floor(({lat} - 47.5::DOUBLE) / 0.014::DOUBLE))::INT END"
_base = f"""cat(i, category, label) AS (VALUES {_categories}),
s0 AS (SELECT s_suppkey AS k, 'service:' || s_suppkey AS id, CASE WHEN s_suppkey % 11 <> 0 THEN s_name END AS name, s_suppkey % 8 AS i, 7.49835::DOUBLE + (s_suppkey * 37 % 1009) * 0.0001::DOUBLE AS lon, 47.49873::DOUBLE + (s_suppkey * 53 % 701) * 0.0001::DOUBLE AS lat FROM supplier),
s AS (SELECT s0.*, category, label, {_east("lon", "lat")} AS x, {_north("lon", "lat")} AS y, {_in_area("lon", "lat")} AS area FROM s0 JOIN cat USING (i)),
g0 AS ({_grid("walk")} UNION ALL {_grid("bike")}), g AS (SELECT *, {_east("lon", "lat")} AS x, {_north("lon", "lat")} AS y, {_in_area("lon", "lat")} AS area FROM g0),
half AS ({_half("walk")} UNION ALL {_half("bike")}),
link AS (SELECT half.*, sqrt((a.x - b.x)^2 + (a.y - b.y)^2) AS w FROM half JOIN g a ON a.node = half.u JOIN g b ON b.node = half.v),
c0 AS (SELECT c_custkey AS k, 7.49925::DOUBLE + (c_custkey * 31 % 997) * 0.0001::DOUBLE AS lon, 47.49935::DOUBLE + (c_custkey * 71 % 691) * 0.0001::DOUBLE AS lat FROM customer),
c AS (SELECT *, {_east("lon", "lat")} AS x, {_north("lon", "lat")} AS y, {_in_area("lon", "lat")} AS area FROM c0),
acc AS (SELECT s.id, g.m, arg_min(node, (sqrt((s.x - g.x)^2 + (s.y - g.y)^2), node)) AS node, min(sqrt((s.x - g.x)^2 + (s.y - g.y)^2)) AS d FROM s, g GROUP BY 1, 2),
inner_ AS (SELECT n_nationkey AS k, 7.5::DOUBLE + (n_nationkey % 5 + 0.5::DOUBLE) * 0.02::DOUBLE AS lon, 47.5::DOUBLE + (n_nationkey // 5 + 0.5::DOUBLE) * 0.014::DOUBLE AS lat FROM nation),
org AS (SELECT 'area:' || k AS area, arg_min(node, (round((g.lon - inner_.lon)^2 + (g.lat - inner_.lat)^2, 12), node)) AS node FROM inner_ JOIN g ON g.area = 'area:' || k AND g.m = 'walk' GROUP BY 1)"""
_paths = "e AS (SELECT m, u, v, w FROM link UNION ALL SELECT m, v, u, w FROM link), sp(m, o, node, d) USING KEY (m, o, node) AS (SELECT m, o, node, d::DOUBLE FROM seeds UNION SELECT m, o, node, min(d) FROM (SELECT sp.m, sp.o, e.v AS node, sp.d + e.w AS d FROM sp JOIN e ON e.u = sp.node AND e.m = sp.m LEFT JOIN recurring.sp AS r ON r.m = sp.m AND r.o = sp.o AND r.node = e.v WHERE sp.d + e.w <= {cut} AND (r.d IS NULL OR sp.d + e.w < r.d)) GROUP BY m, o, node)"
_from_areas = f"WITH RECURSIVE {_base}, seeds AS (SELECT 'walk' AS m, area AS o, node, 0.0 AS d FROM org), {_paths.format(cut='1200.0')}"
_town = f"WITH {_base} "


@query(_town + f", y AS ({_years}) SELECT 'area:' || k AS id, n_name AS name, total AS population_total, urgent AS children, round(urgent::DOUBLE / total, 4) AS child_share, y AS reference_year FROM nation JOIN y ON k = n_nationkey WHERE y = (SELECT max(y) FROM y)")
def town_areas(spark, sf_dir):
    return T.town(spark, sf_dir).neighborhoods().where("reference_year is not null").select("id", "name", "population_total", "children", "child_share", "reference_year")


@query(f"SELECT 'population:' || k || ':' || y AS id, 'area:' || k AS neighborhood_id, y AS year, total, urgent AS children, low AS elderly, (low // 2)::BIGINT AS elderly_80_plus FROM ({_years})")
def town_observations(spark, sf_dir):
    return T.town(spark, sf_dir).observations().select("id", "neighborhood_id", "year", "total", "children", "elderly", "elderly_80_plus")


@query(_town + "SELECT id, coalesce(name, rtrim(label, 's') || ' (unnamed)') AS display_name, area AS neighborhood_id, coalesce((SELECT bool_or(d <= 500) FROM acc WHERE acc.id = s.id AND m = 'walk'), false) AS routable_walk, coalesce((SELECT bool_or(d <= 500) FROM acc WHERE acc.id = s.id AND m = 'bike'), false) AS routable_bike FROM s")
def town_services(spark, sf_dir):
    return T.town(spark, sf_dir).service_nodes().select("id", "display_name", "neighborhood_id", "routable_walk", "routable_bike")


@query(_town + "SELECT id, m AS network, CASE WHEN d <= 500 THEN node END AS node, CASE WHEN d <= 500 THEN round(d, 3) END AS distance_m, CASE WHEN d <= 150 THEN 'good' WHEN d <= 500 THEN 'poor' ELSE 'unreachable' END AS quality FROM acc")
def town_access(spark, sf_dir):
    return T.town(spark, sf_dir).access().withColumn("distance_m", F.round("distance_m", 3))


@query(_town + "SELECT 'access:' || m || ':' || node AS id, count(*) AS attached_count FROM acc WHERE d <= 500 GROUP BY m, node")
def town_access_points(spark, sf_dir):
    return T.town(spark, sf_dir).access_nodes().select("id", "attached_count")


@query(_town + ", r AS (SELECT id, bool_or(d <= 500 AND m = 'walk') AS w, bool_or(d <= 500 AND m = 'bike') AS b FROM acc GROUP BY 1) SELECT category, label, count(*) AS n, count(*) FILTER (w OR b) AS routable, count(*) FILTER (w) AS walk, count(*) FILTER (b) AS bike, count(*) FILTER (name IS NULL) AS unnamed, string_agg(DISTINCT 'source ' || k % 3, ',' ORDER BY 'source ' || k % 3) AS sources FROM s JOIN r USING (id) GROUP BY 1, 2")
def town_service_summary(spark, sf_dir):
    return flat(T.town(spark, sf_dir).service_summary())


@query("SELECT 'source ' || s_suppkey % 3 AS source, 'd' || s_suppkey % 2 AS dataset, CASE WHEN count(DISTINCT u) = 1 THEN max(u) END AS url FROM (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN 'u' ELSE 'u' || s_suppkey % 7 END AS u FROM supplier) GROUP BY 1, 2")
def town_service_sources(spark, sf_dir):
    return T.town(spark, sf_dir).service_sources()


@query(_town + "SELECT category, m AS network, count(*) AS services, count(*) FILTER (name IS NULL) AS unnamed, count(*) FILTER (d > 150 AND d <= 500) AS poor, count(*) FILTER (d > 500) AS failed, round(median(d) FILTER (d <= 500), 3) AS median_m, round(quantile_cont(d, 0.95) FILTER (d <= 500), 3) AS p95_m, round(max(d) FILTER (d <= 500), 3) AS max_m FROM acc JOIN s USING (id) GROUP BY 1, 2")
def town_quality(spark, sf_dir):
    c = T.town(spark, sf_dir)
    rows = c.access().join(c.services.select("id", "category", "name", "source"), "id")
    found = service_report(rows.withColumn("distance_m", F.coalesce("distance_m", F.lit(1e9))))
    return found.drop("sources").withColumns({x: F.round(x, 3) for x in ("median_m", "p95_m", "max_m")})


@query(_town + "SELECT 'area:' || n_nationkey AS area, n_name AS name, (SELECT count(*) FROM c WHERE c.area = 'area:' || n_nationkey AND k % 7 = 1) AS accidents FROM nation")
def town_area_accidents(spark, sf_dir):
    return T.town(spark, sf_dir).areas_by_accidents()


_hav = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(_town + f"SELECT 'school:' || a.k AS id, count(b.k) AS accidents, min(CASE WHEN b.k IS NOT NULL THEN round({_hav}, 1) END) AS nearest_m FROM c a LEFT JOIN c b ON b.k % 7 = 1 AND {_hav} <= 250 WHERE a.k % 50 = 0 GROUP BY a.k")
def town_school_accidents(spark, sf_dir):
    return T.town(spark, sf_dir).schools_by_nearby_accidents().select("id", "accidents", F.col("nearby")[0]["distance_m"].alias("nearest_m"))


@query("SELECT 'area:' || a.n_nationkey AS src, 'area:' || b.n_nationkey AS dst, CASE WHEN a.n_nationkey % 5 = b.n_nationkey % 5 THEN 0.02 WHEN a.n_nationkey // 5 = b.n_nationkey // 5 THEN 0.014 ELSE 0.0 END::DOUBLE AS shared FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey AND abs(a.n_nationkey % 5 - b.n_nationkey % 5) <= 1 AND abs(a.n_nationkey // 5 - b.n_nationkey // 5) <= 1")
def town_adjacency(spark, sf_dir):
    return T.town(spark, sf_dir).graph().edges("ADJACENT_TO").select("src", "dst", F.col("shared_boundary_degrees").alias("shared"))


@query("SELECT 'area:' || n_nationkey AS area, round(7.5 + (n_nationkey % 5 + 0.5) * 0.02, 6)::DOUBLE AS x, round(47.5 + (n_nationkey // 5 + 0.5) * 0.014, 6)::DOUBLE AS y FROM nation")
def town_inner_points(spark, sf_dir):
    return spatial.interior_point(T.areas(spark, sf_dir)).select("area", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(_town + "SELECT org.area, round(g.lon, 6) AS lon, round(g.lat, 6) AS lat, 'walking node nearest to the representative point of the area' AS method FROM org JOIN g USING (node)")
def town_origins(spark, sf_dir):
    return T.town(spark, sf_dir).origins().select("area", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "method")


@query(_town + "SELECT m AS network, (SELECT count(*) FROM g WHERE g.m = link.m) AS nodes, count(*) AS edges, round(sum(w), 2) AS total_m FROM link GROUP BY m")
def town_network_stats(spark, sf_dir):
    return T.town(spark, sf_dir).network_stats().withColumn("total_m", F.round("total_m", 2))


_reach = ", re AS (SELECT sp.o, s.id, s.category, s.name, s.label, sp.d + acc.d AS d FROM sp JOIN acc ON acc.node = sp.node AND acc.m = sp.m AND acc.d <= 500 JOIN s ON s.id = acc.id WHERE sp.d + acc.d <= 1200.0)"


@query(_from_areas + _reach + " SELECT 'area:' || n_nationkey AS origin, cat.category AS category, count(re.id) AS n, round(min(re.d) / 80, 1) AS nearest_minutes, arg_min(re.id, (re.d, re.id)) AS nearest_id FROM nation CROSS JOIN cat LEFT JOIN re ON re.o = 'area:' || n_nationkey AND re.category = cat.category GROUP BY n_nationkey, cat.category")
def town_profiles(spark, sf_dir):
    c = T.town(spark, sf_dir)
    return c.profile(c.area_points(), "walk", 15).select("origin", "category", "n", "nearest_minutes", "nearest_id")


@query(_from_areas + ", pos AS (SELECT c.k, min(sqrt((c.x - g.x)^2 + (c.y - g.y)^2)) AS d, arg_min(node, (sqrt((c.x - g.x)^2 + (c.y - g.y)^2), node)) AS node FROM c, g WHERE c.k % 7 = 1 AND g.m = 'walk' GROUP BY 1) SELECT sp.o AS origin, count(*) AS n FROM sp JOIN pos USING (node) WHERE pos.d <= 500 AND sp.d + pos.d <= 1200 GROUP BY 1")
def town_reachable_accidents(spark, sf_dir):
    c = T.town(spark, sf_dir)
    return c.reachable_accidents(c.area_points())


@query(_from_areas + ", seg AS (SELECT DISTINCT a.o, least(p.lon, q.lon) AS x0, greatest(p.lon, q.lon) AS x1, least(p.lat, q.lat) AS y0, greatest(p.lat, q.lat) AS y1 FROM link JOIN sp a ON a.node = link.u JOIN sp b ON b.node = link.v AND b.o = a.o JOIN g p ON p.node = link.u JOIN g q ON q.node = link.v WHERE link.m = 'walk') SELECT DISTINCT o AS origin, 'area:' || n_nationkey AS area FROM seg, nation WHERE x1 >= 7.5 + (n_nationkey % 5) * 0.02 AND x0 <= 7.5 + (n_nationkey % 5 + 1) * 0.02 AND y1 >= 47.5 + (n_nationkey // 5) * 0.014 AND y0 <= 47.5 + (n_nationkey // 5 + 1) * 0.014")
def town_reachable_areas(spark, sf_dir):
    c = T.town(spark, sf_dir)
    return c.reachable_areas(c.area_points())


@query(_from_areas + _reach + f", b AS (SELECT re.o, re.category, arg_min(re.id, (re.d, re.id)) AS id, min(re.d) AS d FROM re GROUP BY 1, 2) SELECT b.o AS origin, b.category, b.id AS service, coalesce(round(b.d / nullif({_hav.replace('b.lat', 's.lat').replace('b.lon', 's.lon').replace('a.lat', 'g.lat').replace('a.lon', 'g.lon')}, 0), 2), 1.0) AS detour FROM b JOIN s ON s.id = b.id JOIN org ON org.area = b.o JOIN g ON g.node = org.node")
def town_detours(spark, sf_dir):
    from ..functions.exprs import haversine_m

    c = T.town(spark, sf_dir)
    o = c.origins().select(F.col("area").alias("origin"), F.col("lon").alias("olon"), F.col("lat").alias("olat"))
    best = c.profile(c.area_points(), "walk", 15).where("n > 0").select("origin", "category", F.col("nearest_id").alias("service"))
    found = c.reached(c.area_points(), "walk", 15).drop("category").join(best, ["origin", "service"]).withColumn("distance_m", F.col("minutes") * 80)
    straight = best.join(o, "origin").join(c.services.select(F.col("id").alias("service"), "lon", "lat"), "service").select("origin", "service", haversine_m(F.col("olon"), F.col("olat"), F.col("lon"), F.col("lat")).alias("straight_m"))
    return routing.detours(found, straight).select("origin", "category", "service", "detour")


_gaps = f"WITH RECURSIVE {_base}, seeds AS (SELECT 'walk' AS m, 'x' AS o, acc.node, min(acc.d) AS d FROM acc JOIN s USING (id) WHERE s.category = 'pharmacy' AND acc.m = 'walk' AND acc.d <= 500 GROUP BY acc.node), {_paths.format(cut='1e9')}"


@query(_gaps + " SELECT g.area, count(*) AS nodes, count(*) FILTER (sp.d <= 800) AS covered, round(count(*) FILTER (sp.d <= 800)::DOUBLE / count(*), 4) AS ratio, round(median(sp.d), 3) AS median_m, round(max(sp.d), 3) AS max_m FROM g JOIN sp USING (node) WHERE g.area IS NOT NULL GROUP BY 1 UNION ALL SELECT 'all', count(*), count(*) FILTER (sp.d <= 800), round(count(*) FILTER (sp.d <= 800)::DOUBLE / count(*), 4), NULL, NULL FROM g JOIN sp USING (node)")
def town_gaps(spark, sf_dir):
    found = T.town(spark, sf_dir).gaps("pharmacy", 10)
    areas = found["areas"].select("area", "nodes", "covered", "ratio", F.round("median_m", 3).alias("median_m"), F.round("max_m", 3).alias("max_m"))
    return areas.unionByName(found["network"].select(F.lit("all").alias("area"), "nodes", "covered", "ratio", F.lit(None).cast("double").alias("median_m"), F.lit(None).cast("double").alias("max_m")))


# The feed

_stops = """st AS (SELECT s_suppkey AS k, 'p' || s_suppkey AS stop_id, CASE WHEN s_suppkey % 13 <> 0 THEN 'Halt ' || s_suppkey % 40 END AS name, round(47.49873::DOUBLE + (s_suppkey * 53 % 701) * 0.0001::DOUBLE, 6) AS lat, round(7.49835::DOUBLE + (s_suppkey * 37 % 1009) * 0.0001::DOUBLE, 6) AS lon, CASE WHEN s_suppkey % 4 <> 0 THEN 'st' || s_suppkey % 40 ELSE 'p' || s_suppkey END AS station FROM supplier),
box AS (SELECT * FROM st WHERE k % 17 <> 0 AND lat BETWEEN 47.50 AND 47.56 AND lon BETWEEN 7.50 AND 7.59),
stn AS (SELECT station AS stop, coalesce(arg_min(name, (stop_id <> station, stop_id)) FILTER (name IS NOT NULL), station) AS name, avg(lat) AS lat, avg(lon) AS lon, list_sort(list(stop_id))[1:8] AS ids FROM box GROUP BY 1)"""
_calls = f"""{_stops}, l AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey),
ev AS (SELECT l.*, station, 21600 + l_linenumber * 600 + l_partkey % 5 * 60 AS arr FROM l JOIN box ON box.k = l_suppkey),
ok AS (SELECT l_orderkey AS o, l_linenumber AS seq, station, arr, CASE WHEN l_partkey % 3 = 0 THEN arr ELSE arr + 30 END AS dep, lag(station) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before FROM ev WHERE l_partkey % 29 <> 0),
fold AS (SELECT *, count(*) OVER (PARTITION BY o) AS n FROM ok WHERE before IS NULL OR before <> station),
trip AS (SELECT o_orderkey AS o, 'r' || o_orderkey % 7 AS route, 's' || o_orderkey % 4 AS service FROM orders WHERE o_orderkey % 7 < 5 AND o_orderkey IN (SELECT o FROM fold WHERE n >= 2)),
kept AS (SELECT fold.*, route, service FROM fold JOIN trip USING (o) WHERE n >= 2)"""


@query(f"WITH {_stops} SELECT stop, name, round(lat, 6) AS lat, round(lon, 6) AS lon, array_to_string(ids, ',') AS source_ids FROM stn")
def feed_stops(spark, sf_dir):
    return flat(T.feed(spark, sf_dir)["stops"].withColumns({c: F.round(c, 6) for c in ("lat", "lon")}))


@query(f"WITH {_calls} SELECT 't' || o AS trip, count(*) AS calls, string_agg(station, ',' ORDER BY seq) AS stops, min(dep)::INT AS first_dep, max(arr)::INT AS last_arr FROM kept GROUP BY o")
def feed_calls(spark, sf_dir):
    calls = T.feed(spark, sf_dir)["stop_times"]
    return flat(calls.groupBy("trip").agg(F.count("*").alias("calls"), F.array_sort(F.collect_list(F.struct("pos", "stop")))["stop"].alias("stops"), F.min("dep").alias("first_dep"), F.max("arr").alias("last_arr")))


@query(f"WITH {_calls}, r(route, type) AS (VALUES ('r0', 900), ('r1', 700), ('r2', 3), ('r3', 100), ('r4', 109)) SELECT r.route, 'L' || r_regionkey AS short_name, r_name AS long_name, r.type AS route_type, CASE WHEN r_regionkey % 3 < 2 THEN 'Agency ' || r_regionkey % 3 END AS agency, (SELECT count(*) FROM trip WHERE trip.route = r.route) AS trips FROM r JOIN region ON r.route = 'r' || r_regionkey WHERE r.route IN (SELECT route FROM trip)")
def feed_routes(spark, sf_dir):
    f = T.feed(spark, sf_dir)
    return f["routes"].join(f["trips"].groupBy("route").agg(F.count("*").alias("trips")), "route").select("route", "short_name", "long_name", "route_type", "agency", "trips")


@query(f"WITH {_calls}, w(service, days, stop) AS (VALUES ('s0', '1,1,1,1,1,0,0', DATE '2026-12-31'), ('s1', '0,0,0,0,0,1,1', DATE '2026-12-31'), ('s2', '1,1,1,1,1,1,1', DATE '2026-12-31'), ('s3', '1,0,1,0,1,0,0', DATE '2100-12-31')) SELECT service, days, DATE '2026-01-01' AS start, stop AS \"end\" FROM w WHERE service IN (SELECT service FROM trip)")
def feed_calendar(spark, sf_dir):
    return flat(T.feed(spark, sf_dir)["calendar"])


@query(f"WITH {_calls} SELECT 's' || n_nationkey % 5 AS service, make_date(2026, 7, n_nationkey + 1) AS date, n_nationkey % 2 + 1 AS type FROM nation WHERE n_nationkey % 9 <> 0 AND 's' || n_nationkey % 5 IN (SELECT service FROM trip)")
def feed_exceptions(spark, sf_dir):
    return T.feed(spark, sf_dir)["exceptions"]


@query(f"WITH {_stops}, p AS (SELECT stop, {_east('lon', 'lat')} AS x, {_north('lon', 'lat')} AS y FROM stn), t AS (SELECT a.station AS src, b.station AS dst, CASE WHEN a.k % 4 <> 0 THEN a.k * 17 % 400 ELSE 90 END AS s FROM box a JOIN box b ON b.stop_id = 'p' || a.k * 3 % 100 UNION ALL SELECT a.stop, b.stop, greatest(trunc(sqrt((a.x - b.x)^2 + (a.y - b.y)^2) / (4.8::DOUBLE / 3.6::DOUBLE)), 90) FROM p a, p b WHERE a.stop <> b.stop AND sqrt((a.x - b.x)^2 + (a.y - b.y)^2) <= 300 AND sqrt((a.x - b.x)^2 + (a.y - b.y)^2) > 0) SELECT src, dst, min(s)::INT AS seconds FROM t WHERE src <> dst GROUP BY 1, 2")
def feed_transfers(spark, sf_dir):
    return T.feed(spark, sf_dir)["transfers"]


@query(f"WITH {_calls} SELECT 'stops' AS file, (SELECT count(*) FROM supplier WHERE s_suppkey % 17 = 0) AS rows UNION ALL SELECT 'stop_times', (SELECT count(*) FROM ev WHERE l_partkey % 29 = 0) UNION ALL SELECT 'calendar_dates', (SELECT count(*) FROM nation WHERE n_nationkey % 9 = 0 AND 's' || n_nationkey % 5 IN (SELECT service FROM trip))")
def feed_rejected(spark, sf_dir):
    return T.feed(spark, sf_dir)["rejected"]


_near = f"wg AS (SELECT node, {_east('lon', 'lat')} AS gx, {_north('lon', 'lat')} AS gy FROM ({_grid('walk')})), pos AS (SELECT stop, name, lat, lon, ids, {_in_area('lon', 'lat')} AS area, {_east('lon', 'lat')} AS x, {_north('lon', 'lat')} AS y FROM stn), near AS (SELECT stop, min(sqrt((x - gx)^2 + (y - gy)^2)) <= 500 AS ok FROM pos, wg GROUP BY 1), inc AS (SELECT pos.*, ok FROM pos JOIN near USING (stop) WHERE area IS NOT NULL OR ok)"
_labels = "v(route, vehicle, label) AS (VALUES ('r0', 'Tram', 'Tram L0'), ('r1', 'Bus', 'Bus L1'), ('r2', 'Bus', 'Bus L2'), ('r3', 'Train', 'Train L3'), ('r4', 'S-Bahn', 'S-Bahn L4'))"


@query(f"WITH {_calls}, {_near}, {_labels}, served AS (SELECT DISTINCT station AS stop, route FROM kept) SELECT 'stop:' || inc.stop AS id, any_value(inc.name) AS name, any_value(area) AS neighborhood_id, count(route) AS route_count, coalesce(string_agg(DISTINCT vehicle, ',' ORDER BY vehicle), '') AS vehicles, any_value(ok) AS walk_access FROM inc LEFT JOIN served USING (stop) LEFT JOIN v USING (route) GROUP BY inc.stop")
def town_stops(spark, sf_dir):
    return flat(T.town(spark, sf_dir, T.feed(spark, sf_dir)).stop_nodes().select("id", "name", "neighborhood_id", "route_count", "vehicles", "walk_access"))


@query(f"WITH {_calls}, {_near}, {_labels} SELECT 'route:' || route AS id, label, vehicle, count(DISTINCT station) AS stop_count FROM kept JOIN v USING (route) WHERE station IN (SELECT stop FROM inc) GROUP BY 1, 2, 3")
def town_routes(spark, sf_dir):
    return T.town(spark, sf_dir, T.feed(spark, sf_dir)).route_nodes().select("id", "label", "vehicle", "stop_count")


@query(f"WITH {_calls}, {_near}, {_labels} SELECT vehicle, count(*) AS routes, sum(n)::BIGINT AS stops FROM (SELECT route, vehicle, count(DISTINCT station) AS n FROM kept JOIN v USING (route) WHERE station IN (SELECT stop FROM inc) GROUP BY 1, 2) GROUP BY 1")
def town_routes_by_vehicle(spark, sf_dir):
    return T.town(spark, sf_dir, T.feed(spark, sf_dir)).route_nodes().groupBy("vehicle").agg(F.count("*").alias("routes"), F.sum("stop_count").alias("stops"))


# Query documents over the town


def _document(name: str, raw: dict, sql: str) -> None:
    query(sql, f"town_{name}")(lambda spark, sf_dir: flat(compile_query(T.town(spark, sf_dir).graph(), raw)))


_document(
    "culture_in_reach",
    {"start": {"type": "Neighborhood", "filters": [{"field": "wov_id", "op": "ne", "value": "0"}]}, "analyses": [{"as": "near", "analysis": "accessibility", "mode": "walk", "minutes": 15, "category": "culture", "operator": "count_gte", "value": 1}], "return": ["wov_id", "near.count", "near.nearest_minutes"], "limit": 100},
    _from_areas + _reach + " SELECT n_nationkey::VARCHAR AS wov_id, count(*) AS near_count, round(min(re.d) / 80, 1) AS near_nearest_minutes FROM nation JOIN re ON re.o = 'area:' || n_nationkey AND re.category = 'culture' WHERE n_nationkey <> 0 GROUP BY 1",
)
_document(
    "sport_beside",
    {"start": {"type": "Neighborhood"}, "traverse": [{"relation": "ADJACENT_TO", "as": "beside", "min_count": 4}, {"relation": "HAS_SERVICE", "as": "halls", "from": "beside", "filters": [{"field": "category", "op": "eq", "value": "sport"}]}], "rank": {"by": "halls.count", "order": "desc"}, "return": ["wov_id", "beside.count", "halls.count"], "limit": 100},
    _town + ", adj AS (SELECT a.n_nationkey AS a, 'area:' || b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey AND abs(a.n_nationkey % 5 - b.n_nationkey % 5) <= 1 AND abs(a.n_nationkey // 5 - b.n_nationkey // 5) <= 1) SELECT a::VARCHAR AS wov_id, count(DISTINCT b) AS beside_count, count(DISTINCT s.id) AS halls_count FROM adj LEFT JOIN s ON s.area = b AND category = 'sport' GROUP BY a HAVING count(DISTINCT b) >= 4",
)
_document(
    "places_by_access",
    {"start": {"type": "StreetAccessPoint", "filters": [{"field": "attached_count", "op": "gte", "value": 1}]}, "traverse": [{"relation": "ATTACHES", "as": "there"}], "group_by": ["network"], "aggregate": [{"function": "count", "field": "there.id", "as": "attached"}, {"function": "max", "field": "attached_count", "as": "most"}]},
    _town + "SELECT m AS network, sum(n)::BIGINT AS attached, max(n) AS most FROM (SELECT m, node, count(*) AS n FROM acc WHERE d <= 500 GROUP BY 1, 2) GROUP BY 1",
)
