"""The small city: reach against a plain search, the query vocabulary, feeds, the engine's surface."""

import heapq
import json
import math
import urllib.request
import zipfile
from datetime import date
from threading import Thread

import pytest
from pyspark.sql import functions as F

from geoloom.api import Engine, serve
from geoloom.catalog import CITY
from geoloom.city import parse_departure
from geoloom.errors import QuerySpecError
from geoloom.operators import spatial
from geoloom.plans.compile import execute
from geoloom.plans.spec import parse
from geoloom.sources import feeds, fixtures


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(fixtures.city(spark))


def metres(lon, lat):
    """The published approximation, term by term."""
    p, q = (lat * 3600 - 169028.66) / 10000, (lon * 3600 - 26782.5) / 10000
    return (2600072.37 + 211455.93 * q - 10938.51 * q * p - 0.36 * q * p**2 - 44.54 * q**3, 1200147.07 + 308807.95 * p + 3745.25 * q**2 + 76.63 * p**2 - 194.56 * q**2 * p + 119.79 * p**3)


def grid(mode):
    at = {(i, j): metres(7.574 + 0.006 * i, 47.55 + 0.004 * j) for i in range(7) for j in range(5)}
    near = {n: [] for n in at}
    for i, j in at:
        for o in ((i + 1, j), (i, j + 1)):
            if o in at and not (mode == "walk" and (i, o[0]) == (2, 3) and j not in (1, 4)):
                d = math.dist(at[i, j], at[o])
                near[i, j].append((o, d))
                near[o].append(((i, j), d))
    return at, near


def search(near, seeds, budget):
    best, queue = {}, [(c, n) for n, c in seeds.items()]
    heapq.heapify(queue)
    while queue:
        c, n = heapq.heappop(queue)
        if n not in best and c <= budget:
            best[n] = c
            for o, d in near[n]:
                heapq.heappush(queue, (c + d, o))
    return best


def snap(at, lon, lat):
    here = metres(lon, lat)
    return min((math.dist(here, x), n) for n, x in at.items())


ORIGINS = {"area:a": (1, 2), "area:b": (4, 2)}


def services_within(at, costs, budget):
    out = {}
    for c, _, lon, lat in fixtures.SERVICES:
        d, n = snap(at, lon, lat)
        if d <= 500 and n in costs and costs[n] + d <= budget:
            out.setdefault(c, []).append(costs[n] + d)
    return out


@pytest.mark.parametrize(("mode", "speed"), [("walk", 4.8), ("bike", 15.0)])
def test_reach_on_streets(engine, mode, speed):
    at, near = grid(mode)
    got = {(r["origin"], r["category"]): (r["n"], r["nearest_minutes"]) for r in engine.city.profile(engine.city.area_points(), mode, 15).collect()}
    for area, node in ORIGINS.items():
        budget = speed * 250
        want = services_within(at, search(near, {node: 0.0}, budget), budget)
        for c in CITY.analyses["accessibility"]["categories"]:
            n, nearest = got[area, c]
            assert n == len(want.get(c, []))
            assert nearest is None if c not in want else abs(nearest - min(want[c]) / (speed * 1000 / 60)) <= 0.051


def test_reach_by_transit(engine):
    """Against a plain search over rides: at most two vehicles, 90 s to change, walks between C and D."""
    at, near = grid("walk")
    per_m, budget, start = 3.6 / 4.8, 1800.0, 36000
    timed = {n: [(o, d * per_m) for o, d in x] for n, x in near.items()}
    stops = {"A": (0, 0), "B": (3, 0), "C": (5, 2), "D": (5, 3)}
    _, calls = fixtures.trips_and_calls()
    trips = {}
    for trip, _, stop, arr, dep in calls:
        if trip[:2] in ("T1", "T2"):
            trips.setdefault(trip, []).append((stop, arr, dep))
    got = {(r["origin"], r["category"]): (r["n"], r["nearest_minutes"]) for r in engine.city.profile(engine.city.area_points(), "transit", 30, "2026-08-20T10:00").collect()}
    for area, node in ORIGINS.items():
        walked = search(timed, {node: 0.0}, budget)
        ready = {s: start + int(walked[n]) for s, n in stops.items() if n in walked}
        foot = lambda d: d | {b: min(d.get(b, 10**9), d[a] + 330) for a, b in (("C", "D"), ("D", "C")) if a in d}
        ready = foot(ready)
        best = dict(ready)
        for _ in range(2):
            rides = {}
            for t in trips.values():
                on = next((k for k, (s, _, dep) in enumerate(t) if s in ready and dep >= ready[s]), None)
                for s, arr, _ in t[on + 1 :] if on is not None else ():
                    rides[s] = min(rides.get(s, 10**9), arr)
            after = foot(rides)
            for s, x in after.items():
                best[s] = min(best.get(s, 10**9), x)
            ready = {s: (rides[s] + 90 if x == rides.get(s) else x) for s, x in after.items()}
        seeds = {node: 0.0}
        for s, x in best.items():
            if x - start <= budget:
                seeds[stops[s]] = min(seeds.get(stops[s], 10**9), x - start)
        costs = search(timed, seeds, budget)
        want = {}
        for c, _, lon, lat in fixtures.SERVICES:
            d, n = snap(at, lon, lat)
            if n in costs and costs[n] + d * per_m <= budget:
                want.setdefault(c, []).append(costs[n] + d * per_m)
        for c in CITY.analyses["accessibility"]["categories"]:
            n, nearest = got[area, c]
            assert n == len(want.get(c, [])), (area, c)
            assert nearest is None if c not in want else abs(nearest - min(want[c]) / 60) <= 0.1


def test_departures_and_days(engine):
    assert parse_departure("2026-08-20T08:00Z").hour == 10
    assert parse_departure("7:05").minute == 5
    with pytest.raises(QuerySpecError):
        parse_departure("soon")
    assert engine.city.service_day(date(2026, 8, 20)) == date(2026, 8, 20)
    assert engine.city.service_day(date(2025, 5, 1)) == date(2026, 1, 1)
    assert engine.city.service_day(date(2027, 5, 1)) == date(2026, 12, 31)


@pytest.mark.parametrize(
    "raw",
    [
        {"start": {"type": "ServiceLocation"}, "group_by": ["category"], "aggregate": [{"function": "sum", "field": "name", "as": "bad"}]},
        {"start": {"type": "PopulationObservation"}, "group_by": ["year"], "aggregate": [{"function": "count", "as": "n"}], "return": ["year", "total"]},
        {"start": {"type": "PopulationObservation"}, "aggregate": [{"function": "count", "as": "n"}]},
        {"start": {"type": "Neighborhood"}, "aggregate": {"n": {"op": "count", "of": "name"}}},
        {"start": {"type": "Neighborhood"}, "return": ["geometry"]},
        {"start": {"type": "Neighborhood", "filters": [{"field": "geometry", "op": "exists"}]}},
        {"start": {"type": "ServiceLocation"}, "analyses": [{"analysis": "accessibility"}]},
        {"start": {"type": "Neighborhood"}, "analyses": [{"analysis": "accessibility", "category": "pubs"}]},
        {"start": {"type": "PopulationObservation"}, "group_by": ["year"], "aggregate": [{"function": "count", "as": "n"}], "order_by": [{"field": "n", "direction": "up"}]},
        {"start": {"type": "TransitStop"}, "traverse": [{"relation": "SERVED_BY", "as": "r"}, {"relation": "SERVES", "as": "s", "from": "r"}], "group_by": ["s.vehicles"], "aggregate": [{"function": "count", "as": "n"}]},
    ],
)
def test_refused(raw):
    with pytest.raises(QuerySpecError):
        parse(raw, CITY)


def test_a_step_to_several_types(engine):
    got = execute(engine.graph, {"start": {"type": "StreetAccessPoint", "filters": [{"field": "network", "value": "walk"}]}, "traverse": [{"relation": "ATTACHES", "as": "all"}], "group_by": ["all.type"], "aggregate": [{"function": "count", "as": "n"}], "order_by": [{"field": "all.type"}]})
    assert got["rows"] == [{"all.type": "ServiceLocation", "n": 12}, {"all.type": "TransitStop", "n": 4}]


def test_corners_touch(spark):
    square = lambda x, y: [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + 2, y), (x + 2, y + 2), (x, y + 2), (x, y))]
    areas = spark.createDataFrame([("a", 0, square(0, 0)), ("b", 1, square(2, 1)), ("c", 2, square(4, 3)), ("d", 3, square(9, 9))], "area string, ord int, ring array<struct<x:double,y:double>>")
    assert {tuple(r) for r in spatial.touching(areas, 1.5).where("src < dst").collect()} == {("a", "b", 1.0), ("b", "c", 0.0)}


def test_feed(spark, tmp_path):
    files = {
        "stops.txt": "stop_id,stop_name,stop_lat,stop_lon,parent_station\nP,Main,47.55,7.58,\nP1,Main 1,47.55,7.58,P\nP2,Main 2,47.552,7.58,P\nQ,Quay,47.553,7.58,\nZ,Far,10,10,\nX,Bad,no,7.5,\n",
        "routes.txt": "route_id,route_short_name,route_long_name,route_type,agency_id\nr,8,Long,900,g\ns,9,,odd,\n",
        "agency.txt": "agency_id,agency_name\ng,Trams\n",
        "trips.txt": "trip_id,route_id,service_id,trip_headsign\nt,r,wk,Quay\nu,r,wk,Far\nv,none,wk,\n",
        "stop_times.txt": "\ufefftrip_id,arrival_time,departure_time,stop_id,stop_sequence\nt,10:09:00,,Q,10\nt,10:00:00,10:01:00,P1,1\nt,10:02:00,10:02:00,P2,2\nt,9:00:00,9:00:00,Q,3\nt,bad,10:05:00,Q,4\nu,10:00:00,10:00:00,P1,1\nu,11:00:00,11:00:00,Z,2\nv,10:00:00,10:00:00,P1,1\nv,10:05:00,10:05:00,Q,2\n",
        "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nwk,1,1,1,1,1,0,0,20260101,\n",
        "calendar_dates.txt": "service_id,date,exception_type\nwk,20260701,2\nwk,nope,1\nother,20260701,1\n",
        "transfers.txt": "from_stop_id,to_stop_id,min_transfer_time\nP1,P2,60\nP1,Q,400\nQ,P2,\n",
    }
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    t = feeds.extract(spark, str(tmp_path / "feed.zip"), (47.5, 7.5, 47.6, 7.7))
    assert [(r["stop"], r["name"], round(r["lat"], 4), r["source_ids"]) for r in t["stops"].orderBy("stop").collect()] == [("P", "Main", 47.5507, ["P", "P1", "P2"]), ("Q", "Quay", 47.553, ["Q"])]
    assert [tuple(r) for r in t["stop_times"].orderBy("pos").collect()] == [("t", 0, "P", 36000, 36060), ("t", 1, "Q", 36540, 36540)]
    assert [tuple(r) for r in t["trips"].collect()] == [("t", "r", "wk", "Quay")] and [tuple(r) for r in t["routes"].collect()] == [("r", "8", "Long", 900, "Trams")]
    assert [tuple(r) for r in t["calendar"].collect()] == [("wk", [1, 1, 1, 1, 1, 0, 0], date(2026, 1, 1), date(2100, 12, 31))]
    assert [tuple(r) for r in t["exceptions"].collect()] == [("wk", date(2026, 7, 1), 2)]
    assert {(r["src"], r["dst"]): r["seconds"] for r in t["transfers"].collect()} == {("P", "Q"): 194, ("Q", "P"): 90}
    assert {r["file"]: r["rows"] for r in t["rejected"].collect()} == {"stops": 1, "stop_times": 1, "calendar_dates": 1}


def test_surface(engine):
    page = engine.entities("ServiceLocation", limit=3)
    assert len(page["results"]) == 3 and page["total"] == 12 and all("geometry" not in r for r in page["results"])
    assert engine.subgraph("Neighborhood", "area:a", 3, limit=5)["truncated"]
    server = serve(engine, port=0)
    Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        got = json.load(urllib.request.urlopen(f"{at}/spatial-graph/entities/Neighborhood/area%3Aa"))
        assert got["children"] == 2100 and "geometry" not in got
        asked = urllib.request.Request(f"{at}/spatial-graph/query", json.dumps({"start": {"type": "Neighborhood", "filters": [{"field": "population_total", "op": "between", "value": [4000, 5000]}]}, "return": ["Neighborhood.name"]}).encode())
        assert json.load(urllib.request.urlopen(asked))["results"] == [{"Neighborhood.name": "Fixture East"}]
    finally:
        server.shutdown()
    assert engine.handle("GET", "/entities/Dragon")[0] == 404 and engine.handle("GET", "/accessibility", {"lat": "x", "lon": "1"})[0] == 400
    assert engine.handle("GET", "/accessibility/walk/route", {"lat": "47.558", "lon": "7.58", "service": "service:pharmacy:fixture:3"})[1]["nodes"] == ["fixture:1:2"]
    assert engine.tools()["compare_areas"](["area:a"] * 26, "pharmacy")["error"] == "QuerySpecError"
    assert engine.tools()["find_reachable"]("area:a", "pharmacy")["count"] == 1


def test_gaps(engine):
    got = engine.city.gaps("pharmacy", 5, 3)
    assert got["network"].first()["nodes"] == 35 and got["worst"].count() == 3
    assert got["areas"].agg(F.sum("nodes")).first()[0] <= 35
