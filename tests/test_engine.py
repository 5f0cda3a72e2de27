"""Rules of the query language, hand-computed answers on fixtures, round trips, streams."""

import heapq
import json
import math
import zipfile
from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom import provenance, quality
from geoloom.catalog import TRADE
from geoloom.errors import DataUnavailableError, NotFoundError, QuerySpecError
from geoloom.functions import exprs as X
from geoloom.graph import PropertyGraph, trade_graph, upsert
from geoloom.operators import routing, spatial, transit
from geoloom.plans.compile import compile_query, execute
from geoloom.plans.spec import parse
from geoloom.sources import fixtures, readers, sinks
from geoloom.streaming import events as streams


@pytest.mark.parametrize(
    "raw",
    [
        {},
        {"start": {"type": "Nobody"}},
        {"start": {"type": "Nation", "filters": [{"field": "nope"}]}},
        {"start": {"type": "Nation", "filters": [{"field": "name", "op": "like"}]}},
        {"start": {"type": "Nation", "filters": [{"field": "key", "op": "between", "value": [1]}]}},
        {"start": {"type": "Nation", "filters": [{"field": "key", "op": "in", "value": 3}]}},
        {"start": {"type": "Nation"}, "traverse": [{"relation": "REACHABLE_WITHIN"}]},
        {"start": {"type": "Nation"}, "traverse": [{"relation": "SUPPLIES"}]},
        {"start": {"type": "Nation"}, "traverse": [{"relation": "HAS_SUPPLIER"}] * 5},
        {"start": {"type": "Nation"}, "traverse": [{"relation": "HAS_SUPPLIER"}, {"relation": "HAS_SUPPLIER"}]},
        {"start": {"type": "Nation"}, "group_by": ["name"], "aggregates": [{"function": "sum", "field": "name"}]},
        {"start": {"type": "Nation"}, "limit": 0},
        {"start": {"type": "Nation"}, "limit": True},
        {"start": {"type": "Nation"}, "analyses": [{"mode": "boat"}]},
        {"start": {"type": "Nation"}, "analyses": [{"mode": "walk", "minutes": 61}]},
        {"start": {"type": "Nation"}, "return": ["nothing"]},
    ],
)
def test_refused(raw):
    with pytest.raises((QuerySpecError, NotFoundError)):
        parse(raw, TRADE)


def test_shorthand_takes_the_longest_operator():
    a = parse({"start": {"type": "Nation"}, "analyses": [{"mode": "walk", "operator": "count_not_in", "value": [1]}]}, TRADE).analyses[0]
    assert (a.constraint.field, a.constraint.op) == ("count", "not_in")


def test_limits(spark, sf):
    g = trade_graph(spark, sf)
    got = execute(g, {"start": {"type": "Nation"}, "limit": 7})
    assert got["count"] == 7 and got["truncated"]
    assert not execute(g, {"start": {"type": "Region"}, "limit": 5})["truncated"]
    assert parse({"start": {"type": "Nation"}, "limit": 5000}, TRADE).limit == 1000


def test_filters_reach_the_scan(spark, sf):
    plan = compile_query(trade_graph(spark, sf), {"start": {"type": "Customer", "filters": [{"field": "segment", "op": "eq", "value": "BUILDING"}]}, "return": ["id", "balance"]})._jdf.queryExecution().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "c_name" not in plan.split("ReadSchema")[-1]


def test_null_rules(spark):
    df = spark.createDataFrame([(None, None), ("a", 1.0)], "s string, n double")
    for op, value in (("ne", "x"), ("not_in", ["x"]), ("contains", ""), ("eq", "a")):
        assert df.where(X.predicate(F.col("s"), "string", op, value)).count() == 1
    assert df.where(X.predicate(F.col("n"), "double", "eq", "1")).count() == 0
    assert df.where(X.predicate(F.col("n"), "double", "ne", "1")).count() == 1
    assert df.where(X.predicate(F.col("n"), "double", "gte", "1")).count() == 1


def test_strings_and_times(spark):
    r = spark.range(1).select(
        X.normalize_name(F.lit("  a   b ")).alias("a"), X.normalize_name(F.lit(" None")).alias("b"), X.name_key(F.lit("Café Zür-ich 3")).alias("c"), X.parse_service_time(F.lit("25:15:00")).alias("d"),
        X.parse_service_time(F.lit("25:75:00")).alias("e"), X.format_service_time(F.lit(-90900)).alias("f"), X.parse_service_date(F.lit("20260230")).alias("g"), X.parse_service_date(F.lit("20260228")).alias("h"),
    ).first()
    assert tuple(r) == ("a b", None, "cafezurich3", 90900, None, "-25:15:00", None, date(2026, 2, 28))


def test_projection_there_and_back(spark):
    e, n = X.to_lv95(F.lit(7.5886), F.lit(47.5596))
    lon, lat = X.from_lv95(F.col("e"), F.col("n"))
    r = spark.range(1).select(e.alias("e"), n.alias("n")).select("e", "n", lon.alias("lon"), lat.alias("lat")).first()
    assert abs(r["e"] - 2611300) < 500 and abs(r["n"] - 1267500) < 500 and abs(r["lon"] - 7.5886) < 2e-5 and abs(r["lat"] - 47.5596) < 2e-5


def test_boundary_is_outside_unless_asked(spark):
    points = spark.createDataFrame([(1, 0.0, -10.0), (2, 1100.0, 50.0), (3, 500.0, 500.0)], "point int, x double, y double")
    assert {tuple(r) for r in spatial.contained(points, fixtures.areas(spark), 700.0).collect()} == {(3, "west")}
    assert {tuple(r) for r in spatial.contained(points, fixtures.areas(spark), 700.0, boundary=True).collect()} == {(1, "west"), (2, "west"), (3, "west")}


def test_interior_point(spark):
    got = {r["area"]: r["x"] for r in spatial.interior_point(fixtures.areas(spark)).collect()}
    assert got == {"west": 545.0, "east": 1950.0}


def dijkstra(seeds, edges, cutoff):
    best, queue = {}, [(c, n) for n, c in seeds]
    heapq.heapify(queue)
    while queue:
        c, n = heapq.heappop(queue)
        if n in best or c > cutoff:
            continue
        best[n] = c
        for a, b, w in edges:
            if a == n:
                heapq.heappush(queue, (c + w, b))
            if b == n:
                heapq.heappush(queue, (c + w, a))
    return best


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(1, 50)), min_size=1, max_size=25))
def test_both_ways_find_shortest_paths(spark, edges):
    net = routing.symmetric(spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "u int, v int, length_m double"))
    seeds = spark.createDataFrame([("o", 0, 0.0), ("p", 1, 5.0), ("p", 2, 0.0)], "origin string, node int, cost double")
    want = {("o", n, c) for n, c in dijkstra([(0, 0.0)], edges, 60).items()} | {("p", n, c) for n, c in dijkstra([(1, 5.0), (2, 0.0)], edges, 60).items()}
    for method in ("grouped", "relational"):
        assert {tuple(r) for r in routing.shortest_paths(seeds, net, 60.0, method).select("origin", "node", "cost").collect()} == want


def test_barrier_and_route(spark):
    net = routing.symmetric(fixtures.grid_edges(spark, "walk"))
    costs = routing.shortest_paths(spark.createDataFrame([(0, 2, 0.0)], "origin int, node long, cost double"), net)
    assert routing.route(costs, 3) == [2, 9, 10, 3] and costs.where("node = 3").first()["cost"] == 1350.0
    kept = routing.thinned(costs.join(fixtures.grid_nodes(spark), "node"), 900.0, 4).collect()
    assert len(kept) == 4 and all(math.hypot(a["x"] - b["x"], a["y"] - b["y"]) >= 900 for a in kept for b in kept if a is not b)


def test_edge_repair(spark):
    edges = spark.createDataFrame([(0, 1, None), (1, 2, float("nan")), (2, 3, 7.0), (3, 3, 0.0)], "u long, v long, length_m double")
    assert [tuple(r) for r in routing.repaired_lengths(edges, fixtures.grid_nodes(spark)).orderBy("u").collect()] == [(0, 1, 450.0), (1, 2, 450.0), (2, 3, 7.0)]


def test_timetable(spark):
    t = fixtures.timetable(spark)
    assert tuple(transit.service_window(t["calendar"], t["exceptions"]).first()) == (date(2026, 1, 1), date(2026, 12, 31))
    assert transit.resolve_day(date(2027, 1, 3), {date(2026, 12, 31)}, (date(2026, 1, 1), date(2026, 12, 31))) == date(2026, 12, 31)
    on = lambda d: transit.active_services(t["calendar"], t["exceptions"], d)
    calls = transit.day_view(t["stop_times"], t["trips"], on(date(2026, 8, 22)), on(date(2026, 8, 21)))
    start = spark.createDataFrame([("o", "A", 36000)], "origin string, stop string, ready int")
    got = {r["stop"]: r["arrival"] for r in transit.earliest_arrivals(start, calls, t["transfers"], 45000).collect()}
    assert got["D"] == fixtures.clock("10:11")
    late = spark.createDataFrame([("o", "A", fixtures.clock("10:06"))], "origin string, stop string, ready int")
    weekday = transit.day_view(t["stop_times"], t["trips"], on(date(2026, 8, 20)), on(date(2026, 8, 19)))
    assert {r["stop"]: r["arrival"] for r in transit.earliest_arrivals(late, weekday, t["transfers"], 45000).collect()}["B"] == fixtures.clock("10:19")


def test_calls_compare_with_the_last_kept(spark):
    calls = spark.createDataFrame([("t", 1, "A", 10, 10), ("t", 2, "A", 20, 20), ("t", 3, "B", 5, 5), ("t", 4, "C", 30, 30), ("u", 1, "A", 1, 1)], "trip string, seq int, stop string, arr int, dep int")
    assert [tuple(r) for r in transit.folded_calls(calls).orderBy("pos").collect()] == [("t", 0, "A", 10, 10), ("t", 1, "C", 30, 30)]


def test_graph_round_trip_and_upsert(spark, sf, tmp_path):
    g = trade_graph(spark, sf)
    g.save(str(tmp_path))
    again = PropertyGraph.load(spark, str(tmp_path))
    assert provenance.status(again) == provenance.status(g)
    with pytest.raises(NotFoundError):
        again.get_node("Nation", "nation:77")
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 2)], "id string, v int, _ord int")
    assert {(r["id"], r["v"]) for r in upsert(rows, ["id"], "_ord").collect()} == {("a", 2), ("b", 3)}


def test_inverse_relations_mirror(spark, sf):
    g = trade_graph(spark, sf)
    for r, i in (("HAS_NATION", "PART_OF"), ("PLACED", "PLACED_BY"), ("SUPPLIES", "SUPPLIED_BY"), ("ADJACENT_TO", "ADJACENT_TO")):
        assert g.edges(r).select("src", "dst").exceptAll(g.edges(i).select(F.col("dst").alias("src"), F.col("src").alias("dst"))).count() == 0


def test_lineage(sf):
    raw = {"start": {"type": "Nation"}, "traverse": [{"relation": "HAS_SUPPLIER", "as": "s"}, {"relation": "SUPPLIES", "as": "p", "from": "s"}], "analyses": [{"as": "w", "mode": "walk"}], "return": ["name", "p.count", "w.count"]}
    f = provenance.query_provenance(raw, TRADE)["fields"]
    assert f["name"]["classification"] == "observed" and f["w.count"]["classification"] == "dynamic" and f["p.count"]["relations"] == ["HAS_SUPPLIER", "SUPPLIES"]


def test_sinks_and_readers(spark, sf, tmp_path):
    nodes, edges = fixtures.grid_nodes(spark), fixtures.grid_edges(spark, "walk")
    sinks.to_graphml(nodes.withColumn("node", F.col("node").cast("string")), edges.select(F.col("u").cast("string"), F.col("v").cast("string"), "length_m"), str(tmp_path / "g"))
    n, e = readers.graphml(spark, str(tmp_path / "g"))
    assert n.count() == 35 and e.agg(F.sum("length_m")).first()[0] == 55 * 450.0
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        z.writestr("stop_times.txt", "﻿trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt,25:05:00,25:05:30,A,1\nt,bad,1:00:00,B,2\n")
    assert [tuple(r) for r in readers.stop_times(spark, str(tmp_path / "feed.zip")).collect()] == [("t", 1, "A", 90300, 90330)]
    (tmp_path / "raw.json").write_text("\n".join(json.dumps(x) for x in [{"geometry": {"type": "Point", "coordinates": [7.5, 47.5]}, "name": " A ", "id": "1"}, {"geo_point_2d": {"lon": 7.6, "lat": 47.6}}, {"name": "nowhere"}]))
    got = readers.geojson_records(spark, str(tmp_path / "raw.json"), "school").orderBy("lon").collect()
    assert [(r["name"], r["lon"]) for r in got] == [("A", 7.5), (None, 7.6)] and got[0]["id"] == "school:1"
    feature = json.loads(sinks.features(spark.createDataFrame([("a", 7.1234567, 47.0)], "id string, lon double, lat double")).first()[0])
    assert feature["geometry"]["coordinates"] == [7.123457, 47.0] and feature["properties"] == {"id": "a"}
    files = sinks.manifest(spark.read.format("binaryFile").load(str(tmp_path / "feed.zip")))
    assert sinks.stale(files, files) == {} and sinks.stale({"x": {}}, files) == {"x": "missing", "feed.zip": "unlisted"}


def test_sources_fall_back_or_refuse(spark):
    def broken():
        raise OSError("no network")

    df, mode, reason = readers.resolve(broken, lambda: spark.range(2))
    assert df.count() == 2 and (mode, reason) == ("fixture", "no network")
    with pytest.raises(DataUnavailableError):
        readers.resolve(broken, lambda: spark.range(2), pinned=True)
    one, errors = readers.union_of({"a": lambda: spark.createDataFrame([("x", 1)], "id string, v int"), "b": broken, "c": lambda: spark.createDataFrame([("x", 2), ("y", 3)], "id string, v int")})
    assert {(r["id"], r["v"]) for r in one.collect()} == {("x", 1), ("y", 3)} and errors == {"b": "no network"}


def test_quality(spark):
    rows = [("a", "walk", None, 10.0, "s"), ("a", "walk", "n", 400.0, "t"), ("a", "walk", "n", 900.0, "s")]
    report = [r.asDict() for r in quality.service_report(spark.createDataFrame(rows, "category string, network string, name string, distance_m double, source string")).collect()]
    assert (report[0]["unnamed"], report[0]["poor"], report[0]["failed"], report[0]["median_m"], report[0]["sources"]) == (1, 1, 1, 205.0, ["s", "t"])
    assert len(quality.caveats(report)) == 3 and quality.caveats(report, {"b"}) == []


def test_streams_equal_batches(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.read_events(spark, str(tmp_path / "in"), batch.schema)
    query = streams.tumbling(stream, "1 hour").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    want = streams.tumbling(batch, "1 hour").select("start", "event_type", "n")
    got = spark.table("hours").select("start", "event_type", "n")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert streams.without_duplicates(batch, ["event_id"]).count() == batch.count()
