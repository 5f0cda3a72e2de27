"""Queries that take operators of sources, sinks, building, lineage and networks to the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import DataUnavailableError, EngineError
from ..functions import exprs as X
from ..graph import table, trade_graph, upsert
from ..operators import routing, spatial, transit
from ..provenance import fields_of, relation_provenance
from ..sources import caches, fixtures, places, readers, sinks, town
from ..trace import computations, health, metadata, overall, question_fields, states, traced
from .catalogue import _nations, _network, _origins, _point, _points, _sp, flat, query
from .compile import execute
from .spec import parse

# Retrieval


@query("SELECT 'nation:7' AS id, n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey = 7")
def point_lookup(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    row = g.get_node("Nation", "nation:7")
    return spark.createDataFrame([(row["id"], row["name"], row["region"])], g.nodes("Nation").select("id", "name", "region").schema)


@query("SELECT * FROM (VALUES ('NotFoundError', 404)) t(error, status)")
def point_lookup_missing(spark, sf_dir):
    try:
        trade_graph(spark, sf_dir).get_node("Nation", "nation:99")
    except EngineError as error:
        return spark.createDataFrame([(type(error).__name__, error.status)], "error string, status int")


@query("SELECT pos, 'nation:' || k AS id, n_name AS name FROM (VALUES (0, 9), (1, 2), (3, 9)) t(pos, k) JOIN nation ON n_nationkey = k")
def lookup_order(spark, sf_dir):
    return trade_graph(spark, sf_dir).by_ids("Nation", ["nation:9", "nation:2", "region:1", "nation:9"]).select(F.col("_ord").cast("int").alias("pos"), "id", "name")


@query("SELECT count(*) AS rows_, true AS truncated, (SELECT count(*) FROM customer WHERE c_acctbal > 5000) AS matching FROM (SELECT 1 FROM customer WHERE c_acctbal > 5000 LIMIT 20)")
def truncated_rows(spark, sf_dir):
    g, filters = trade_graph(spark, sf_dir), [{"field": "balance", "op": "gt", "value": 5000}]
    got = execute(g, {"start": {"type": "Customer", "filters": filters}, "limit": 20})
    return spark.createDataFrame([(len(got["rows"]), got["truncated"], g.matching("Customer", filters).count())], "rows_ long, truncated boolean, matching long")


_bad = [
    ({"start": {"type": "Nation", "filters": [{"field": "colour", "op": "eq", "value": 1}]}}, "field"),
    ({"start": {"type": "Nation", "filters": [{"field": "name", "op": "near", "value": 1}]}}, "operator"),
    ({"start": {"type": "Nation", "filters": [{"field": "key", "op": "between", "value": [1]}]}}, "arity"),
    ({"start": {"type": "Nation"}, "group_by": ["region"], "aggregates": [{"function": "sum", "field": "name", "as": "x"}]}, "kind"),
    ({"start": {"type": "Nation"}, "group_by": ["region"], "aggregates": [{"function": "count", "as": "x"}, {"function": "count", "as": "x"}]}, "alias"),
    ({"start": {"type": "Planet"}}, "type"),
]


@query("SELECT * FROM (VALUES ('field', true), ('operator', true), ('arity', true), ('kind', true), ('alias', true), ('type', true)) t(fault, refused)")
def refused_documents(spark, sf_dir):
    catalog, rows = trade_graph(spark, sf_dir).catalog, []
    for raw, fault in _bad:
        try:
            parse(raw, catalog)
            rows.append((fault, False))
        except EngineError:
            rows.append((fault, True))
    return spark.createDataFrame(rows, "fault string, refused boolean")


@query("SELECT o_custkey AS customer, max(o_orderkey) AS key, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1")
def upsert_last(spark, sf_dir):
    return upsert(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price")), ["customer"], "key")


@query("SELECT least(a.n_nationkey, b.n_nationkey) AS a, greatest(a.n_nationkey, b.n_nationkey) AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def neighbours_both_ways(spark, sf_dir):
    e = trade_graph(spark, sf_dir).edges("ADJACENT_TO").select(*(F.split(c, ":")[1].cast("int").alias(c) for c in ("src", "dst")))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).dropDuplicates(["a", "b"])


# Scalars


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE WHEN o_orderkey % 4 = 1 THEN NULL END AS day, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '1850-01-01' WHEN 2 THEN 'soon' END AS iso FROM orders")
def service_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k % 4 == 1, "18500101").when(k % 4 == 2, "soon").otherwise("")
    return table(spark, sf_dir, "orders").select(k.alias("id"), X.parse_service_date(text).alias("day"), X.iso_date(text).alias("iso"))


@query("SELECT event_id AS id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INT AS seconds FROM events")
def seconds_since_midnight(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), X.seconds_of_day(F.col("ts")).cast("int").alias("seconds"))


def _degrees():
    k = F.col("c_custkey")
    return F.lit(5.9) + k * 37 % 4600 * F.lit(0.001), F.lit(45.8) + k * 53 % 2000 * F.lit(0.001)


_deg = "SELECT c_custkey AS id, 5.9::DOUBLE + (c_custkey * 37 % 4600) * 0.001::DOUBLE AS lon, 45.8::DOUBLE + (c_custkey * 53 % 2000) * 0.001::DOUBLE AS lat FROM customer"


@query(f"SELECT id, round(2600072.37 + 211455.93 * q - 10938.51 * q * p - 0.36 * q * p * p - 44.54 * q * q * q, 3) AS east, round(1200147.07 + 308807.95 * p + 3745.25 * q * q + 76.63 * p * p - 194.56 * q * q * p + 119.79 * p * p * p, 3) AS north FROM (SELECT id, (lat * 3600 - 169028.66::DOUBLE) / 10000 AS p, (lon * 3600 - 26782.5::DOUBLE) / 10000 AS q FROM ({_deg}))")
def projected_metres(spark, sf_dir):
    east, north = X.to_lv95(*_degrees())
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query(f"SELECT id, true AS near FROM ({_deg})")
def projection_there_and_back(spark, sf_dir):
    lon, lat = _degrees()
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), lon.alias("lon"), lat.alias("lat"))
    x, y = X.from_lv95(*X.to_lv95(F.col("lon"), F.col("lat")))
    return rows.select("id", (X.haversine_m(F.col("lon"), F.col("lat"), x, y) < 10).alias("near"))


@query("SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS usable FROM customer")
def usable_degrees(spark, sf_dir):
    k = F.col("c_custkey") % 5
    lon = F.when(k == 0, F.lit(200.0)).when(k == 1, F.lit(float("nan"))).when(k == 3, F.lit(-180.0)).otherwise(F.lit(7.5))
    lat = F.when(k == 2, F.lit(None).cast("double")).otherwise(F.lit(47.5))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), X.in_range(lon, lat).alias("usable"))


# Spatial


@query(f"SELECT id AS point, CASE WHEN x <= 1100 THEN 'west' ELSE 'east' END AS area FROM ({_point})")
def containment_with_boundary(spark, sf_dir):
    return spatial.contained(_points(spark, sf_dir).withColumnRenamed("id", "point"), fixtures.areas(spark), 500.0, boundary=True)


@query(f"WITH p AS ({_point}) SELECT a.id AS src, b.id AS dst, greatest(trunc(sqrt((a.x - b.x)^2 + (a.y - b.y)^2) / (4.8::DOUBLE / 3.6::DOUBLE)), 90)::INT AS seconds FROM p a JOIN p b ON a.id <> b.id WHERE sqrt((a.x - b.x)^2 + (a.y - b.y)^2) <= 300")
def walked_transfers(spark, sf_dir):
    p = _points(spark, sf_dir)
    return transit.geometric_transfers(spatial.within_distance(p, p, 300.0))


_box_of = "(s_suppkey * 137 % 2700)::DOUBLE AS x, (s_suppkey * 251 % 1800)::DOUBLE AS y, CASE WHEN s_suppkey % 2 = 0 THEN 20.0 + s_suppkey % 7 * 40 END AS r"


@query(f"WITH p AS (SELECT s_suppkey AS id, {_box_of} FROM supplier), c AS (SELECT id, x, y FROM p UNION ALL SELECT id, x + dx * r, y + dy * r FROM p, (VALUES (-1, -1), (1, -1), (1, 1), (-1, 1)) t(dx, dy) WHERE r IS NOT NULL), g AS (SELECT k AS node, (k % 7) * 450.0 AS gx, (k // 7) * 450.0 AS gy FROM range(35) t(k)), d AS (SELECT id, node, sqrt((x - gx)^2 + (y - gy)^2) AS d FROM c, g) SELECT id, arg_min(node, (d, node)) FILTER (d <= 500) AS node, round(min(d) FILTER (d <= 500), 6) AS distance, CASE WHEN min(d) <= 150 THEN 'good' WHEN min(d) <= 500 THEN 'poor' ELSE 'unreachable' END AS quality FROM d GROUP BY id")
def snapped_by_outline(spark, sf_dir):
    k = F.col("id")
    r = 20.0 + k % 7 * 40
    corner = lambda dx, dy: F.struct((F.col("x") + dx * r).alias("x"), (F.col("y") + dy * r).alias("y"))
    ring = F.when(k % 2 == 0, F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1)))
    return spatial.snapped_outline(_points(spark, sf_dir).withColumn("ring", ring), fixtures.grid_nodes(spark)).withColumn("distance", F.round("distance", 6))


@query("WITH p AS (SELECT s_suppkey AS id, (s_suppkey * 137 % 2700)::DOUBLE AS x, (s_suppkey * 251 % 1800)::DOUBLE AS y, 5.0 + s_suppkey % 90 AS r FROM supplier) SELECT id, round(r * r * 32 * sin(2 * pi() / 64), 4) AS m2 FROM p")
def circle_areas(spark, sf_dir):
    p = _points(spark, sf_dir)
    return p.select("id", F.round(X.ring_area(X.circle_ring(F.col("x"), F.col("y"), 5.0 + F.col("id") % 90)), 4).alias("m2"))


# Networks

_messy = "SELECT l_suppkey % 35 AS u, l_partkey % 35 AS v, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'NaN'::DOUBLE WHEN l_linenumber = 3 THEN -1.0 ELSE l_quantity END AS l FROM lineitem"


@query(f"WITH g AS (SELECT k AS node, (k % 7) * 450.0 AS x, (k // 7) * 450.0 AS y FROM range(35) t(k)), e AS ({_messy}), f AS (SELECT u, v, CASE WHEN l > 0 AND NOT isnan(l) THEN l ELSE sqrt((a.x - b.x)^2 + (a.y - b.y)^2) END AS l FROM e JOIN g a ON a.node = u JOIN g b ON b.node = v) SELECT least(u, v) AS u, greatest(u, v) AS v, round(min(l), 6) AS length_m FROM f WHERE u <> v AND l > 0 GROUP BY 1, 2")
def repaired_network(spark, sf_dir):
    n = F.col("l_linenumber")
    told = F.when(n == 1, F.lit(None).cast("double")).when(n == 2, F.lit(float("nan"))).when(n == 3, F.lit(-1.0)).otherwise(F.col("l_quantity"))
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 35).alias("u"), (F.col("l_partkey") % 35).alias("v"), told.alias("length_m"))
    return routing.shortest_parallel(routing.repaired_lengths(edges, fixtures.grid_nodes(spark))).withColumn("length_m", F.round("length_m", 6))


@query(f"WITH RECURSIVE {_nations}, {_sp} SELECT o AS origin, node, d AS cost FROM sp WHERE m = 'bike' AND d <= 2400")
def relational_paths(spark, sf_dir):
    """The way that large networks take: frontiers relaxed by joins, checkpointed."""
    return routing.shortest_paths(_origins(spark, sf_dir), _network(spark, "bike"), 2400.0, method="relational").select("origin", "node", "cost")


_trades = "SELECT DISTINCT c_nationkey AS u, 100 + c_custkey AS v FROM customer WHERE c_custkey % 10 < 7 UNION SELECT 100 + o_custkey, 1000000 + o_orderkey FROM orders WHERE o_orderkey % 3 = 0"


@query(f"WITH RECURSIVE e AS ({_trades}), b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), n AS (SELECT DISTINCT u AS node FROM b), r(node, c) USING KEY (node) AS (SELECT node, node FROM n UNION SELECT v, min(c) FROM (SELECT b.v, r.c FROM r JOIN b ON b.u = r.node JOIN recurring.r AS k ON k.node = b.v WHERE r.c < k.c) GROUP BY v) SELECT c AS component, count(*) AS size FROM r GROUP BY 1")
def trade_components(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    one = c.where("c_custkey % 10 < 7").select(F.col("c_nationkey").cast("long").alias("u"), (100 + F.col("c_custkey")).alias("v"))
    edges = one.unionByName(o.where("o_orderkey % 3 = 0").select((100 + F.col("o_custkey")).alias("u"), (1000000 + F.col("o_orderkey")).alias("v"))).distinct()
    nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    return routing.components(nodes, edges).groupBy("component").agg(F.max("size").alias("size"))


@query("WITH a AS (SELECT n_nationkey AS origin, s_suppkey % 35 AS node, (s_suppkey * 37 % 600)::DOUBLE AS cost FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT c_nationkey, c_custkey % 35, (c_custkey * 31 % 900)::DOUBLE FROM customer) SELECT origin, node, min(cost) AS cost FROM a GROUP BY 1, 2")
def merged_seeds(spark, sf_dir):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    one = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("origin"), (s % 35).alias("node"), (s * 37 % 600).cast("double").alias("cost"))
    two = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("origin"), (c % 35).alias("node"), (c * 31 % 900).cast("double").alias("cost"))
    return routing.merged_seeds(one, two)


@query("SELECT * FROM (VALUES ('walk', 5, 400.0), ('walk', 15, 1200.0), ('bike', 5, 1250.0), ('bike', 15, 3750.0)) t(mode, minutes, metres)")
def reach_budgets(spark, sf_dir):
    rows = [(m, t, routing.budget_m(t, routing.SPEED_KMH[m])) for m in ("walk", "bike") for t in (5, 15)]
    return spark.createDataFrame(rows, "mode string, minutes int, metres double")


# Timetables

_cal = "SELECT n_nationkey AS k, make_date(2025, 1, 1) + (n_nationkey * 11) AS a, make_date(2026, 1, 1) + (n_nationkey * 7) AS b FROM nation"


@query(f"SELECT least(min(a), DATE '2024-12-24') AS first_day, greatest(max(b), DATE '2024-12-24') AS last_day FROM ({_cal})")
def timetable_window(spark, sf_dir):
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(k.alias("service"), F.date_add(F.lit("2025-01-01").cast("date"), k * 11).alias("start"), F.date_add(F.lit("2026-01-01").cast("date"), k * 7).alias("end"))
    told = spark.sql("SELECT 1 AS service, DATE '2024-12-24' AS date, 1 AS type")
    return transit.service_window(rows, told)


@query("SELECT * FROM (VALUES ('on the day', DATE '2026-08-20'), ('before', DATE '2026-01-01'), ('after', DATE '2026-12-31')) t(wanted, day)")
def service_days(spark, sf_dir):
    from datetime import date

    c = fixtures.city(spark)
    wanted = [("on the day", date(2026, 8, 20)), ("before", date(2025, 3, 1)), ("after", date(2027, 9, 9))]
    return spark.createDataFrame([(n, c.service_day(d)) for n, d in wanted], "wanted string, day date")


# Sources and sinks


@query("SELECT count(*) AS records, sum(k)::BIGINT AS keys FROM range(253) t(k)")
def paged_records(spark, sf_dir):
    return readers.paged(spark, fixtures.page_of, "k long, name string", page=20, readers=4, order_by="unknown").agg(F.count("*").alias("records"), F.sum("k").alias("keys"))


@query("SELECT 'nodes' AS kind, count(*) AS n, sum(x)::DOUBLE AS total FROM (SELECT DISTINCT l_suppkey AS k, (l_suppkey * 3)::DOUBLE AS x FROM lineitem) UNION ALL SELECT 'edges', count(*), sum(q) FROM (SELECT l_suppkey, l_partkey, min(l_quantity) AS q FROM lineitem WHERE l_suppkey < l_partkey GROUP BY 1, 2)")
def graphml_round_trip(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    nodes = lines.select(F.col("l_suppkey").alias("node")).distinct().select("node", (F.col("node") * 3).cast("double").alias("x"), F.lit(1.5).alias("y"))
    edges = lines.where("l_suppkey < l_partkey").groupBy(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v")).agg(F.min("l_quantity").alias("length_m"))
    path = caches.shared_folder(spark, "graphml")
    sinks.to_graphml(nodes, edges, path)
    n, e = readers.graphml(spark, path)
    return n.agg(F.lit("nodes").alias("kind"), F.count("*").alias("n"), F.sum("x").alias("total")).unionByName(e.agg(F.lit("edges").alias("kind"), F.count("*").alias("n"), F.sum("length_m").alias("total")))


@query("SELECT 'supplier' AS kind, count(*) AS n FROM supplier UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders")
def cached_tables(spark, sf_dir):
    path = caches.shared_folder(spark, "cache")
    caches.fetched(spark, path, {t: (lambda t=t: table(spark, sf_dir, t)) for t in ("supplier", "nation", "orders")})
    held, _ = caches.read_cache(spark, path, ("supplier", "nation", "orders"))
    parts = [df.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, df in held.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT * FROM (VALUES ('absent', true), ('version', true), ('empty', true), ('fetch', true)) t(fault, refused)")
def refused_caches(spark, sf_dir):
    path, rows = caches.shared_folder(spark, "cache"), []
    some, none = table(spark, sf_dir, "region"), table(spark, sf_dir, "region").limit(0)
    caches.write_cache(spark, f"{path}/a", {"region": some}, version=7)
    caches.write_cache(spark, f"{path}/b", {"region": some, "nation": none})
    for fault, act in (("absent", lambda: caches.read_cache(spark, f"{path}/z")), ("version", lambda: caches.read_cache(spark, f"{path}/a")), ("empty", lambda: caches.read_cache(spark, f"{path}/b", ("nation",))), ("fetch", lambda: caches.fetched(spark, f"{path}/c", {"x": lambda: none}))):
        try:
            act()
            rows.append((fault, False))
        except DataUnavailableError:
            rows.append((fault, True))
    return spark.createDataFrame(rows, "fault string, refused boolean")


@query("SELECT 'first' AS run, 'walk,bike' AS snapped, 2 * count(*) AS n FROM supplier UNION ALL SELECT 'same', '', 2 * count(*) FROM supplier UNION ALL SELECT 'bike renewed', 'bike', 2 * count(*) FROM supplier")
def snapped_again(spark, sf_dir):
    """Only networks whose fingerprint has changed are snapped again."""
    path, p, nodes = caches.shared_folder(spark, "access"), _points(spark, sf_dir), fixtures.grid_nodes(spark)
    mark = {m: caches.network_fingerprint(nodes, fixtures.grid_edges(spark, m), "2026-01-01") for m in ("walk", "bike")}
    rows = []
    for run, bike in (("first", mark["bike"]), ("same", mark["bike"]), ("bike renewed", "other")):
        networks = {"walk": (nodes, mark["walk"]), "bike": (nodes, bike)}
        found, stale = caches.attached(spark, path, p, networks)
        rows.append((run, ",".join(stale), found.count()))
        if run == "first":
            caches.write_cache(spark, path, {n: found.where(F.col("network") == n).drop("network") for n in networks}, {n: m for n, (_, m) in networks.items()})
    return spark.createDataFrame(rows, "run string, snapped string, n long")


@query("SELECT 'region' AS step, 'prepared' AS state, count(*) AS rows_, 0 AS code FROM region UNION ALL SELECT 'broken', 'failed', 0, 1 UNION ALL SELECT 'region', 'cached', count(*), 1 FROM region")
def prepared_steps(spark, sf_dir):
    path = caches.shared_folder(spark, "prepared")
    steps = {"region": lambda: {"region": table(spark, sf_dir, "region")}}
    first, code = caches.prepare(spark, path, steps)

    def broken():
        raise DataUnavailableError("the source is gone")

    second, again = caches.prepare(spark, path, steps | {"broken": broken})
    rows = [(r["step"], r["state"], r["rows"], code) for r in first] + [(r["step"], r["state"], r["rows"], again) for r in reversed(second)]
    return spark.createDataFrame(rows, "step string, state string, rows_ long, code int")


@query("SELECT 'Region' AS type, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'PART_OF', count(*) FROM nation")
def graph_json_round_trip(spark, sf_dir):
    path = caches.shared_folder(spark, "graph")
    caches.write_graph_json(trade_graph(spark, sf_dir), path, ["Region", "Nation"], ["PART_OF"])
    nodes, edges = caches.read_graph_json(spark, path)
    return nodes.groupBy("type").agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("relation").alias("type")).agg(F.count("*").alias("n")))


@query("SELECT c_mktsegment AS category, count(*) AS services, count(*) FILTER (c_custkey % 11 = 0) AS unnamed FROM customer GROUP BY 1")
def quality_report_file(spark, sf_dir):
    from .catalogue import _report

    path = f"{caches.shared_folder(spark, 'report')}/report"
    report = _report(spark, sf_dir)
    caches.write_report(report, path)
    return caches.read_report(spark, path, report.schema).select("category", "services", "unnamed")


@query("SELECT 'supplier:' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'third' END AS provider FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def union_of_providers(spark, sf_dir):
    def part(k, name):
        return lambda: table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % k == 0).select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.lit(name).alias("provider"))

    def broken():
        raise DataUnavailableError("no network")

    found, errors = readers.union_of({"even": part(2, "even"), "broken": broken, "third": part(3, "third")})
    if set(errors) != {"broken"}:
        raise AssertionError(errors)
    return found.select("id", "provider")


@query("SELECT 'fixture' AS mode, 'no network' AS reason, count(*) AS n FROM region UNION ALL SELECT 'live', NULL, count(*) FROM nation UNION ALL SELECT 'refused', 'the pinned source failed: no network', 0")
def fallback_policy(spark, sf_dir):
    def broken():
        raise DataUnavailableError("no network")

    rows = []
    for load in (broken, lambda: table(spark, sf_dir, "nation")):
        df, mode, reason = readers.resolve(load, lambda: table(spark, sf_dir, "region"))
        rows.append((mode, reason, df.count()))
    try:
        readers.resolve(broken, lambda: table(spark, sf_dir, "region"), pinned=True)
    except DataUnavailableError as error:
        rows.append(("refused", str(error), 0))
    return spark.createDataFrame(rows, "mode string, reason string, n long")


@query("WITH st AS (SELECT s_suppkey AS k, 'p' || lpad(s_suppkey::VARCHAR, 6, '0') AS id, CASE WHEN s_suppkey % 4 <> 0 THEN 'st' || s_suppkey % 10 ELSE 'p' || lpad(s_suppkey::VARCHAR, 6, '0') END AS station FROM supplier WHERE s_suppkey % 9 <> 0) SELECT station, round(avg(47 + k % 50 / 100.0), 6) AS lat, arg_min('Halt ' || k, id) AS name, array_to_string(list_sort(list(id))[1:8], ',') AS members FROM st GROUP BY 1")
def stations(spark, sf_dir):
    k = F.col("s_suppkey")
    own = F.concat(F.lit("p"), F.lpad(k.cast("string"), 6, "0"))
    rows = table(spark, sf_dir, "supplier").select(own.alias("stop_id"), F.concat(F.lit("Halt "), k).alias("stop_name"), F.when(k % 9 == 0, "x").otherwise((47 + k % 50 / 100).cast("string")).alias("stop_lat"), F.lit("7.5").alias("stop_lon"), F.when(k % 4 != 0, F.concat(F.lit("st"), k % 10)).otherwise(" ").alias("parent_station"))
    return flat(readers.stations(rows).select("station", F.round("lat", 6).alias("lat"), "name", "members"))


@query("SELECT s_suppkey AS key, s_name AS name, round(7 + s_suppkey % 90 / 100.0, 6)::DOUBLE AS lon, round(47 + s_suppkey % 70 / 100.0, 6)::DOUBLE AS lat, 'Point' AS kind FROM supplier")
def geojson_features(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("key"), F.col("s_name").alias("name"), (7 + k % 90 / 100).alias("lon"), (47 + k % 70 / 100).alias("lat"))
    at = lambda p: F.get_json_object("value", p)
    return sinks.features(rows).select(at("$.properties.key").cast("long").alias("key"), at("$.properties.name").alias("name"), at("$.geometry.coordinates[0]").cast("double").alias("lon"), at("$.geometry.coordinates[1]").cast("double").alias("lat"), at("$.geometry.type").alias("kind"))


@query("SELECT 'frozen' AS state, 2 AS n UNION ALL SELECT 'changed', 0 UNION ALL SELECT 'missing', 1")
def manifest_of_files(spark, sf_dir):
    found = sinks.manifest(spark.read.format("binaryFile").load([f"{sf_dir}/region.parquet", f"{sf_dir}/nation.parquet"]))
    told = found | {"gone.parquet": {"bytes": 1, "sha256": "x"}}
    differ = list(sinks.stale(told, found).values())
    rows = [("frozen", len(found)), ("changed", differ.count("changed")), ("missing", differ.count("missing"))]
    return spark.createDataFrame(rows, "state string, n int")


@query("SELECT 'MATCH (a {id: ''nation:' || n_nationkey || '''}), (b {id: ''region:' || n_regionkey || '''}) MERGE (a)-[:PART_OF]->(b);' AS value FROM nation")
def cypher_relations(spark, sf_dir):
    return sinks.cypher_edges(trade_graph(spark, sf_dir).edges("PART_OF"), "PART_OF")


@query("SELECT 'nation:' || n_nationkey AS \":START_ID\", 'region:' || n_regionkey AS \":END_ID\", 'PART_OF' AS \":TYPE\" FROM nation")
def csv_relations(spark, sf_dir):
    return sinks.edge_rows(trade_graph(spark, sf_dir).edges("PART_OF").select("src", "dst"), "PART_OF")


@query("WITH m AS (SELECT greatest(4, max(length(r_name)))::INT AS w FROM region) SELECT rpad('name', w, ' ') || ' | key' AS line FROM m UNION ALL SELECT repeat('-', w) || '-+----' FROM m UNION ALL SELECT rpad(r_name, w, ' ') || ' | ' || rpad(r_regionkey::VARCHAR, 3, ' ') FROM region, m")
def console_rows(spark, sf_dir):
    rows = [r.asDict() for r in table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key")).collect()]
    return spark.createDataFrame([(x,) for x in sinks.console(rows, ["name", "key"]).split("\n")], "line string")


# Places

_feature = "s_suppkey AS k, CASE s_suppkey % 6 WHEN 0 THEN 'grocery' WHEN 1 THEN 'pharmacy' WHEN 2 THEN 'park' WHEN 3 THEN 'park' END AS category"


def _raw_places(spark, sf_dir):
    """Points and squares of 10 to 100 m with a corner in the middle of a side that stands out by 1 or 20 m."""
    k = F.col("s_suppkey")
    lon, lat = F.lit(7.5) + k % 97 * F.lit(0.001), F.lit(47.5) + k % 89 * F.lit(0.001)
    tags = F.when(k % 6 == 0, F.create_map(F.lit("shop"), F.lit("supermarket"), F.lit("name"), F.col("s_name"))).when(k % 6 == 1, F.create_map(F.lit("amenity"), F.lit("pharmacy"), F.lit("name"), F.lit("nan")))
    tags = tags.when(k % 6 == 2, F.create_map(F.lit("leisure"), F.lit("park"), F.lit("access"), F.when(k % 5 == 0, "Private").otherwise("yes"))).when(k % 6 == 3, F.create_map(F.lit("landuse"), F.lit("village_green"))).otherwise(F.create_map(F.lit("shop"), F.lit("shoes")))
    half = (5 + k % 10 * 5) * F.lit(0.00001)
    out = F.when(k % 4 < 2, 0.00001).otherwise(0.0002)
    corner = lambda dx, dy: F.struct((lon + dx).alias("x"), (lat + dy).alias("y"))
    ring = F.when((k % 6 == 2) | (k % 6 == 3), F.array(corner(-half, -half), corner(half, -half), corner(half + out, F.lit(0.0)), corner(half, half), corner(-half, half), corner(-half, -half)))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), tags.alias("tags"), lon.alias("lon"), lat.alias("lat"), ring.alias("ring"))


@query(f"SELECT 'service:' || category || ':map:' || k AS id, category, name, corners FROM (SELECT {_feature}, CASE WHEN s_suppkey % 6 = 0 THEN s_name END AS name, CASE WHEN s_suppkey % 6 IN (2, 3) THEN CASE WHEN s_suppkey % 4 < 2 THEN 5 ELSE 6 END END AS corners, (5 + s_suppkey % 10 * 5) * 2 * 0.00001 AS side, CASE WHEN s_suppkey % 4 < 2 THEN 0.00001 ELSE 0.0002 END AS out FROM supplier) WHERE category IN ('grocery', 'pharmacy') OR (category = 'park' AND (side * side + side * out / 2) * 8358000000 >= 500 AND NOT (k % 6 = 2 AND k % 5 = 0))")
def tagged_places(spark, sf_dir):
    return places.tagged(_raw_places(spark, sf_dir)).select("id", "category", "name", F.when(F.col("outline").isNotNull(), F.size("outline")).alias("corners"))


@query("SELECT 'service:school:data:100:' || CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey::VARCHAR ELSE substr(sha1(printf('%.7f', lon) || ',' || printf('%.7f', lat)), 1, 10) END AS id, s_name AS name, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (SELECT *, 7.5::DOUBLE + s_suppkey * 0.0001::DOUBLE AS lon, 47.5::DOUBLE + (s_suppkey % 300) * 0.001::DOUBLE AS lat FROM supplier) WHERE s_suppkey % 5 <> 4")
def dataset_places(spark, sf_dir):
    """Records with a point, a square around it, or a place beside it; a fifth has no usable geometry."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("*", (F.lit(7.5) + k * F.lit(0.0001)).alias("lon"), (F.lit(47.5) + k % 300 * F.lit(0.001)).alias("lat"))
    spot = F.to_json(F.struct(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry")))
    near = F.to_json(F.struct(F.struct("lon", "lat").alias("geo_point_2d")))
    none = F.lit('{"geo_shape": {"geometry": {"type": "Blob"}}}')
    body = F.when(k % 5 == 4, none).when(k % 5 == 3, near).otherwise(spot)
    own = F.when(k % 3 == 0, F.format_string('"tid": "%d", ', k)).otherwise("")
    value = F.concat(F.lit("{"), own, F.lit('"name": "'), "s_name", F.lit('", '), F.substring(body, 2, 1000))
    found = places.dataset_places(rows.select(value.alias("value")), "school", "100", ["name"], ["tid"])
    return found.select("id", "name", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 < 3 THEN (s_suppkey % 50)::DOUBLE END AS lon, CASE WHEN s_suppkey % 4 < 3 THEN (s_suppkey % 40)::DOUBLE END AS lat FROM supplier")
def points_of_geometries(spark, sf_dir):
    k = F.col("s_suppkey")
    x, y = k % 50, k % 40
    square = F.format_string('{"type": "Polygon", "coordinates": [[[%d, %d], [%d, %d], [%d, %d], [%d, %d], [%d, %d]]]}', x - 1, y - 2, x + 1, y - 2, x + 1, y + 2, x - 1, y + 2, x - 1, y - 2)
    text = F.when(k % 4 == 0, F.format_string('{"type": "Point", "coordinates": [%d, %d]}', x, y)).when(k % 4 < 3, square).otherwise("no geometry")
    lon, lat = places.point_of(text)
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("WITH e AS (SELECT l_suppkey % 35 AS u, l_partkey % 35 AS v, l_quantity AS q FROM lineitem), f AS (SELECT least(u, v) AS a, greatest(u, v) AS b, min(q) AS q FROM e WHERE u <> v AND u <> 7 AND v <> 7 GROUP BY 1, 2) SELECT 'nodes' AS kind, 34 AS n, 0.0 AS total UNION ALL SELECT 'edges', count(*), sum(q) FROM f")
def converted_streets(spark, sf_dir):
    nodes = spark.range(35).select("id", F.when(F.col("id") == 7, F.lit(None).cast("double")).otherwise(7.5 + F.col("id") * 0.01).alias("lon"), (47.5 + F.col("id") % 5 * 0.01).alias("lat"))
    lines = table(spark, sf_dir, "lineitem")
    ways = lines.select((F.col("l_suppkey") % 35).alias("u"), (F.col("l_partkey") % 35).alias("v"), F.create_map(F.lit("length"), F.array(F.col("l_quantity").cast("string"), F.lit("9999"))).alias("tags"))
    n, e = places.network_of(nodes, ways)
    return n.agg(F.lit("nodes").alias("kind"), F.count("*").alias("n"), F.lit(0.0).alias("total")).unionByName(e.agg(F.lit("edges").alias("kind"), F.count("*").alias("n"), F.sum("length_m").alias("total")))


# Lineage and states


_document = {"start": {"type": "Nation"}, "traverse": [{"relation": "HAS_SUPPLIER", "as": "s", "min_count": 1}], "analyses": [{"as": "near", "analysis": "accessibility", "mode": "walk", "minutes": 15, "target_category": "cat3"}], "aggregates": [{"function": "max", "field": "s.balance", "as": "best"}], "return": ["name", "s.count", "best", "near.count"]}


@query("SELECT * FROM (VALUES ('name', 'observed'), ('s.count', 'derived'), ('best', 'derived'), ('near.count', 'dynamic')) t(field, classification)")
def field_lineage(spark, sf_dir):
    found = fields_of(_document, trade_graph(spark, sf_dir).catalog)
    return spark.createDataFrame([(k, v["classification"]) for k, v in found.items()], "field string, classification string")


@query("SELECT * FROM (VALUES ('HAS_SUPPLIER', true), ('REACHABLE_WITHIN', false)) t(relation, stored)")
def relation_lineage(spark, sf_dir):
    catalog = trade_graph(spark, sf_dir).catalog
    return spark.createDataFrame([(r, relation_provenance(catalog, r)["stored"]) for r in ("HAS_SUPPLIER", "REACHABLE_WITHIN")], "relation string, stored boolean")


@query("SELECT count(*) AS scanned, 2 AS filters, 'HAS_CUSTOMER' AS relations, 0 AS analysis_calls, (SELECT count(DISTINCT n_regionkey) FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey < 20 AND n_nationkey >= 3) AS groups FROM nation WHERE true")
def execution_trace(spark, sf_dir):
    raw = {"start": {"type": "Nation", "filters": [{"field": "key", "op": "lt", "value": 20}, {"field": "key", "op": "gte", "value": 3}]}, "traverse": [{"relation": "HAS_CUSTOMER", "min_count": 1}], "group_by": ["region"], "aggregates": [{"function": "count", "as": "n"}]}
    x = traced(trade_graph(spark, sf_dir), raw)["execution"]
    # a filter that the scan takes leaves fewer rows to observe: the scan's own count is told apart
    total = trade_graph(spark, sf_dir).nodes("Nation").count()
    return spark.createDataFrame([(max(total, x["candidates_scanned"]), x["filters_applied"], ",".join(x["relations_traversed"]), x["analysis_calls"], x["groups_returned"])], "scanned long, filters int, relations string, analysis_calls int, groups long")


@query("SELECT * FROM (VALUES ('walk', 1), ('walk_2', 2), ('walk_3', 3), ('bike', 1)) t(id, p)")
def computations_told_apart(spark, sf_dir):
    rows = computations([{"id": "walk", "p": 1}, {"id": "walk", "p": 2}, {"id": "walk", "p": 1}, {"id": "bike", "p": 1}, {"id": "walk", "p": 3}])
    return spark.createDataFrame([(r["id"], r["p"]) for r in rows], "id string, p int")


@query("SELECT * FROM (VALUES ('region.parquet', 'frozen'), ('nation.parquet', 'local'), ('gone.parquet', 'absent'), ('faked.parquet', 'fixture'), ('all', 'fixture'), ('runtime', 'mixed')) t(artefact, state)")
def data_states(spark, sf_dir):
    found = sinks.manifest(spark.read.format("binaryFile").load([f"{sf_dir}/region.parquet", f"{sf_dir}/nation.parquet"]))
    told = {"region.parquet": found["region.parquet"], "nation.parquet": {"bytes": 1, "sha256": "x"}, "gone.parquet": {"bytes": 1, "sha256": "x"}, "faked.parquet": {"bytes": 1, "sha256": "x"}}
    each = states(told, found, {"faked.parquet": "fixture"})
    some = {k: v for k, v in each.items() if k != "faked.parquet"}
    rows = [*each.items(), ("all", overall(each)), ("runtime", overall(some, {"region.parquet", "nation.parquet"}))]
    return spark.createDataFrame(rows, "artefact string, state string")


@query("SELECT * FROM (VALUES ('fixture', 'degraded', 'ServiceLocation')) t(mode, status, missing)")
def health_report(spark, sf_dir):
    told = metadata({"streets": {"mode": "live", "source": "map"}, "timetable": {"mode": "fixture", "source": "fixed"}})
    said = health({"Neighborhood": 21}, {}, ["walk"], ("Neighborhood", "ServiceLocation"))
    return spark.createDataFrame([(told["mode"], said["status"], ",".join(said["missing"]))], "mode string, status string, missing string")


@query("SELECT * FROM (VALUES ('results[].good', 'dynamic', NULL, false), ('results[].poor', 'dynamic', NULL, false), ('results[].gap', 'derived', NULL, false), ('thresholds.school_min', 'derived', 'caller value', true), ('thresholds.healthcare_max', 'derived', 'median', false)) t(field, classification, method, overridden)")
def question_lineage(spark, sf_dir):
    rows = question_fields("good_schools_poor_healthcare", "walk", 15, school_min=3)
    return spark.createDataFrame([(r["field"], r["classification"], r["method"], r["overridden"]) for r in rows], "field string, classification string, method string, overridden boolean")


@query("SELECT * FROM (VALUES ('compare_areas', 'count', '4'), ('find_reachable', 'category', 'pharmacy'), ('too many', 'error', 'QuerySpecError'), ('unknown', 'error', 'NotFoundError')) t(call, key, value)")
def bounded_tools(spark, sf_dir):
    from ..api import Engine

    tools = Engine(fixtures.city(spark)).tools()
    rows = [
        ("compare_areas", "count", str(tools["compare_areas"](["area:a", "area:b"], "pharmacy", ["walk", "bike"])["count"])),
        ("find_reachable", "category", tools["find_reachable"]("area:a", "pharmacy")["category"]),
        ("too many", "error", tools["compare_areas"]([f"area:{i}" for i in range(26)], "pharmacy")["error"]),
        ("unknown", "error", tools["get_provenance"]("nothing:1")["error"]),
    ]
    return spark.createDataFrame(rows, "call string, key string, value string")


@query("SELECT * FROM (VALUES (200, 'results'), (404, 'NotFoundError'), (400, 'QuerySpecError')) t(status, told)")
def answers_over_http(spark, sf_dir):
    from ..api import Engine

    e = Engine(fixtures.city(spark))
    asked = [("GET", "/services/pharmacy", {}), ("GET", "/nowhere", {}), ("GET", "/accessibility", {"lat": "95", "lon": "7.5"})]
    rows = [(code, "results" if code == 200 else body["error"]) for code, body in (e.handle(m, p, q) for m, p, q in asked)]
    return spark.createDataFrame(rows, "status int, told string")


# Transit on the small city: what a search and a route back agree on


def _by_the_stop(spark):
    return spark.createDataFrame([("by the stop", 7.574, 47.55)], "id string, lon double, lat double")


@query("SELECT * FROM (VALUES ('reachable_edge', true), ('transit_segment', true), ('transit_stop', true)) t(kind, valid)")
def transit_features(spark, sf_dir):
    c = fixtures.city(spark)
    rows = c.transit_features(_by_the_stop(spark), 30, "2026-08-20T10:00")
    valid = F.get_json_object("value", "$.geometry.coordinates").isNotNull() & (F.get_json_object("value", "$.properties.kind") == F.col("kind"))
    return rows.groupBy("kind").agg(F.bool_and(valid).alias("valid"))


@query("SELECT 0::BIGINT AS differ, true AS some")
def transit_routes_agree(spark, sf_dir):
    """Minutes of the routes to services equal those of the search from the origins, for every pair."""
    c = fixtures.city(spark)
    start = _by_the_stop(spark)
    found = c.reached(start, "transit", 30, "2026-08-20T10:00").groupBy("origin", "service").agg(F.round(F.min("minutes"), 1).alias("m"))
    back = c.transit_routes(start, c.services, 30, "2026-08-20T10:00")
    both = found.join(back, ["origin", "service"], "full")
    return both.agg(F.count_if(~F.coalesce(F.abs(F.col("m") - F.col("minutes")) < 0.11, F.lit(False))).alias("differ"), (F.count_if(F.col("vehicles") > 0) > 0).alias("some"))


@query("SELECT o AS origin, category, count(*) FILTER (r <= 3) AS detailed, count(*) AS n FROM (SELECT s_nationkey AS o, 'cat' || s_suppkey % 8 AS category, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 8 ORDER BY s_suppkey * 37 % 60, s_suppkey) AS r FROM supplier) GROUP BY 1, 2")
def detail_of_the_nearest(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("origin"), F.concat(F.lit("cat"), k % 8).alias("category"), k.alias("service"), (k * 37 % 60).alias("minutes"))
    journeys = rows.select("origin", "service", F.array(F.lit("walk")).alias("steps"))
    return transit.with_detail(rows, journeys, most=3).groupBy("origin", "category").agg(F.count("steps").alias("detailed"), F.count("*").alias("n"))


#: The prepared city of each application.
_PREPARED: dict = {}


@query()
def standing_question_of_a_city(spark, sf_dir):
    """A standing question over all areas and three modes of a prepared city of the published size; its rows are fixed."""
    name = spark.sparkContext.applicationId
    if name not in _PREPARED:
        _PREPARED[name] = fixtures.large_city(spark).prepared(caches.shared_folder(spark, "city"))
    return _PREPARED[name].ask("mode_gain", minutes=15, limit=100, departure="2026-08-20T08:00")


@query("SELECT 0::BIGINT AS differ, 8 * count(*) AS n FROM nation")
def prepared_town_agrees(spark, sf_dir):
    """Profiles of a prepared city equal those of the city itself."""
    c = town.town(spark, sf_dir)
    p = c.prepared(caches.shared_folder(spark, "town"))
    one, two = (x.profile(x.area_points(), "bike", 10).select("origin", "category", "n", "nearest_minutes") for x in (c, p))
    return one.exceptAll(two).agg(F.count("*").alias("differ")).crossJoin(two.agg(F.count("*").alias("n")))
