"""The queries of the graph engine over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..city import vehicle
from ..functions import exprs as X
from ..graph import nation_years, table, trade_graph
from ..operators import questions, routing, spatial, transit
from ..quality import service_report
from ..sources import fixtures
from ..streaming import events as streams
from .compile import ANALYSES, compile_query

_REGISTER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        _REGISTER[name or fn.__name__] = (fn, sql)
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: fn for k, (fn, _) in _REGISTER.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _REGISTER.items() if sql}


def flat(df: DataFrame) -> DataFrame:
    """Column names without dots; lists as text."""
    out = df.withColumnsRenamed({c: c.replace(".", "_") for c in df.columns})
    return out.select(*(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in out.dtypes))


def spec(name: str, raw: dict, sql: str) -> None:
    _REGISTER[name] = (lambda spark, sf_dir: flat(compile_query(trade_graph(spark, sf_dir), raw)), sql)


# Scans, filters, projection

spec("scan_type", {"start": {"type": "Nation"}, "return": ["id", "name", "region"]}, "SELECT 'nation:' || n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
spec("lookup_ids", {"start": {"type": "Nation", "ids": ["nation:3", "nation:1", "nation:99"]}, "return": ["id", "name"]}, "SELECT 'nation:' || n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey IN (1, 3)")
_customer = "SELECT 'customer:' || c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE "
for _op, _field, _value, _sql in [
    ("eq", "segment", "BUILDING", "c_mktsegment = 'BUILDING'"),
    ("ne", "segment", "BUILDING", "c_mktsegment <> 'BUILDING'"),
    ("gt", "balance", 9000, "c_acctbal > 9000"),
    ("gte", "key", 700, "c_custkey >= 700"),
    ("lt", "balance", "0", "c_acctbal < 0"),
    ("lte", "key", 30, "c_custkey <= 30"),
    ("in", "segment", ["BUILDING", "MACHINERY", 7], "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("not_in", "nation", [1, 2, 3], "c_nationkey NOT IN (1, 2, 3)"),
    ("contains", "segment", "iLd", "lower(c_mktsegment) LIKE '%ild%'"),
    ("exists", "balance", None, "c_acctbal IS NOT NULL"),
    ("between", "balance", [100, 300], "c_acctbal BETWEEN 100 AND 300"),
]:
    spec(f"filter_{_op}", {"start": {"type": "Customer", "filters": [{"field": _field, "op": _op, "value": _value}]}, "return": ["id", "balance", "segment"], "rank": {"by": "key", "order": "asc"}, "limit": 1000}, f"{_customer}{_sql} ORDER BY c_custkey LIMIT 1000")


@query("SELECT count(*) FILTER (x <> 'BUILDING') AS ne, count(*) FILTER (x NOT IN ('MACHINERY')) AS not_in, count(*) FILTER (x IS NOT NULL) AS exists_, count(*) FILTER (b > 0) AS gt FROM (SELECT nullif(c_mktsegment, 'HOUSEHOLD') AS x, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS b FROM customer)")
def filter_null_semantics(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("x"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("b"))
    of = lambda f, kind, op, v=None: F.count_if(X.predicate(F.col(f), kind, op, v))
    return c.agg(of("x", "string", "ne", "BUILDING").alias("ne"), of("x", "string", "not_in", ["MACHINERY"]).alias("not_in"), of("x", "string", "exists").alias("exists_"), of("b", "double", "gt", 0).alias("gt"))


@query("SELECT 'part:' || p_partkey AS id, p_name AS name FROM part ORDER BY p_partkey LIMIT 20 OFFSET 40")
def page_offset(spark, sf_dir):
    return trade_graph(spark, sf_dir).page("Part", 20, 40).select("id", "name")


# Traversals

spec("traverse_one_hop_count", {"start": {"type": "Nation"}, "traverse": [{"relation": "HAS_SUPPLIER", "as": "s"}], "return": ["name", "s.count"], "rank": {"by": "s.count"}}, "SELECT n_name AS name, count(s_suppkey) AS s_count FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
spec("traverse_filtered_count", {"start": {"type": "Nation"}, "traverse": [{"relation": "HAS_CUSTOMER", "as": "c", "filters": [{"field": "balance", "op": "gt", "value": 5000}]}], "return": ["name", "c.count"]}, "SELECT n_name AS name, count(c_custkey) AS c_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 5000 GROUP BY n_nationkey, n_name")
spec("traverse_chained_distinct", {"start": {"type": "Nation"}, "traverse": [{"relation": "HAS_SUPPLIER", "as": "s"}, {"relation": "SUPPLIES", "as": "p", "from": "s"}], "return": ["name", "s.count", "p.count"]}, "SELECT n_name AS name, count(DISTINCT s_suppkey) AS s_count, count(DISTINCT l_partkey) AS p_count FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY n_nationkey, n_name")
spec("traverse_min_count_semi", {"start": {"type": "Nation"}, "traverse": [{"relation": "HAS_SUPPLIER", "min_count": 1, "filters": [{"field": "balance", "op": "gt", "value": 8000}]}], "return": ["name"]}, "SELECT n_name AS name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 8000)")
spec("traverse_max_zero_anti", {"start": {"type": "Nation"}, "traverse": [{"relation": "HAS_SUPPLIER", "max_count": 0, "filters": [{"field": "balance", "op": "gt", "value": 8000}]}], "return": ["name"]}, "SELECT n_name AS name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 8000)")
spec("traverse_count_range", {"start": {"type": "Nation"}, "traverse": [{"relation": "HAS_SUPPLIER", "as": "s", "min_count": 2, "max_count": 5}], "return": ["name", "s.count"]}, "SELECT n_name AS name, count(*) AS s_count FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name HAVING count(*) BETWEEN 2 AND 5")
spec("traverse_pluck_list", {"start": {"type": "Nation"}, "traverse": [{"relation": "HAS_SUPPLIER", "as": "s"}], "return": ["name", "s.name"]}, "SELECT n_name AS name, coalesce(string_agg(s_name, ',' ORDER BY s_suppkey), '') AS s_name FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
spec("default_projection", {"start": {"type": "Region"}, "traverse": [{"relation": "HAS_NATION"}]}, "SELECT 'region:' || r_regionkey AS id, r_regionkey AS key, r_name AS name, count(n_nationkey) AS Nation_count FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
spec("traverse_two_hops_list", {"start": {"type": "Region"}, "traverse": [{"relation": "HAS_NATION", "as": "n"}, {"relation": "HAS_SUPPLIER", "as": "s", "from": "n", "filters": [{"field": "category", "op": "eq", "value": "cat3"}]}], "return": ["name", "s.count"]}, "SELECT r_name AS name, count(DISTINCT s_suppkey) AS s_count FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey % 8 = 3 GROUP BY r_regionkey, r_name")

# Groups

spec("group_sum_by_year", {"start": {"type": "NationYear"}, "group_by": ["year"], "aggregates": [{"function": "sum", "field": "urgent", "as": "urgent"}, {"function": "count", "as": "n"}], "order_by": [{"field": "year"}]}, "SELECT year(o_orderdate) AS year, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(DISTINCT c_nationkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
spec("group_multi_key", {"start": {"type": "Customer"}, "group_by": ["segment", "nation"], "aggregates": [{"function": "count", "as": "n"}], "limit": 1000}, "SELECT c_mktsegment AS segment, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1, 2")
spec("group_count_distinct", {"start": {"type": "Customer"}, "group_by": ["segment"], "aggregates": [{"function": "count_distinct", "field": "nation", "as": "nations"}, {"function": "count", "field": "balance", "as": "n"}]}, "SELECT c_mktsegment AS segment, count(DISTINCT c_nationkey) AS nations, count(c_acctbal) AS n FROM customer GROUP BY 1")
spec("group_avg_min_max", {"start": {"type": "NationYear"}, "group_by": ["year"], "aggregates": [{"function": "avg", "field": "total", "as": "mean"}, {"function": "min", "field": "total", "as": "low"}, {"function": "max", "field": "total", "as": "high"}]}, "SELECT year, avg(t) AS mean, min(t) AS low, max(t) AS high FROM (SELECT year(o_orderdate) AS year, count(*) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, c_nationkey) GROUP BY 1")
spec("group_having_order_limit", {"start": {"type": "Customer"}, "group_by": ["nation"], "aggregates": [{"function": "count", "as": "n"}, {"function": "max", "field": "balance", "as": "high"}], "having": [{"field": "n", "op": "gte", "value": 55}], "order_by": [{"field": "n", "order": "desc"}, {"field": "nation"}], "limit": 5}, "SELECT c_nationkey AS nation, count(*) AS n, max(c_acctbal) AS high FROM customer GROUP BY 1 HAVING count(*) >= 55 ORDER BY n DESC, nation LIMIT 5")
_after = {"start": {"type": "Nation"}, "traverse": [{"relation": "PART_OF", "as": "r"}, {"relation": "HAS_SUPPLIER", "as": "s"}], "group_by": ["r.name"], "aggregates": [{"function": "count", "as": "nations"}, {"function": "count", "field": "s.id", "as": "suppliers"}, {"function": "max", "field": "s.balance", "as": "best"}], "having": [{"field": "suppliers", "op": "gt", "value": 0}], "order_by": [{"field": "suppliers", "order": "desc"}], "limit": 10}
spec("group_after_traversal", _after, "SELECT r_name AS r_name, count(DISTINCT n_nationkey) AS nations, count(s_suppkey) AS suppliers, max(s_acctbal) AS best FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name HAVING count(s_suppkey) > 0")
spec("group_list_key_explode", {"start": {"type": "Nation"}, "traverse": [{"relation": "HAS_SUPPLIER", "as": "s"}], "group_by": ["s.category"], "aggregates": [{"function": "count", "as": "memberships"}, {"function": "count_distinct", "field": "id", "as": "nations"}, {"function": "count", "field": "s.id", "as": "inflated"}]}, "WITH m AS (SELECT s_nationkey, 'cat' || s_suppkey % 8 AS c, count(*) OVER (PARTITION BY s_nationkey) AS k FROM supplier) SELECT c AS s_category, count(*) AS memberships, count(DISTINCT s_nationkey) AS nations, sum(k)::BIGINT AS inflated FROM m GROUP BY 1")
spec("group_null_only_is_null", {"start": {"type": "Supplier", "filters": [{"field": "key", "op": "lt", "value": 40}]}, "traverse": [{"relation": "SUPPLIES", "as": "p", "filters": [{"field": "size", "op": "gt", "value": 10000}]}], "group_by": ["nation"], "aggregates": [{"function": "sum", "field": "p.price", "as": "price"}, {"function": "count", "field": "p.id", "as": "n"}]}, "SELECT s_nationkey AS nation, NULL::DOUBLE AS price, 0::BIGINT AS n FROM supplier WHERE s_suppkey < 40 GROUP BY 1")
spec("legacy_row_aggregate_rank", {"start": {"type": "Nation"}, "traverse": [{"relation": "HAS_SUPPLIER", "as": "s"}], "aggregates": [{"function": "max", "field": "s.balance", "as": "best"}, {"function": "count", "field": "s.balance", "as": "n"}], "rank": {"by": "best"}, "return": ["name", "best", "n"], "limit": 7}, "SELECT n_name AS name, max(s_acctbal) AS best, count(s_acctbal)::INT AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name ORDER BY best DESC NULLS FIRST, n_nationkey LIMIT 7")
spec("rank_missing_placement", {"start": {"type": "Nation"}, "traverse": [{"relation": "HAS_SUPPLIER", "as": "s", "filters": [{"field": "balance", "op": "gt", "value": 9000}]}], "aggregates": [{"function": "min", "field": "s.balance", "as": "low"}], "rank": {"by": "low", "order": "asc"}, "return": ["name", "low"], "limit": 12}, "SELECT n_name AS name, min(s_acctbal) AS low FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY n_nationkey, n_name ORDER BY low ASC NULLS LAST, n_nationkey LIMIT 12")
spec("query_with_analysis", {"start": {"type": "Nation"}, "analyses": [{"as": "walk", "analysis": "accessibility", "mode": "walk", "minutes": 20, "target_category": "cat3", "operator": "count_gte", "value": 1}], "return": ["name", "walk.count", "walk.nearest_m"], "rank": {"by": "walk.count"}}, "")


# Graph retrieval


@query("SELECT relation, count(*) AS n FROM (SELECT 'PART_OF' AS relation FROM nation WHERE n_nationkey = 4 UNION ALL SELECT 'ADJACENT_TO' FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey = 4 AND b.n_nationkey <> 4 UNION ALL SELECT 'HAS_SUPPLIER' FROM supplier WHERE s_nationkey = 4 UNION ALL SELECT 'HAS_CUSTOMER' FROM customer WHERE c_nationkey = 4 UNION ALL SELECT DISTINCT 'HAS_OBSERVATION' || '' FROM (SELECT 1 WHERE FALSE) UNION ALL SELECT 'HAS_OBSERVATION' FROM (SELECT DISTINCT year(o_orderdate) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 4)) GROUP BY 1")
def neighbors_by_relation(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    return g.neighbors(spark.createDataFrame([("nation:4",)], "id string")).groupBy("relation").agg(F.count("*").alias("n"))


_bfs = "WITH RECURSIVE e AS ({edges}), b(id, step) AS (SELECT 'nation:4', 0 UNION SELECT e.dst, b.step + 1 FROM b JOIN e ON e.src = b.id WHERE b.step < 2) SELECT id, min(step)::INT AS step FROM b GROUP BY id"
_ns = "SELECT 'nation:' || s_nationkey AS src, 'supplier:' || s_suppkey AS dst FROM supplier"
_adj = "SELECT 'nation:' || a.n_nationkey AS src, 'nation:' || b.n_nationkey AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey"


@query(_bfs.format(edges=f"{_ns} UNION {_adj}"))
def subgraph_bfs_depth2(spark, sf_dir):
    return trade_graph(spark, sf_dir).subgraph("nation:4", 2, ["HAS_SUPPLIER", "ADJACENT_TO"])


@query(_bfs.format(edges="SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation UNION SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey FROM nation"))
def subgraph_undirected(spark, sf_dir):
    return trade_graph(spark, sf_dir).subgraph("nation:4", 2, ["PART_OF"], directed=False)


@query("SELECT 'Region' AS type, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'NationYear', count(*) FROM (SELECT DISTINCT c_nationkey, year(o_orderdate) FROM orders JOIN customer ON o_custkey = c_custkey) UNION ALL SELECT 'Segment', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders")
def node_counts(spark, sf_dir):
    return trade_graph(spark, sf_dir).node_counts()


@query("SELECT 'SUPPLIES' AS relation, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'LOCATED_IN', (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer)")
def edge_counts(spark, sf_dir):
    return trade_graph(spark, sf_dir).edge_counts().where(F.col("relation").isin("SUPPLIES", "PLACED", "LOCATED_IN"))


# Building: denormalisation, adjacency, containment, snapping

_years = "SELECT c_nationkey AS k, year(o_orderdate) AS y, count(*) AS total, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high, count(*) FILTER (o_orderpriority = '3-MEDIUM') AS medium, count(*) FILTER (o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')) AS low, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"


@query(f"SELECT n_name AS name, max(y) AS latest_year, arg_max(total, y) AS orders_total, round(arg_max(urgent, y)::DOUBLE / arg_max(total, y), 4) AS urgent_share FROM nation JOIN ({_years}) ON k = n_nationkey GROUP BY n_nationkey, n_name")
def denorm_latest_year(spark, sf_dir):
    return trade_graph(spark, sf_dir).nodes("Nation").select("name", "latest_year", "orders_total", "urgent_share")


@query(f"SELECT k::INT AS nation_key, y AS year, total, urgent, high, medium, low, value FROM ({_years})")
def age_bucket_rollup(spark, sf_dir):
    return nation_years(spark, sf_dir)


@query(f"SELECT a.src, a.dst FROM ({_adj}) a")
def adjacency_pairs(spark, sf_dir):
    return trade_graph(spark, sf_dir).edges("ADJACENT_TO")


_point = "SELECT s_suppkey AS id, (s_suppkey * 137 % 2700)::DOUBLE AS x, (s_suppkey * 251 % 1800)::DOUBLE AS y FROM supplier"


def _points(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (k * 137 % 2700).cast("double").alias("x"), (k * 251 % 1800).cast("double").alias("y"))


@query(f"SELECT id AS point, CASE WHEN x > -10 AND x < 1100 THEN 'west' ELSE 'east' END AS area FROM ({_point}) WHERE (x < 1100 OR x > 1100)")
def pip_containment(spark, sf_dir):
    return spatial.contained(_points(spark, sf_dir).withColumnRenamed("id", "point"), fixtures.areas(spark), 500.0)


@query(f"SELECT id FROM ({_point}) WHERE x BETWEEN 300 AND 900 AND y BETWEEN 100 AND 1500")
def bbox_filter(spark, sf_dir):
    return spatial.in_box(_points(spark, sf_dir), 300, 100, 900, 1500).select("id")


_hav = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"WITH s AS (SELECT s_suppkey AS id, 7.5 + (s_suppkey * 37 % 100) / 1000.0 AS lon, 47.5 + (s_suppkey * 53 % 100) / 1000.0 AS lat FROM supplier), c AS (SELECT c_custkey AS id, 7.5 + (c_custkey * 31 % 100) / 1000.0 AS lon, 47.5 + (c_custkey * 71 % 100) / 1000.0 AS lat FROM customer) SELECT a.id AS a, b.id AS b, round({_hav}, 3) AS distance FROM s a, c b WHERE {_hav} <= 250")
def range_join_haversine(spark, sf_dir):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    left = table(spark, sf_dir, "supplier").select(s.alias("id"), (7.5 + (s * 37 % 100) / 1000.0).alias("lon"), (47.5 + (s * 53 % 100) / 1000.0).alias("lat"))
    right = table(spark, sf_dir, "customer").select(c.alias("id"), (7.5 + (c * 31 % 100) / 1000.0).alias("lon"), (47.5 + (c * 71 % 100) / 1000.0).alias("lat"))
    return spatial.within_haversine(left, right, 250).withColumn("distance", F.round("distance", 3))


@query(f"WITH p AS ({_point}), g AS (SELECT r AS node, (r % 7) * 450.0 AS x, (r // 7) * 450.0 AS y FROM range(35) t(r)), d AS (SELECT p.id, g.node, sqrt((p.x - g.x)^2 + (p.y - g.y)^2) AS d FROM p, g) SELECT id, arg_min(node, (d, node)) AS node, round(min(d), 6) AS distance, CASE WHEN min(d) <= 150 THEN 'good' ELSE 'poor' END AS quality FROM d WHERE d <= 500 GROUP BY id UNION ALL SELECT id, NULL, NULL, 'unreachable' FROM d GROUP BY id HAVING min(d) > 500")
def knn_snap_grade(spark, sf_dir):
    return spatial.snapped(_points(spark, sf_dir), fixtures.grid_nodes(spark)).withColumn("distance", F.round("distance", 6))


@query(f"WITH p AS (SELECT *, id % 3 AS category, CASE WHEN id % 5 = 0 THEN NULL ELSE id % 2 END AS key FROM ({_point})) SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x)^2 + (a.y - b.y)^2), 6) AS distance FROM p a JOIN p b ON a.id < b.id AND a.category = b.category AND (a.key IS NULL OR b.key IS NULL OR a.key = b.key) WHERE sqrt((a.x - b.x)^2 + (a.y - b.y)^2) <= 300")
def duplicate_pairs(spark, sf_dir):
    rows = _points(spark, sf_dir).withColumn("category", F.col("id") % 3).withColumn("key", F.when(F.col("id") % 5 != 0, F.col("id") % 2))
    return spatial.duplicate_pairs(rows, 300.0).withColumn("distance", F.round("distance", 6))


@query("SELECT * FROM (VALUES ('west', 2231100.0), ('east', 3417000.0)) t(area, m2)")
def polygon_area(spark, sf_dir):
    return fixtures.areas(spark).select("area", X.ring_area(F.col("ring")).alias("m2"))


@query("SELECT * FROM (VALUES ('west', 'east', 2010.0), ('east', 'west', 2010.0)) t(src, dst, shared)")
def polygon_adjacency(spark, sf_dir):
    return spatial.adjacent(fixtures.areas(spark))


# Routing

_grid = "g AS (SELECT r AS id, r % 7 AS i, r // 7 AS j FROM range(35) t(r)), half AS (SELECT 'walk' AS m, id AS u, id + 1 AS v FROM g WHERE i < 6 AND (i <> 2 OR j IN (1, 4)) UNION ALL SELECT 'bike', id, id + 1 FROM g WHERE i < 6 UNION ALL SELECT m, id, id + 7 FROM g, (VALUES ('walk'), ('bike')) t(m) WHERE j < 4), e AS (SELECT m, u, v, 450.0::DOUBLE AS w FROM half UNION ALL SELECT m, v, u, 450.0 FROM half)"
_sp = f"{_grid}, sp(m, o, node, d) USING KEY (m, o, node) AS (SELECT m, o, node, d::DOUBLE FROM seeds UNION SELECT m, o, node, min(d) FROM (SELECT sp.m, sp.o, e.v AS node, sp.d + e.w AS d FROM sp JOIN e ON e.u = sp.node AND e.m = sp.m LEFT JOIN recurring.sp AS r ON r.m = sp.m AND r.o = sp.o AND r.node = e.v WHERE r.d IS NULL OR sp.d + e.w < r.d) GROUP BY m, o, node)"
_nations = "seeds AS (SELECT m, n_nationkey AS o, (n_nationkey % 35)::BIGINT AS node, 0.0 AS d FROM nation, (VALUES ('walk'), ('bike')) t(m))"


def _origins(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("origin"), (F.col("n_nationkey") % 35).cast("long").alias("node"), F.lit(0.0).alias("cost"))


def _services(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("service"), F.concat(F.lit("cat"), (k % 8).cast("string")).alias("category"), (k % 35).alias("node"), (k * 37 % 600).cast("double").alias("distance_m")).where("distance_m <= 500")


_serv = "sv AS (SELECT s_suppkey AS service, 'cat' || s_suppkey % 8 AS category, s_suppkey % 35 AS node, (s_suppkey * 37 % 600)::DOUBLE AS dist FROM supplier WHERE s_suppkey * 37 % 600 <= 500)"


def _network(spark, mode):
    return routing.symmetric(fixtures.grid_edges(spark, mode))


@query(f"WITH RECURSIVE {_nations}, {_sp} SELECT o AS origin, node, d AS cost FROM sp WHERE m = 'walk' AND d <= 1600")
def sssp_budget(spark, sf_dir):
    return routing.shortest_paths(_origins(spark, sf_dir), _network(spark, "walk"), 1600.0).select("origin", "node", "cost")


@query(f"WITH RECURSIVE seeds AS (SELECT 'walk' AS m, 0 AS o, node, min(dist) AS d FROM (SELECT s_suppkey % 35 AS node, (s_suppkey * 37 % 600)::DOUBLE AS dist FROM supplier WHERE s_suppkey % 8 = 1 AND s_suppkey * 37 % 600 <= 500) GROUP BY node), {_sp} SELECT node, d AS cost FROM sp")
def multi_source_nearest(spark, sf_dir):
    return routing.nearest_facility(_services(spark, sf_dir).where("category = 'cat1'"), _network(spark, "walk"))


_reached = f"{_serv}, re AS (SELECT sp.m, sp.o, sv.service, sv.category, sp.d + sv.dist AS d FROM sp JOIN sv ON sv.node = sp.node WHERE sp.d + sv.dist <= CASE sp.m WHEN 'walk' THEN 1200.0 ELSE 3750.0 END)"
_profile = f"{_reached}, pf AS (SELECT x.m, x.o, c.category, count(re.service) AS n, min(re.d) AS nearest_m, arg_min(re.service, (re.d, re.service)) AS nearest FROM (SELECT DISTINCT m, o FROM seeds) x CROSS JOIN (SELECT 'cat' || r AS category FROM range(8) t(r)) c LEFT JOIN re ON re.m = x.m AND re.o = x.o AND re.category = c.category GROUP BY x.m, x.o, c.category)"
_with_profile = f"WITH RECURSIVE {_nations}, {_sp}, {_profile} "


def _categories(spark):
    return spark.range(8).select(F.concat(F.lit("cat"), F.col("id").cast("string")).alias("category"))


def _walk_profile(spark, sf_dir):
    o = _origins(spark, sf_dir)
    costs = routing.shortest_paths(o, _network(spark, "walk"), 1200.0)
    return routing.category_profile(o, routing.reachable_services(costs, _services(spark, sf_dir), 1200.0), _categories(spark))


def _profiles(spark, sf_dir):
    areas = _origins(spark, sf_dir).select(F.col("origin").alias("area"), "node")
    return questions.profiles(areas, {m: fixtures.grid_edges(spark, m) for m in ("walk", "bike")}, _services(spark, sf_dir), 15, _categories(spark))


@query(_with_profile + "SELECT o AS origin, category, n, nearest_m, nearest FROM pf WHERE m = 'walk'")
def reachable_services_profile(spark, sf_dir):
    return _walk_profile(spark, sf_dir)


@query(_with_profile + "SELECT o AS origin, count(*) FILTER (n > 0) AS present, round(count(*) FILTER (n > 0) / 6.0, 3)::DOUBLE AS ratio, coalesce(string_agg(category, ',' ORDER BY category) FILTER (n = 0), '') AS missing FROM pf WHERE m = 'walk' AND category < 'cat6' GROUP BY o")
def completeness(spark, sf_dir):
    return flat(routing.completeness(_walk_profile(spark, sf_dir), [f"cat{i}" for i in range(6)]))


@query(_with_profile + "SELECT o AS origin, service, category, d AS distance_m, r::INT AS rank, k > 2 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY o, category ORDER BY d, service) AS r, count(*) OVER (PARTITION BY o, category) AS k FROM re WHERE m = 'bike') WHERE r <= 2")
def topn_per_category(spark, sf_dir):
    costs = routing.shortest_paths(_origins(spark, sf_dir), _network(spark, "bike"), 3750.0)
    return routing.top_services(routing.reachable_services(costs, _services(spark, sf_dir), 3750.0), 2).select("origin", "service", "category", "distance_m", "rank", "truncated")


@query(f"WITH RECURSIVE {_nations}, {_sp} SELECT a.o AS origin, h.u, h.v, 450.0::DOUBLE AS length_m FROM half h JOIN sp a ON a.m = h.m AND a.node = h.u JOIN sp b ON b.m = h.m AND b.node = h.v AND b.o = a.o WHERE h.m = 'walk' AND a.d <= 900 AND b.d <= 900")
def reachable_edges(spark, sf_dir):
    edges = fixtures.grid_edges(spark, "walk")
    return routing.reachable_edges(routing.shortest_paths(_origins(spark, sf_dir), routing.symmetric(edges), 900.0), edges)


@query(f"WITH RECURSIVE seeds AS (SELECT m, 0 AS o, 2::BIGINT AS node, 0.0 AS d FROM (VALUES ('walk'), ('bike')) t(m)), {_sp} SELECT m AS mode, d AS cost FROM sp WHERE node = 3")
def one_to_one_route_cost(spark, sf_dir):
    seed = spark.createDataFrame([(0, 2, 0.0)], "origin int, node long, cost double")
    parts = [routing.shortest_paths(seed, _network(spark, m)).where("node = 3").select(F.lit(m).alias("mode"), "cost") for m in ("walk", "bike")]
    return parts[0].unionByName(parts[1])


@query(f"WITH RECURSIVE seeds AS (SELECT m, 0 AS o, 2::BIGINT AS node, 0.0 AS d FROM (VALUES ('walk')) t(m)), {_sp} SELECT node, round(d / (sqrt(((node % 7) - 2)^2 + (node // 7)^2) * 450.0), 2) AS detour FROM sp WHERE node <> 2")
def detour_factor(spark, sf_dir):
    seed = spark.createDataFrame([(0, 2, 0.0)], "origin int, node long, cost double")
    reached = routing.shortest_paths(seed, _network(spark, "walk")).where("node <> 2").select("origin", F.col("node").alias("service"), F.col("cost").alias("distance_m"))
    straight = fixtures.grid_nodes(spark).select(F.lit(0).alias("origin"), F.col("node").alias("service"), F.hypot(F.col("x") - 900.0, F.col("y")).alias("straight_m"))
    return routing.detours(reached, straight).select(F.col("service").alias("node"), "detour")


@query(f"WITH RECURSIVE seeds AS (SELECT 'walk' AS m, 0 AS o, node, min(dist) AS d FROM (SELECT s_suppkey % 35 AS node, (s_suppkey * 37 % 600)::DOUBLE AS dist FROM supplier WHERE s_suppkey % 8 = 1 AND s_suppkey * 37 % 600 <= 500) GROUP BY node), {_sp} SELECT CASE WHEN (node % 7) * 450.0 < 1100 THEN 'west' ELSE 'east' END AS area, count(*) AS nodes, count(*) FILTER (d <= 800) AS covered, round(count(*) FILTER (d <= 800)::DOUBLE / count(*), 4) AS ratio, median(d) AS median_m, max(d) AS max_m, 0::BIGINT AS unreachable FROM sp GROUP BY 1")
def gap_coverage_by_area(spark, sf_dir):
    found = routing.nearest_facility(_services(spark, sf_dir).where("category = 'cat1'"), _network(spark, "walk"))
    inside = spatial.contained(fixtures.grid_nodes(spark).withColumnRenamed("node", "point"), fixtures.areas(spark), 500.0).withColumnRenamed("point", "node")
    return routing.coverage(inside, found, 800.0)


@query("SELECT r AS node, CASE WHEN r % 7 < 3 THEN 0 ELSE 3 END::BIGINT AS component, CASE WHEN r % 7 < 3 THEN 15 ELSE 20 END::BIGINT AS size FROM range(35) t(r)")
def components(spark, sf_dir):
    cut = fixtures.grid_edges(spark, "walk").where("not (u % 7 = 2 and v = u + 1)")
    return routing.components(fixtures.grid_nodes(spark).select("node"), cut)


@query("SELECT least(l_suppkey, l_partkey) AS u, greatest(l_suppkey, l_partkey) AS v, min(l_quantity) AS length_m FROM lineitem WHERE l_suppkey <> l_partkey AND l_quantity > 0 GROUP BY 1, 2")
def parallel_edge_min(spark, sf_dir):
    return routing.shortest_parallel(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"), F.col("l_quantity").alias("length_m")))


def _accessibility(graph, origins, params):
    """Services of a category that each nation reaches on the grid in the minutes given: all origins in one search."""
    mode, minutes = params["mode"], params.get("minutes", 15)
    seeds = origins.select(F.col("id").alias("origin"), (F.split("id", ":")[1].cast("long") % 35).alias("node"), F.lit(0.0).alias("cost"))
    budget = routing.budget_m(minutes, routing.SPEED_KMH[mode])
    k = F.col("key")
    services = graph.nodes("Supplier").select(k.alias("service"), "category", (k % 35).alias("node"), (k * 37 % 600).cast("double").alias("distance_m")).where("distance_m <= 500")
    if params.get("category"):
        services = services.where(F.col("category") == params["category"])
    costs = routing.shortest_paths(seeds, routing.symmetric(fixtures.grid_edges(graph.spark, mode)), budget)
    found = routing.reachable_services(costs, services, budget).groupBy(F.col("origin").alias("id")).agg(F.count("*").alias("count"), F.min("distance_m").alias("nearest_m"))
    return origins.join(found, "id", "left").select("id", F.coalesce("count", F.lit(0)).alias("count"), "nearest_m", F.lit(float(minutes)).alias("minutes"))


ANALYSES["accessibility"] = _accessibility
_REGISTER["query_with_analysis"] = (_REGISTER["query_with_analysis"][0], f"WITH RECURSIVE {_nations}, {_sp}, {_serv} SELECT n_name AS name, count(*) AS walk_count, min(sp.d + sv.dist) AS walk_nearest_m FROM nation JOIN sp ON sp.o = n_nationkey AND sp.m = 'walk' JOIN sv ON sv.node = sp.node AND sv.category = 'cat3' WHERE sp.d + sv.dist <= 1600 GROUP BY n_nationkey, n_name")

# Standing questions


@query(_with_profile + "SELECT o AS area, n, nearest_m FROM pf WHERE m = 'walk' AND category = 'cat2' ORDER BY n, nearest_m DESC NULLS FIRST, o LIMIT 10")
def poorest_access(spark, sf_dir):
    return questions.poorest_access(_profiles(spark, sf_dir), "cat2", "walk")


_two = "w AS (SELECT o, sum(n) FILTER (category = 'cat1') AS good, sum(n) FILTER (category = 'cat2') AS poor FROM pf WHERE m = 'bike' GROUP BY o)"


@query(_with_profile.rstrip() + f", {_two} SELECT o AS area, good::BIGINT AS good, poor::BIGINT AS poor, (good - poor)::BIGINT AS gap FROM w WHERE good >= (SELECT median(good) FROM w) AND poor <= (SELECT median(poor) FROM w)")
def median_threshold_gap(spark, sf_dir):
    return questions.median_gap(_profiles(spark, sf_dir), "cat1", "cat2", "bike")


_essential = [f"cat{i}" for i in range(6)]


@query(_with_profile.rstrip() + ", d AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst, x.category, x.n AS an, y.n AS bn FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN pf x ON x.o = a.n_nationkey AND x.m = 'walk' AND x.category < 'cat6' JOIN pf y ON y.o = b.n_nationkey AND y.m = 'walk' AND y.category = x.category) SELECT src, dst, sum(an)::BIGINT AS a_total, sum(bn)::BIGINT AS b_total, abs(sum(an) - sum(bn))::BIGINT AS difference, round(greatest(sum(an), sum(bn))::DOUBLE / nullif(least(sum(an), sum(bn)), 0), 2) AS ratio, arg_min(category, (-abs(an - bn), category)) AS widest, max(abs(an - bn))::BIGINT AS widest_gap FROM d GROUP BY src, dst")
def adjacent_contrast(spark, sf_dir):
    pairs = trade_graph(spark, sf_dir).edges("ADJACENT_TO").select(*(F.split(c, ":")[1].cast("int").alias(c) for c in ("src", "dst")))
    return questions.adjacent_contrasts(_profiles(spark, sf_dir), pairs, "walk", _essential).drop("by_category")


@query(_with_profile + "SELECT a.n_nationkey AS src, b.n_nationkey AS dst, string_agg(x.category || ':' || (x.n - y.n), ',' ORDER BY x.category) AS by_category FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN pf x ON x.o = a.n_nationkey AND x.m = 'bike' AND x.category < 'cat6' JOIN pf y ON y.o = b.n_nationkey AND y.m = 'bike' AND y.category = x.category GROUP BY 1, 2")
def adjacent_contrast_signed(spark, sf_dir):
    pairs = trade_graph(spark, sf_dir).edges("ADJACENT_TO").select(*(F.split(c, ":")[1].cast("int").alias(c) for c in ("src", "dst")))
    found = questions.adjacent_contrasts(_profiles(spark, sf_dir), pairs, "bike", _essential)
    return found.select("src", "dst", F.array_join(F.transform("by_category", lambda x: F.concat_ws(":", x["category"], x["difference"])), ",").alias("by_category"))


@query(_with_profile + "SELECT category, round(avg(n), 1) AS mean, round(stddev_pop(n), 1) AS stdev, round(stddev_pop(n) / nullif(avg(n), 0), 3) AS cv, min(n) AS low, max(n) AS high, count(*) FILTER (n = 0) AS zeros, arg_min(o, (n, o)) AS worst, arg_min(o, (-n, -o)) AS best FROM pf WHERE m = 'bike' AND category < 'cat6' GROUP BY category")
def category_cv(spark, sf_dir):
    return questions.category_inequality(_profiles(spark, sf_dir), "bike", _essential)


@query(_with_profile + "SELECT o AS area, 'bike' AS mode, sum(n) FILTER (m = 'walk')::BIGINT AS base_total, sum(n) FILTER (m = 'bike')::BIGINT AS other_total, (sum(n) FILTER (m = 'bike') - sum(n) FILTER (m = 'walk'))::BIGINT AS gain, round((sum(n) FILTER (m = 'bike'))::DOUBLE / nullif(sum(n) FILTER (m = 'walk'), 0), 2) AS multiplier, count(*) FILTER (m = 'bike' AND n > 0) - count(*) FILTER (m = 'walk' AND n > 0) AS completeness_gain, true AS best FROM pf WHERE category < 'cat6' GROUP BY o")
def mode_gain(spark, sf_dir):
    return questions.mode_gain(_profiles(spark, sf_dir), "walk", ["bike"], _essential)


@query(_with_profile.rstrip() + ", z AS (SELECT k AS o, arg_max(urgent, y) AS people FROM (" + _years + ") GROUP BY k), st AS (SELECT n_nationkey AS o, count(s_suppkey) AS stops FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1), j AS (SELECT z.o, people, (SELECT sum(n) FROM pf WHERE pf.o = z.o AND m = 'bike' AND category = 'cat5') AS reached, stops FROM z JOIN st ON st.o = z.o) SELECT o::INT AS area, people, reached::BIGINT AS reached, stops FROM j WHERE people > (SELECT median(people) FROM j) AND reached < (SELECT median(reached) FROM j) AND stops < (SELECT median(stops) FROM j)")
def children_underserved(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    areas = g.nodes("Nation").select(F.col("key").alias("area"), F.col("urgent").alias("people"))
    stops = g.edges("HAS_SUPPLIER").groupBy(F.split("src", ":")[1].cast("int").alias("area")).agg(F.count("*").alias("stops"))
    return questions.underserved(_profiles(spark, sf_dir), areas.where("people is not null"), "cat5", "bike", stops)


@query(_with_profile + "SELECT category, sum(n) FILTER (m = 'walk')::BIGINT AS walk, sum(n) FILTER (m = 'bike')::BIGINT AS bike FROM pf WHERE o = 7 GROUP BY category")
def compare_pivot(spark, sf_dir):
    return _profiles(spark, sf_dir).where("area = 7").groupBy("category").pivot("mode", ["walk", "bike"]).agg(F.sum("n"))


# Timetables

_late = "(s_suppkey % 30) || ':' || lpad((s_suppkey * 7 % 61)::VARCHAR, 2, '0') || ':' || lpad((s_suppkey * 13 % 60)::VARCHAR, 2, '0')"


@query(f"SELECT s_suppkey AS id, CASE WHEN s_suppkey * 7 % 61 < 60 THEN (s_suppkey % 30) * 3600 + (s_suppkey * 7 % 61) * 60 + s_suppkey * 13 % 60 END::INT AS seconds, CASE WHEN s_suppkey * 7 % 61 < 60 THEN lpad((s_suppkey % 30)::VARCHAR, 2, '0') || substr({_late}, strpos({_late}, ':')) END AS shown FROM supplier")
def gtfs_time_parse(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.concat_ws(":", (k % 30).cast("string"), F.lpad((k * 7 % 61).cast("string"), 2, "0"), F.lpad((k * 13 % 60).cast("string"), 2, "0"))
    seconds = X.parse_service_time(text)
    return table(spark, sf_dir, "supplier").select(k.alias("id"), seconds.alias("seconds"), X.format_service_time(seconds).alias("shown"))


@query("SELECT * FROM (VALUES ('2026-07-01', 'daily'), ('2026-07-01', 'weekend'), ('2026-08-20', 'daily'), ('2026-08-20', 'weekday'), ('2026-08-22', 'daily'), ('2026-08-22', 'weekend')) t(day, service)")
def calendar_active_services(spark, sf_dir):
    t = fixtures.timetable(spark)
    parts = [transit.active_services(t["calendar"], t["exceptions"], d).select(F.lit(str(d)).alias("day"), "service") for d in (date(2026, 7, 1), date(2026, 8, 20), date(2026, 8, 22))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _calls(spark, day: date, before: date):
    t = fixtures.timetable(spark)
    on = lambda d: transit.active_services(t["calendar"], t["exceptions"], d)
    return transit.day_view(t["stop_times"], t["trips"], on(day), on(before)), t["transfers"]


@query("SELECT * FROM (VALUES ('N1', 90300), ('N1<', 3900), ('T1-0', 35100), ('T1-1', 35700), ('T1-2', 36300), ('T1-3', 36900), ('T1-4', 37500), ('T1-5', 38100), ('T2-0', 36720), ('T2-1', 37920)) t(run, first_dep)")
def day_view_after_midnight(spark, sf_dir):
    return _calls(spark, date(2026, 8, 20), date(2026, 8, 19))[0].groupBy("run").agg(F.min("dep").alias("first_dep"))


@query("SELECT * FROM (VALUES ('A', 36000, 0), ('B', 36540, 1), ('C', 36780, 1), ('D', 36960, 2)) t(stop, arrival, vehicles)")
def raptor_one_transfer(spark, sf_dir):
    calls, transfers = _calls(spark, date(2026, 8, 20), date(2026, 8, 19))
    start = spark.createDataFrame([("o", "A", fixtures.clock("10:00"))], "origin string, stop string, ready int")
    return transit.earliest_arrivals(start, calls, transfers, fixtures.clock("12:00"), 3).select("stop", "arrival", "vehicles")


@query("SELECT * FROM (VALUES ('A', '', 0, 0, 0), ('B', 'ride T1-2 A>B', 240, 0, 300), ('C', 'ride T1-2 A>C', 480, 0, 300), ('D', 'ride T1-2 A>B; ride T2-0 B>D', 480, 0, 480)) t(stop, steps, ride_s, walk_s, wait_s)")
def transit_journeys(spark, sf_dir):
    calls, transfers = _calls(spark, date(2026, 8, 20), date(2026, 8, 19))
    start = spark.createDataFrame([("o", "A", fixtures.clock("10:00"))], "origin string, stop string, ready int")
    found = transit.journeys(start, calls, transfers, fixtures.clock("12:00"), 3)
    return found.select("stop", transit.itinerary(F.col("legs")).alias("steps"), "ride_s", "walk_s", "wait_s")


@query("SELECT * FROM (VALUES ('T1-2', 'A', 'B'), ('T1-2', 'A', 'C'), ('T2-0', 'B', 'D')) t(run, src, dst)")
def transit_used_segments(spark, sf_dir):
    calls, transfers = _calls(spark, date(2026, 8, 20), date(2026, 8, 19))
    start = spark.createDataFrame([("o", "A", fixtures.clock("10:00"))], "origin string, stop string, ready int")
    return transit.used_segments(transit.journeys(start, calls, transfers, fixtures.clock("12:00"), 1))


@query("SELECT * FROM (VALUES ('A', 1800), ('C', 4380), ('D', 4710)) t(stop, arrival)")
def raptor_night(spark, sf_dir):
    calls, transfers = _calls(spark, date(2026, 8, 21), date(2026, 8, 20))
    start = spark.createDataFrame([("o", "A", 1800)], "origin string, stop string, ready int")
    return transit.earliest_arrivals(start, calls, transfers, 3600 * 3, 0).select("stop", "arrival")


@query("SELECT * FROM (VALUES ('N1', 'A,C', 1, 90300), ('T1', 'A,B,C', 6, 35100), ('T2', 'B,D', 2, 36720), ('W1', 'A,D', 1, 36300)) t(route, stops, trips, first_dep)")
def pattern_grouping(spark, sf_dir):
    t = fixtures.timetable(spark)
    return flat(transit.patterns(t["stop_times"], t["trips"]))


@query("WITH o AS (SELECT user_id, ts, event_id, event_type FROM events) SELECT a.event_id, a.user_id, b.event_id AS next_event_id, b.ts AS next_ts FROM (SELECT * FROM o WHERE event_type = 'signup') a ASOF LEFT JOIN (SELECT user_id, ts, min(event_id) AS event_id FROM o WHERE event_type = 'purchase' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts <= b.ts")
def asof_next_event(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    left = e.where("event_type = 'signup'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id"))
    return transit.asof_forward(left, right.withColumn("rts", F.col("ts")), "user_id", "ts", "ts", ["event_id", "rts"]).select("event_id", "user_id", "next_event_id", F.col("next_rts").alias("next_ts"))


@query("WITH t AS (SELECT s_suppkey % 9 AS src, s_suppkey * 3 % 9 AS dst, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey * 17 % 400 END AS s FROM supplier) SELECT src, dst, min(coalesce(s, 90)) AS seconds FROM t WHERE src <> dst GROUP BY 1, 2")
def transfers_min(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select((k % 9).alias("src"), (k * 3 % 9).alias("dst"), F.when(k % 4 != 0, k * 17 % 400).alias("seconds"))
    return transit.minimal_transfers(rows.where("seconds is not null"), rows.where("seconds is null"))


_fold = "WITH c AS (SELECT DISTINCT l_orderkey AS trip, l_linenumber AS seq, first_value(l_suppkey % 3) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey) AS stop FROM lineitem), k AS (SELECT *, lag(stop) OVER (PARTITION BY trip ORDER BY seq) AS p FROM c), f AS (SELECT * FROM k WHERE p IS NULL OR p <> stop), g AS (SELECT trip, count(*) AS calls, string_agg(stop::VARCHAR, ',' ORDER BY seq) AS stops FROM f GROUP BY trip) SELECT trip, calls, stops FROM g WHERE calls >= 2"


@query(_fold)
def trip_call_fold(spark, sf_dir):
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_suppkey", "l_partkey")
    calls = table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(first)).where("r = 1")
    calls = calls.select(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("seq"), (F.col("l_suppkey") % 3).alias("stop"), (F.col("l_linenumber") * 60).alias("arr"), (F.col("l_linenumber") * 60).alias("dep"))
    kept = transit.folded_calls(calls)
    return kept.groupBy("trip").agg(F.count("*").alias("calls"), F.array_join(F.array_sort(F.collect_list(F.struct("pos", "stop")))["stop"], ",").alias("stops"))


# Quality, strings, export

_snap = "SELECT c_mktsegment AS category, (c_custkey * 37 % 700)::DOUBLE AS d, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS name FROM customer"


def _snaps(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category"), (k * 37 % 700).cast("double").alias("d"), F.when(k % 11 != 0, F.col("c_name")).alias("name"))


@query(f"SELECT category, count(*) AS n, count(*) FILTER (name IS NULL) AS unnamed, count(*) FILTER (d > 150 AND d <= 500) AS poor, count(*) FILTER (d > 500) AS failed FROM ({_snap}) GROUP BY 1")
def quality_profile(spark, sf_dir):
    return _report(spark, sf_dir).select("category", F.col("services").alias("n"), "unnamed", "poor", "failed")


def _report(spark, sf_dir):
    return service_report(_snaps(spark, sf_dir).select("category", F.lit("walk").alias("network"), "name", F.col("d").alias("distance_m"), F.lit("trade").alias("source")))


@query(f"SELECT category, median(d) AS median_m, round(quantile_cont(d, 0.95), 6) AS p95_m, max(d) AS max_m FROM ({_snap}) WHERE d <= 500 GROUP BY 1")
def snap_percentiles(spark, sf_dir):
    return _report(spark, sf_dir).select("category", "median_m", F.round("p95_m", 6).alias("p95_m"), "max_m")


@query("SELECT CASE p_size % 12 WHEN 0 THEN 'Tram' WHEN 1 THEN 'Metro' WHEN 2 THEN 'Train' WHEN 3 THEN 'Bus' WHEN 4 THEN 'Ferry' WHEN 5 THEN 'Cable tram' WHEN 6 THEN 'Aerial lift' WHEN 7 THEN 'Funicular' WHEN 11 THEN 'Trolleybus' ELSE 'Transit' END AS vehicle, count(*) AS routes FROM part GROUP BY 1")
def route_vehicle_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(vehicle(F.col("p_size") % 12).alias("vehicle")).agg(F.count("*").alias("routes"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE regexp_replace(trim(p_name), '\\s+', ' ', 'g') END AS name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part")
def name_normalize(spark, sf_dir):
    messy = F.when(F.col("p_partkey") % 5 == 0, " NaN ").otherwise(F.concat(F.lit("  "), F.col("p_name"), F.lit("\t ")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.normalize_name(F.translate(messy, "\t", " ")).alias("name"), X.name_key(F.col("p_name")).alias("key"))


@query("SELECT c_custkey AS id, regexp_replace('seg:' || c_mktsegment || ':' || c_name, '[^A-Za-z0-9:_.-]+', '-', 'g') AS safe FROM customer")
def safe_id(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), X.safe_id(F.lit("seg"), F.col("c_mktsegment"), F.col("c_name")).alias("safe"))


@query("SELECT c_custkey AS id, substr(sha1(c_custkey || ',' || c_nationkey), 1, 10) AS sid FROM customer")
def sha1_id(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), X.position_id(F.col("c_custkey"), F.col("c_nationkey")).alias("sid"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN c_name ELSE 'none' END AS label FROM customer")
def first_nonempty(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), X.first_nonempty(F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(F.lit("  ")), F.when(k % 3 == 0, F.col("c_name")), F.lit("none")).alias("label"))


@query("SELECT 'nation:' || n_nationkey AS \"id:ID\", n_name AS name, n_regionkey::VARCHAR AS region, 'Nation' AS \":LABEL\" FROM nation")
def csv_export_shape(spark, sf_dir):
    from ..sources import sinks

    return sinks.node_rows(trade_graph(spark, sf_dir).nodes("Nation").select("id", "name", "region"), "Nation")


@query("SELECT 'MERGE (n:Region {id: ''region:' || r_regionkey || '''}) SET n.key = ' || r_regionkey || ', n.name = ''' || r_name || ''';' AS value FROM region")
def cypher_export(spark, sf_dir):
    from ..sources import sinks

    return sinks.cypher_nodes(trade_graph(spark, sf_dir).nodes("Region").select("id", "key", "name"), "Region")


# Events: the batch form of the streaming operators


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    return streams.tumbling(table(spark, sf_dir, "events"), "1 hour").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, k")
def events_session(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"), "6 hours")


@query("SELECT DISTINCT user_id, event_type, date_trunc('day', ts)::TIMESTAMP AS day FROM events")
def events_dedup_watermark(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return streams.without_duplicates(events, ["user_id", "event_type", "day"]).select("user_id", "event_type", "day")


@query("SELECT half - INTERVAL 30 MINUTE * k AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS half, event_type FROM events), (VALUES (0), (1)) t(k) GROUP BY 1, 2")
def events_sliding(spark, sf_dir):
    return streams.tumbling(table(spark, sf_dir, "events"), "1 hour", "30 minutes").select("start", "event_type", "n")


@query("SELECT event_id, n_name AS name FROM events LEFT JOIN nation ON user_id % 40 = n_nationkey")
def events_enriched(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("k", F.col("user_id") % 40)
    return streams.enriched(events, table(spark, sf_dir, "nation"), "k", "n_nationkey").select("event_id", F.col("n_name").alias("name"))
