"""A typed property graph: one DataFrame a node type (id, _ord, fields), one a relation (src, dst, properties)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import TRADE, Catalog
from .errors import NotFoundError, QuerySpecError
from .functions.exprs import predicate, share
from .plans.spec import parse_filter


def upsert(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by ``order``."""
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


class PropertyGraph:
    def __init__(self, spark: SparkSession, catalog: Catalog, nodes: dict[str, Callable[[], DataFrame]], edges: dict[str, Callable[[], DataFrame]], analyses: dict[str, Callable] | None = None):
        self.spark, self.catalog, self._nodes, self._edges, self.analyses = spark, catalog, nodes, edges, analyses

    def nodes(self, kind: str) -> DataFrame:
        self.catalog.node(kind)
        return self._nodes[kind]()

    def edges(self, relation: str) -> DataFrame:
        if self.catalog.relation(relation).kind == "analytical":
            raise QuerySpecError(f"{relation} is analytical: it is computed for a query and never stored", use="analyses")
        return self._edges[relation]()

    def get_node(self, kind: str, node_id: str) -> dict:
        row = self.nodes(kind).where(F.col("id") == node_id).first()
        if row is None:
            raise NotFoundError(f"no {kind} {node_id!r}", type=kind, id=node_id)
        return row.asDict(recursive=True)

    def by_ids(self, kind: str, ids: list[str]) -> DataFrame:
        """Rows in the order of ``ids``, repeated as they are; ids of other types fall out."""
        wanted = self.spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, _pos int")
        return self.nodes(kind).join(wanted, "id").withColumn("_ord", F.col("_pos").cast("long")).drop("_pos")

    def matching(self, kind: str, filters: list[dict] = ()) -> DataFrame:
        kinds = self.catalog.node(kind).filterable()
        rows = self.nodes(kind)
        for f in (parse_filter(x, kinds, kind) for x in filters):
            rows = rows.where(predicate(F.lit(kind) if f.field == "type" else F.col(f.field), kinds[f.field], f.op, f.value, total=False))
        return rows

    def page(self, kind: str, limit: int = 50, offset: int = 0, filters: list[dict] = ()) -> DataFrame:
        return self.matching(kind, filters).orderBy("_ord").offset(offset).limit(min(limit, 1000))

    def all_edges(self, relations: list[str] | None = None) -> DataFrame:
        names = relations or [r for r, t in self.catalog.relations.items() if t.kind == "structural"]
        return reduce(DataFrame.unionByName, (self.edges(r).select("src", "dst", F.lit(r).alias("relation")) for r in names))

    def neighbors(self, node_ids: DataFrame, relation: str | None = None) -> DataFrame:
        """Edges out of the nodes in ``node_ids`` (column id)."""
        return self.all_edges([relation] if relation else None).join(node_ids.select(F.col("id").alias("src")), "src", "left_semi")

    def subgraph(self, start: str, depth: int, relations: list[str] | None = None, directed: bool = True) -> DataFrame:
        """Nodes within ``depth`` steps (at most 4): id and the step they are first reached in."""
        edges = self.all_edges(relations).select("src", "dst").distinct()
        if not directed:
            edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        seen = self.spark.createDataFrame([(start, 0)], "id string, step int")
        frontier = seen
        for step in range(1, min(depth, 4) + 1):
            found = edges.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
            frontier = found.join(seen, "id", "left_anti").withColumn("step", F.lit(step))
            seen = seen.unionByName(frontier)
        return seen

    def induced(self, nodes: DataFrame, relations: list[str] | None = None) -> DataFrame:
        """Edges whose both ends are among ``nodes`` (column id)."""
        ids = nodes.select("id").distinct()
        edges = self.all_edges(relations)
        return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "relation")

    def node_counts(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.nodes(k).groupBy().agg(F.count("*").alias("n")).select(F.lit(k).alias("type"), "n") for k in self.catalog.nodes))

    def edge_counts(self) -> DataFrame:
        return self.all_edges().groupBy("relation").agg(F.count("*").alias("n"))

    def save(self, path: str) -> None:
        for k in self.catalog.nodes:
            self.nodes(k).write.mode("overwrite").parquet(f"{path}/nodes/{k}")
        for r, t in self.catalog.relations.items():
            if t.kind == "structural":
                self.edges(r).write.mode("overwrite").parquet(f"{path}/edges/{r}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, catalog: Catalog = TRADE) -> PropertyGraph:
        read = lambda p: lambda: spark.read.parquet(p)
        structural = [r for r, t in catalog.relations.items() if t.kind == "structural"]
        return cls(spark, catalog, {k: read(f"{path}/nodes/{k}") for k in catalog.nodes}, {r: read(f"{path}/edges/{r}") for r in structural})


# Tables of the trade graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def nation_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a nation's customers by year, in overlapping buckets of priority."""
    of = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    bucket = lambda *p: F.sum(F.when(F.col("o_orderpriority").isin(*p), 1).otherwise(0))
    return of.groupBy(F.col("c_nationkey").alias("nation_key"), F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("total"),
        bucket("1-URGENT").alias("urgent"),
        bucket("1-URGENT", "2-HIGH").alias("high"),
        bucket("3-MEDIUM").alias("medium"),
        bucket("4-NOT SPECIFIED", "5-LOW").alias("low"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"),
    )


def trade_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    t = lambda name: table(spark, sf_dir, name)

    def nation():
        years = nation_years(spark, sf_dir)
        latest = years.groupBy("nation_key").agg(F.max("year").alias("latest_year"), F.max_by("total", "year").alias("orders_total"), F.max_by("urgent", "year").alias("urgent"))
        rows = t("nation").join(latest, F.col("n_nationkey") == F.col("nation_key"), "left")
        return rows.select(node_id("nation", F.col("n_nationkey")).alias("id"), F.col("n_nationkey").cast("long").alias("_ord"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), "latest_year", "orders_total", "urgent", share(F.col("urgent"), F.col("orders_total")).alias("urgent_share"))

    def year():
        rows = nation_years(spark, sf_dir)
        return rows.select(F.concat_ws(":", F.lit("obs"), "nation_key", "year").alias("id"), (F.col("nation_key") * 10000 + F.col("year")).cast("long").alias("_ord"), node_id("nation", F.col("nation_key")).alias("nation"), "year", "total", "urgent", "high", "medium", "low", "value")

    def simple(source, prefix, column, /, **fields):
        return lambda: t(source).select(node_id(prefix, F.col(column)).alias("id"), F.col(column).cast("long").alias("_ord"), F.col(column).alias("key"), *(f.alias(c) for c, f in fields.items()))

    c = F.col
    nodes = {
        "Region": simple("region", "region", "r_regionkey", name=c("r_name")),
        "Nation": nation,
        "NationYear": year,
        "Segment": lambda: t("customer").groupBy("c_mktsegment").agg(F.count("*").alias("members"), F.min("c_custkey").alias("_ord")).select(F.concat(F.lit("segment:"), "c_mktsegment").alias("id"), "_ord", c("c_mktsegment").alias("name"), "members"),
        "Supplier": simple("supplier", "supplier", "s_suppkey", name=c("s_name"), nation=c("s_nationkey"), balance=c("s_acctbal"), category=F.concat(F.lit("cat"), (c("s_suppkey") % 8).cast("string"))),
        "Customer": simple("customer", "customer", "c_custkey", name=c("c_name"), nation=c("c_nationkey"), balance=c("c_acctbal"), segment=c("c_mktsegment")),
        "Part": simple("part", "part", "p_partkey", name=c("p_name"), brand=c("p_brand"), kind=c("p_type"), size=c("p_size"), price=c("p_retailprice")),
        "Order": simple("orders", "order", "o_orderkey", status=c("o_orderstatus"), price=c("o_totalprice"), priority=c("o_orderpriority"), year=F.year("o_orderdate")),
    }
    pair = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"))
    s, k, n = node_id("supplier", c("s_suppkey")), node_id("customer", c("c_custkey")), node_id("nation", c("n_nationkey"))
    of_s, of_c = node_id("nation", c("s_nationkey")), node_id("nation", c("c_nationkey"))
    supplied = lambda: t("lineitem").select("l_suppkey", "l_partkey").distinct()
    ls, lp = node_id("supplier", c("l_suppkey")), node_id("part", c("l_partkey"))
    o, oc = node_id("order", c("o_orderkey")), node_id("customer", c("o_custkey"))
    seg = F.concat(F.lit("segment:"), "c_mktsegment")

    def adjacent():
        a, b = t("nation").alias("a"), t("nation").alias("b")
        return a.join(b, (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") != c("b.n_nationkey"))).select(node_id("nation", c("a.n_nationkey")).alias("src"), node_id("nation", c("b.n_nationkey")).alias("dst"))

    edges = {
        "LOCATED_IN": lambda: pair(t("supplier"), s, of_s).unionByName(pair(t("customer"), k, of_c)),
        "HAS_SUPPLIER": lambda: pair(t("supplier"), of_s, s),
        "HAS_CUSTOMER": lambda: pair(t("customer"), of_c, k),
        "PART_OF": lambda: pair(t("nation"), n, node_id("region", c("n_regionkey"))),
        "HAS_NATION": lambda: pair(t("nation"), node_id("region", c("n_regionkey")), n),
        "ADJACENT_TO": adjacent,
        "HAS_OBSERVATION": lambda: pair(year(), c("nation"), c("id")),
        "OBSERVES": lambda: pair(year(), c("id"), c("nation")),
        "OF_SEGMENT": lambda: pair(t("customer"), k, seg),
        "HAS_MEMBER": lambda: pair(t("customer"), seg, k),
        "PLACED": lambda: pair(t("orders"), oc, o),
        "PLACED_BY": lambda: pair(t("orders"), o, oc),
        "SUPPLIES": lambda: pair(supplied(), ls, lp),
        "SUPPLIED_BY": lambda: pair(supplied(), lp, ls),
    }
    return PropertyGraph(spark, TRADE, nodes, edges)
