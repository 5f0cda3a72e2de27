"""Sinks: CSV for bulk import, Cypher scripts, GeoJSON, JSON artefacts, manifests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph


def _text(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.typeName()
    return F.coalesce(F.to_json(F.col(c)) if kind in ("array", "struct", "map") else F.col(c).cast("string"), F.lit(""))


def node_rows(nodes: DataFrame, label: str) -> DataFrame:
    """Rows of an import file: nested values as JSON, nulls empty."""
    return nodes.select(F.col("id").alias("id:ID"), *(_text(nodes, c).alias(c) for c in nodes.columns if c not in ("id", "_ord", "geometry")), F.lit(label).alias(":LABEL"))


def edge_rows(edges: DataFrame, relation: str) -> DataFrame:
    return edges.select(F.col("src").alias(":START_ID"), F.col("dst").alias(":END_ID"), F.lit(relation).alias(":TYPE"), *(_text(edges, c).alias(c) for c in edges.columns if c not in ("src", "dst")))


def to_csv(graph: PropertyGraph, path: str) -> None:
    for k in graph.catalog.nodes:
        node_rows(graph.nodes(k), k).write.mode("overwrite").option("header", True).csv(f"{path}/nodes/{k}")
    for r, t in graph.catalog.relations.items():
        if t.kind == "structural":
            edge_rows(graph.edges(r), r).write.mode("overwrite").option("header", True).csv(f"{path}/edges/{r}")


def _value(df: DataFrame, c: str) -> Column:
    if df.schema[c].dataType.typeName() in ("integer", "long", "double", "boolean"):
        return F.col(c).cast("string")
    escaped = F.regexp_replace(F.regexp_replace(_text(df, c), r"\\", r"\\\\"), "'", r"\\'")
    return F.concat(F.lit("'"), escaped, F.lit("'"))


def cypher_nodes(nodes: DataFrame, label: str) -> DataFrame:
    """A MERGE statement a row; null properties are left out."""
    sets = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"n.{c} = "), _value(nodes, c))) for c in nodes.columns if c not in ("id", "_ord", "geometry")]
    return nodes.select(F.concat(F.lit(f"MERGE (n:{label} {{id: "), _value(nodes, "id"), F.lit("}) SET "), F.concat_ws(", ", *sets), F.lit(";")).alias("value"))


def cypher_edges(edges: DataFrame, relation: str) -> DataFrame:
    return edges.select(F.concat(F.lit("MATCH (a {id: "), _value(edges, "src"), F.lit("}), (b {id: "), _value(edges, "dst"), F.lit(f"}}) MERGE (a)-[:{relation}]->(b);")).alias("value"))


def cypher_schema(graph: PropertyGraph) -> list[str]:
    return [f"CREATE CONSTRAINT IF NOT EXISTS FOR (n:{k}) REQUIRE n.id IS UNIQUE;" for k in graph.catalog.nodes]


def features(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """A GeoJSON feature a row; write them as text, one a line."""
    rest = [c for c in points.columns if c not in (lon, lat)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, 6), F.round(lat, 6)).alias("coordinates"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def to_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as XML rows that ``readers.graphml`` reads back."""
    data = lambda df, c: F.struct(F.lit(c).alias("_key"), F.col(c).cast("string").alias("_VALUE"))
    n = nodes.select(F.col("node").alias("_id"), F.array(*(data(nodes, c) for c in nodes.columns if c != "node")).alias("data"))
    e = edges.select(F.col("u").alias("_source"), F.col("v").alias("_target"), F.array(*(data(edges, c) for c in edges.columns if c not in ("u", "v"))).alias("data"))
    n.write.mode("overwrite").format("xml").option("rootTag", "graphml").option("rowTag", "node").save(f"{path}/nodes")
    e.write.mode("overwrite").format("xml").option("rootTag", "graphml").option("rowTag", "edge").save(f"{path}/edges")


def manifest(files: DataFrame) -> dict:
    """Path, size and SHA-256 of each artefact, from a binaryFile scan."""
    rows = files.select("path", "length", F.sha2("content", 256).alias("sha256")).collect()
    return {r["path"].rsplit("/", 1)[-1]: {"bytes": r["length"], "sha256": r["sha256"]} for r in rows}


def stale(told: dict, found: dict) -> dict[str, str]:
    """What a manifest and the artefacts disagree on."""
    return {k: "missing" if k not in found else "changed" for k, v in told.items() if found.get(k) != v} | {k: "unlisted" for k in found if k not in told}


def dumps(rows: list[dict]) -> str:
    return json.dumps(rows, ensure_ascii=False, default=str)


def console(rows: list[dict], columns: list[str]) -> str:
    """Rows as a table of text, as wide as its values."""
    text = [[str("" if r.get(c) is None else r[c]) for c in columns] for r in rows]
    width = [max([len(c), *(len(t[i]) for t in text)]) for i, c in enumerate(columns)]
    line = lambda values: " | ".join(v.ljust(w) for v, w in zip(values, width, strict=True))
    return "\n".join([line(columns), "-+-".join("-" * w for w in width), *map(line, text)])
