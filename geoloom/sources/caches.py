"""Prepared tables on shared storage: Parquet by kind, beside a manifest of version, row counts and fingerprints.

A cache is read only if its version fits and every kind that is needed has rows. Sources that cannot be read fall
back, or do not, by ``readers.resolve``.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataUnavailableError
from ..operators import spatial

VERSION = 1
MANIFEST = "manifest.json"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that the cluster names in ``spark.checkpoint.dir``; a temporary one only on a single machine."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise DataUnavailableError("spark.checkpoint.dir must name a folder that driver and executors share")
        told = "file://" + tempfile.mkdtemp(prefix="geoloom-")
    return f"{told.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def put_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def get_text(spark: SparkSession, path: str) -> str | None:
    try:
        return "\n".join(r[0] for r in spark.read.text(path).collect())  # a manifest: one line
    except Exception:
        return None


def fingerprint(nodes: int, edges: int, made: str) -> str:
    return f"{nodes}:{edges}:{made[:10]}"


def network_fingerprint(nodes: DataFrame, edges: DataFrame, made: str) -> str:
    return fingerprint(nodes.count(), edges.count(), made)


def write_cache(spark: SparkSession, path: str, tables: dict[str, DataFrame], fingerprints: dict[str, str] | None = None, errors: dict[str, str] | None = None, version: int = VERSION) -> dict:
    """Writes each table and then the manifest, so that a cache cut short has none."""
    counts = {}
    for kind, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{kind}")
        counts[kind] = spark.read.parquet(f"{path}/{kind}").count()
    told = {"version": version, "counts": counts, "fingerprints": fingerprints or {}, "errors": errors or {}}
    put_text(spark, f"{path}/{MANIFEST}", json.dumps(told))
    return told


def read_manifest(spark: SparkSession, path: str, version: int = VERSION) -> dict:
    text = get_text(spark, f"{path}/{MANIFEST}")
    if not text:
        raise DataUnavailableError("there is no prepared cache", path=path)
    told = json.loads(text)
    if told.get("version") != version:
        raise DataUnavailableError(f"the cache has version {told.get('version')}, not {version}", path=path)
    return told


def read_cache(spark: SparkSession, path: str, needed: Iterable[str] = (), version: int = VERSION) -> tuple[dict[str, DataFrame], dict]:
    told = read_manifest(spark, path, version)
    empty = [k for k in needed if not told["counts"].get(k)]
    if empty:
        raise DataUnavailableError(f"the cache has no rows of {', '.join(empty)}", path=path)
    return {k: spark.read.parquet(f"{path}/{k}") for k in told["counts"]}, told


def fetched(spark: SparkSession, path: str, sources: dict[str, Callable[[], DataFrame]], **told) -> dict:
    """Takes every kind from its source and caches them; fails as a whole if one gives no row."""
    made = write_cache(spark, path, {k: load() for k, load in sources.items()}, **told)
    empty = [k for k, n in made["counts"].items() if not n]
    if empty:
        raise DataUnavailableError(f"no usable rows of {', '.join(empty)}", path=path)
    return made


def attached(spark: SparkSession, path: str, services: DataFrame, networks: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, list[str]]:
    """(id, network, node, distance, quality) of services on networks (nodes, fingerprint), and which networks were snapped now.

    What the cache at ``path`` holds for a network of the same fingerprint is taken from there; others are snapped again.
    """
    try:
        tables, told = read_cache(spark, path)
    except DataUnavailableError:
        tables, told = {}, {"fingerprints": {}}
    stale = [n for n, (_, mark) in networks.items() if told["fingerprints"].get(n) != mark or n not in tables]
    parts = [spatial.snapped(services, nodes).select("id", F.lit(n).alias("network"), "node", "distance", "quality") if n in stale else tables[n].select("id", F.lit(n).alias("network"), "node", "distance", "quality") for n, (nodes, _) in networks.items()]
    return reduce(DataFrame.unionByName, parts), stale


def prepare(spark: SparkSession, path: str, steps: dict[str, Callable[[], dict[str, DataFrame]]], refresh: bool = False, version: int = VERSION) -> tuple[list[dict], int]:
    """For each step what is cached already, or what it makes now; a report a step, and 0, or 1 where a step failed."""
    report = []
    for name, make in steps.items():
        at = f"{path}/{name}"
        try:
            if not refresh:
                try:
                    told = read_manifest(spark, at, version)
                    report.append({"step": name, "state": "cached", "rows": sum(told["counts"].values()), "error": None})
                    continue
                except DataUnavailableError:
                    pass
            told = write_cache(spark, at, make(), version=version)
            report.append({"step": name, "state": "prepared", "rows": sum(told["counts"].values()), "error": None})
        except Exception as reason:
            report.append({"step": name, "state": "failed", "rows": 0, "error": str(reason).splitlines()[0]})
    return report, int(any(r["state"] == "failed" for r in report))


def write_report(report: DataFrame, path: str) -> None:
    """A quality report as JSON lines."""
    report.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).json(path)
    except Exception as reason:
        raise DataUnavailableError(f"there is no quality report: {str(reason).splitlines()[0]}", path=path) from reason


def write_graph_json(graph, path: str, kinds: list[str] | None = None, relations: list[str] | None = None, version: int = VERSION) -> None:
    """The graph as JSON lines, nodes (type, id, properties) and edges (relation, src, dst, properties), with a manifest."""
    spark = graph.spark
    whole = lambda df, drop: F.to_json(F.struct(*(c for c in df.columns if c not in drop)))
    for k in kinds or list(graph.catalog.nodes):
        df = graph.nodes(k)
        df.select("id", whole(df, ("id",)).alias("properties")).write.mode("overwrite").json(f"{path}/nodes/type={k}")
    for r in relations or [r for r, t in graph.catalog.relations.items() if t.kind == "structural"]:
        df = graph.edges(r)
        more = [c for c in df.columns if c not in ("src", "dst")]
        df.select("src", "dst", (F.to_json(F.struct(*more)) if more else F.lit("{}")).alias("properties")).write.mode("overwrite").json(f"{path}/edges/relation={r}")
    put_text(spark, f"{path}/{MANIFEST}", json.dumps({"version": version}))


def read_graph_json(spark: SparkSession, path: str, version: int = VERSION) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, properties, type) and edges (src, dst, properties, relation) of ``write_graph_json``."""
    read_manifest(spark, path, version)
    return spark.read.schema("id string, properties string, type string").json(f"{path}/nodes"), spark.read.schema("src string, dst string, properties string, relation string").json(f"{path}/edges")
