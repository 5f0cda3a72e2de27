"""Sources: Parquet graphs, GraphML, GeoJSON records, zipped timetables, paged records, and the choice between them."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import DataUnavailableError
from ..functions.exprs import first_nonempty, parse_service_time, position_id


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, x, y) and edges (u, v, length_m); rows without usable coordinates are left out."""
    data = "data array<struct<_key:string,_VALUE:string>>"
    get = lambda k: F.element_at(F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], d["_VALUE"]))), k).try_cast("double")
    n = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(f"{path}/nodes")
    e = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(f"{path}/edges")
    nodes = n.select(F.col("_id").alias("node"), get("x").alias("x"), get("y").alias("y")).where("x is not null and y is not null")
    return nodes, e.select(F.col("_source").alias("u"), F.col("_target").alias("v"), get("length_m").alias("length_m"))


def zip_member(spark: SparkSession, path: str | DataFrame, member: str, columns: list[str]) -> DataFrame:
    """Rows of a CSV file inside zip archives (at a path, or rows with ``content``), BOM-tolerant, one task an archive, streamed in batches.

    A feed that is cut into several archives is read by as many tasks; an archive without the file gives no row."""

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                z = zipfile.ZipFile(io.BytesIO(content.as_py()))
                if member not in z.namelist():  # optional files may be missing
                    continue
                with z.open(member) as raw:
                    held: list[list] = []
                    for r in csv.DictReader(io.TextIOWrapper(raw, "utf-8-sig", newline="")):
                        held.append([r.get(c) for c in columns])
                        if len(held) == 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*held, strict=True)], columns)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*held, strict=True)], columns)

    archives = path if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path)
    return archives.select("content").mapInArrow(rows, ", ".join(f"`{c}` string" for c in columns))


def stop_times(spark: SparkSession, path: str) -> DataFrame:
    """Calls with times in seconds; rows that do not parse are left out."""
    raw = zip_member(spark, path, "stop_times.txt", ["trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time"])
    out = raw.select(F.col("trip_id").alias("trip"), F.col("stop_sequence").try_cast("int").alias("seq"), F.col("stop_id").alias("stop"), parse_service_time(F.col("arrival_time")).alias("arr"), parse_service_time(F.col("departure_time")).alias("dep"))
    return out.where("seq is not null and arr is not null and dep is not null")


def stations(stops: DataFrame) -> DataFrame:
    """Platforms gathered under their parent station: mean position, up to eight members."""
    station = F.coalesce(F.nullif(F.trim("parent_station"), F.lit("")), F.col("stop_id"))
    rows = stops.select(station.alias("station"), "stop_id", "stop_name", F.col("stop_lat").try_cast("double").alias("lat"), F.col("stop_lon").try_cast("double").alias("lon")).where("lat between -90 and 90 and lon between -180 and 180")
    return rows.groupBy("station").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min_by("stop_name", "stop_id").alias("name"), F.slice(F.array_sort(F.collect_set("stop_id")), 1, 8).alias("members"))


def geojson_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Raw records, one JSON object a line, as entities: id, name, lon, lat. The geometry may be a point, a feature or a geo_point."""
    raw = spark.read.text(path)
    at = lambda p: F.get_json_object("value", p)
    lon = F.coalesce(at("$.geometry.coordinates[0]"), at("$.geometry.geometry.coordinates[0]"), at("$.geo_point_2d.lon")).try_cast("double")
    lat = F.coalesce(at("$.geometry.coordinates[1]"), at("$.geometry.geometry.coordinates[1]"), at("$.geo_point_2d.lat")).try_cast("double")
    rows = raw.select(lon.alias("lon"), lat.alias("lat"), first_nonempty(at("$.name"), at("$.title"), at("$.label")).alias("name"), first_nonempty(at("$.id"), at("$.uuid")).alias("own")).where("lon is not null and lat is not null")
    return rows.select(F.concat(F.lit(f"{kind}:"), F.coalesce("own", position_id(F.col("lon"), F.col("lat")))).alias("id"), "name", "lon", "lat")


class BadRequest(Exception):
    """What a paged service answers to an order it does not know (400)."""


def paged(spark: SparkSession, fetch: Callable[[int, int, str | None], list[dict]], schema: str, page: int = 100, readers: int = 8, most: int | None = None, order_by: str | None = None) -> DataFrame:
    """Records of a service that gives pages of 100 at most, whose number nobody tells beforehand.

    Reader k of ``readers`` takes pages k, k + readers, k + 2 readers ... and stops at a short one. An order that the service does not
    know is left out from then on. ``fetch(offset, limit, order_by)`` must be importable on executors.
    """
    size = min(page, 100)
    fields = [f.name for f in spark.createDataFrame([], schema).schema]
    kinds = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def rows(batches):
        for batch in batches:
            for start in batch.column(0).to_pylist():
                order, at = order_by, start * size
                while most is None or at < most:
                    wanted = size if most is None else min(size, most - at)
                    try:
                        got = fetch(at, wanted, order)
                    except BadRequest:
                        if order is None:
                            raise
                        order = None
                        continue
                    if got:
                        yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in fields} for r in got], schema=kinds)
                    if len(got) < wanted:
                        break
                    at += size * readers

    return spark.range(0, readers, 1, readers).mapInArrow(rows, schema)


def resolve(load: Callable[[], DataFrame], fixture: Callable[[], DataFrame], pinned: bool = False) -> tuple[DataFrame, str, str | None]:
    """The data, its mode and the reason for a fallback; a pinned source refuses one."""
    try:
        df = load()
        if not df.limit(1).count():
            raise DataUnavailableError("the source is empty")
        return df, "live", None
    except Exception as reason:
        if pinned:
            raise DataUnavailableError(f"the pinned source failed: {reason}") from reason
        return fixture(), "fixture", str(reason).splitlines()[0]


def union_of(providers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """What the providers give, by name, the first row of an id kept; a provider that fails is listed and does not stop the others."""
    from ..operators.spatial import keep_first

    out, errors = None, {}
    for i, (name, load) in enumerate(providers.items()):
        try:
            df = load().withColumn("_ord", F.lit(i))
            df.schema
        except Exception as reason:
            errors[name] = str(reason).splitlines()[0]
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return (None if out is None else keep_first(out)), errors
