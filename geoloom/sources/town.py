"""A town made from the trade tables by rules: areas from nations, services and platforms from suppliers, residents from orders,
accidents and schools from customers, and a timetable feed from orders and their lines. It grows with the tables."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import CATEGORY_LABELS
from ..city import City
from ..graph import nation_years, table

WEST, SOUTH, WIDE, HIGH = 7.5, 47.5, 0.02, 0.014
#: Street grids: columns, rows, steps in degrees.
GRIDS = {"walk": (26, 24, 0.004, 0.003), "bike": (13, 24, 0.008, 0.003)}
CORNER = 7.4991, 47.4991
#: South, west, north, east of what the feed is cut to.
BOX = 47.50, 7.50, 47.56, 7.59


def place(k: Column, lon0: float, a: int, m: int, lat0: float, b: int, n: int) -> tuple[Column, Column]:
    return F.lit(lon0) + (k * a % m) * F.lit(0.0001), F.lit(lat0) + (k * b % n) * F.lit(0.0001)


def supplier_place(k: Column) -> tuple[Column, Column]:
    return place(k, 7.49835, 37, 1009, 47.49873, 53, 701)


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    x0, x1 = (F.lit(WEST) + (k % 5 + d) * F.lit(WIDE) for d in (0, 1))
    y0, y1 = (F.lit(SOUTH) + (F.floor(k / 5) + d) * F.lit(HIGH) for d in (0, 1))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("area:"), k).alias("area"), k.alias("ord"), F.col("n_name").alias("name"), k.cast("string").alias("wov_id"), ring.alias("ring"))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_years(spark, sf_dir).select(
        F.col("nation_key").cast("string").alias("wov_id"), "year", "total", F.col("urgent").alias("children"), F.col("high").alias("young"), F.col("medium").alias("working_age"), F.col("low").alias("elderly"), F.floor(F.col("low") / 2).alias("elderly_80_plus")
    )


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    lon, lat = supplier_place(k)
    category = F.element_at(F.array(*map(F.lit, CATEGORY_LABELS)), (k % 8 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("service:"), k).alias("id"), k.alias("ord"), category.alias("category"), F.when(k % 11 != 0, F.col("s_name")).alias("name"), lon.alias("lon"), lat.alias("lat"),
        F.concat(F.lit("source "), k % 3).alias("source"), F.concat(F.lit("d"), k % 2).alias("dataset"), F.when(k % 3 == 0, "u").otherwise(F.concat(F.lit("u"), k % 7)).alias("url"),
    )


def network(spark: SparkSession, mode: str) -> tuple[DataFrame, DataFrame]:
    columns, rows, dx, dy = GRIDS[mode]
    name = lambda n: F.concat_ws(":", F.lit(mode[0]), n % columns, F.floor(n / columns))
    n = spark.range(columns * rows)
    k = F.col("id")
    nodes = n.select(name(k).alias("node"), (F.lit(CORNER[0]) + (k % columns) * F.lit(dx)).alias("lon"), (F.lit(CORNER[1]) + F.floor(k / columns) * F.lit(dy)).alias("lat"))
    across, up = n.where(k % columns < columns - 1).select(k.alias("u"), (k + 1).alias("v")), n.where(k < columns * (rows - 1)).select(k.alias("u"), (k + columns).alias("v"))
    return nodes, across.unionByName(up).select(name(F.col("u")).alias("u"), name(F.col("v")).alias("v"), F.lit(None).cast("double").alias("length_m"))


def points(spark: SparkSession, sf_dir: str, kind: str, every: int, rest: int) -> DataFrame:
    k = F.col("c_custkey")
    lon, lat = place(k, 7.49925, 31, 997, 47.49935, 71, 691)
    return table(spark, sf_dir, "customer").where(k % every == rest).select(F.concat(F.lit(f"{kind}:"), k).alias("id"), lon.alias("lon"), lat.alias("lat"))


def town(spark: SparkSession, sf_dir: str, timetable: dict[str, DataFrame] | None = None) -> City:
    return City(spark, areas(spark, sf_dir), population(spark, sf_dir), services(spark, sf_dir), {m: network(spark, m) for m in GRIDS}, timetable, points(spark, sf_dir, "school", 50, 0), points(spark, sf_dir, "accident", 7, 1))


def feed_files(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The files of a feed as text columns, with what real feeds have: missing names, broken numbers, unknown routes and services."""
    text = lambda c: c.cast("string")
    supplier, orders, lines = (table(spark, sf_dir, t) for t in ("supplier", "orders", "lineitem"))
    k, o = F.col("s_suppkey"), F.col("o_orderkey")
    lon, lat = supplier_place(k)
    six = lambda c: F.format_string("%.6f", c)
    stops = supplier.select(F.concat(F.lit("p"), k).alias("stop_id"), F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("Halt "), k % 40)).alias("stop_name"), F.when(k % 17 == 0, "x").otherwise(six(lat)).alias("stop_lat"), six(lon).alias("stop_lon"), F.when(k % 4 != 0, F.concat(F.lit("st"), k % 40)).otherwise("").alias("parent_station"))
    r = F.col("r_regionkey")
    region = table(spark, sf_dir, "region")
    kinds = F.element_at(F.array(*map(F.lit, ("900", "700", "x", "100", "109"))), r + 1)
    routes = region.select(F.concat(F.lit("r"), r).alias("route_id"), F.concat(F.lit("L"), r).alias("route_short_name"), F.col("r_name").alias("route_long_name"), kinds.alias("route_type"), F.concat(F.lit("a"), r % 3).alias("agency_id"))
    agency = region.where(r < 2).select(F.concat(F.lit("a"), r).alias("agency_id"), F.concat(F.lit("Agency "), r).alias("agency_name"))
    trips = orders.select(F.concat(F.lit("t"), o).alias("trip_id"), F.concat(F.lit("r"), o % 7).alias("route_id"), F.concat(F.lit("s"), o % 4).alias("service_id"), F.col("o_orderpriority").alias("trip_headsign"))
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_suppkey", "l_partkey")
    one = lines.withColumn("n", F.row_number().over(first)).where("n = 1")
    at = 21600 + F.col("l_linenumber") * 600 + F.col("l_partkey") % 5 * 60
    clock = lambda s: F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    calls = one.select(F.concat(F.lit("t"), "l_orderkey").alias("trip_id"), text(F.col("l_linenumber")).alias("stop_sequence"), F.concat(F.lit("p"), "l_suppkey").alias("stop_id"), F.when(F.col("l_partkey") % 29 == 0, "soon").otherwise(clock(at)).alias("arrival_time"), F.when(F.col("l_partkey") % 3 == 0, "").otherwise(clock(at + 30)).alias("departure_time"))
    week = {"s0": "1111100", "s1": "0000011", "s2": "1111111", "s3": "1010100"}
    days = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    calendar = spark.createDataFrame([(s, *bits, "20260101", "" if s == "s3" else "20261231") for s, bits in week.items()], ", ".join(f"{c} string" for c in ("service_id", *days, "start_date", "end_date")))
    n = F.col("n_nationkey")
    dates = table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), n % 5).alias("service_id"), F.when(n % 9 == 0, "soon").otherwise(F.concat(F.lit("202607"), F.lpad(text(n + 1), 2, "0"))).alias("date"), text(n % 2 + 1).alias("exception_type"))
    transfers = supplier.select(F.concat(F.lit("p"), k).alias("from_stop_id"), F.concat(F.lit("p"), k * 3 % 100).alias("to_stop_id"), F.when(k % 4 == 0, "").otherwise(text(k * 17 % 400)).alias("min_transfer_time"))
    return {"stops": stops, "routes": routes, "agency": agency, "trips": trips, "stop_times": calls, "calendar": calendar, "calendar_dates": dates, "transfers": transfers}


def archives(files: dict[str, DataFrame], buckets: int) -> DataFrame:
    """Zip archives (content) that together hold all files; rows are dealt by a hash, so that an archive stays small."""
    parts = None
    for name, df in files.items():
        rows = df.select(F.lit(name).alias("file"), F.lit(",".join(df.columns)).alias("header"), F.to_csv(F.struct(*df.columns)).alias("line"))
        parts = rows if parts is None else parts.unionByName(rows)

    def pack(rows: pa.Table) -> pa.Table:
        by: dict[tuple, list] = {}
        for f, h, line in zip(*(rows.column(c).to_pylist() for c in ("file", "header", "line")), strict=True):
            by.setdefault((f, h), []).append(line)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for (f, h), lines in sorted(by.items()):
                z.writestr(f"{f}.txt", "﻿" + h + "\r\n" + "\r\n".join(lines) + "\r\n")
        return pa.table({"content": pa.array([out.getvalue()], pa.binary())})

    return parts.withColumn("b", F.pmod(F.xxhash64("file", "line"), F.lit(buckets))).groupBy("b").applyInArrow(pack, "content binary")


def feed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The timetable that ``feeds.extract`` makes of the town's feed; the archives are written once."""
    from . import caches, feeds

    files = feed_files(spark, sf_dir)
    path = caches.shared_folder(spark, "feed")
    archives(files, max(4, files["stop_times"].count() // 200_000)).write.parquet(path)
    return feeds.extract(spark, spark.read.parquet(path), BOX)
