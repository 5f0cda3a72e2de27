"""Windows over an event table, streaming or not: tumbling and session windows, duplicates within a watermark, joins to dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    rows = _timed(events.withColumn("ts", F.col("ts").cast("timestamp")), late)
    out = rows.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    rows = _timed(events.withColumn("ts", F.col("ts").cast("timestamp")), late)
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n")


def without_duplicates(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def enriched(events: DataFrame, nodes: DataFrame, key: str, node_key: str) -> DataFrame:
    """A stream joined to a static node table."""
    return events.join(nodes, events[key] == nodes[node_key], "left")
