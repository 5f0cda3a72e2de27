"""Data-quality reports and the caveats that apply to a request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.exprs import snap_quality


def service_report(services: DataFrame, poor: float = 150.0, most: float = 500.0) -> DataFrame:
    """A row for each category and network: services, missing names, poor and failed snaps, distance percentiles, sources."""
    grade = snap_quality(F.col("distance_m"), poor, most)
    near = F.when(grade != "unreachable", F.col("distance_m"))
    return services.groupBy("category", "network").agg(
        F.count("*").alias("services"), F.count_if(F.col("name").isNull()).alias("unnamed"), F.count_if(grade == "poor").alias("poor"), F.count_if(grade == "unreachable").alias("failed"),
        F.median(near).alias("median_m"), F.percentile(near, 0.95).alias("p95_m"), F.max(near).alias("max_m"), F.array_sort(F.collect_set("source")).alias("sources"),
    )


def caveats(report: list[dict], categories: set[str] | None = None, networks: set[str] | None = None) -> list[str]:
    """Sentences on what the report finds wrong within the scope of a request."""
    out = []
    for r in report:
        if (categories and r["category"] not in categories) or (networks and r["network"] not in networks):
            continue
        for key, text in (("failed", "cannot be reached on"), ("poor", "are far from")):
            if r[key]:
                out.append(f"{r[key]} of {r['services']} {r['category']} services {text} the {r['network']} network")
        if r["unnamed"]:
            out.append(f"{r['unnamed']} of {r['services']} {r['category']} services have no name")
    return out
