"""What a request did and on which data: execution traces, states of the data, health, and what a question's fields rest on."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import Observation
from pyspark.sql import functions as F

from .graph import PropertyGraph
from .plans import compile as compiler
from .plans.spec import parse

FROZEN, LOCAL, FIXTURE, ABSENT, MIXED = "frozen", "local", "fixture", "absent", "mixed"


def traced(graph: PropertyGraph, raw: dict) -> dict:
    """``compile.execute`` with ``execution``: what was scanned, traversed, analysed and grouped. Counts come from an observation on
    the start rows, which costs no pass of its own."""
    spec = parse(raw, graph.catalog)
    began, seen = time.monotonic(), Observation("start")
    watched = PropertyGraph(graph.spark, graph.catalog, graph._nodes | {spec.start: lambda: graph.nodes(spec.start).observe(seen, F.count("*").alias("scanned"))}, graph._edges, graph.analyses)
    used_again = any(spec.start in s.targets for s in spec.steps)  # an observation counts one scan only
    got = compiler.execute(graph if used_again else watched, raw)
    scanned = graph.nodes(spec.start).count() if used_again else seen.get["scanned"]
    kinds = list(dict.fromkeys((a.kind, tuple(sorted(a.params.items()))) for a in spec.analyses))
    execution = {
        "start_type": spec.start, "candidates_scanned": scanned, "filters_applied": len(spec.filters), "relations_traversed": [s.relation for s in spec.steps],
        "analyses": [a.kind for a in spec.analyses], "analysis_calls": len(kinds), "group_by": list(spec.group_by), "groups_returned": got["count"] if spec.group_by else None,
        "having": len(spec.having), "limit": spec.limit, "elapsed_seconds": round(time.monotonic() - began, 3), "generated_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "computation_provenance": computations([{"id": f"{p.get('mode', 'walk')}_{kind}", "parameters": dict(p)} for kind, p in ((k, dict(v)) for k, v in kinds)]),
    }
    return got | {"execution": execution}


def computations(items: list[dict]) -> list[dict]:
    """Each computation once; another one of the same name gets a number behind it."""
    kept: dict[str, dict] = {}
    for item in items:
        name, k = item["id"], 2
        while name in kept and kept[name] != {**item, "id": name}:
            name, k = f"{item['id']}_{k}", k + 1
        kept[name] = {**item, "id": name}
    return list(kept.values())


def states(told: dict[str, dict], found: dict[str, dict | None], modes: dict[str, str] | None = None) -> dict[str, str]:
    """The state of each artefact: a fixture whatever lies on disk, absent, frozen where size and hash are the manifest's, else local."""
    out = {}
    for name in {**told, **found}:
        here = found.get(name)
        out[name] = FIXTURE if (modes or {}).get(name) == "fixture" else ABSENT if here is None else FROZEN if told.get(name) == here else LOCAL
    return out


def overall(each: dict[str, str], runtime: set[str] | None = None) -> str:
    """One word for all: the least reassuring one."""
    seen = {v for k, v in each.items() if runtime is None or k in runtime}
    if FIXTURE in each.values():
        return FIXTURE
    if seen == {FROZEN}:
        return FROZEN
    return MIXED if FROZEN in seen else LOCAL if LOCAL in seen else ABSENT


def metadata(inputs: dict[str, dict]) -> dict:
    """Of a built graph: its inputs with mode and source; it is a fixture as soon as one input is."""
    return {"mode": "fixture" if any(x.get("mode") == "fixture" for x in inputs.values()) else "live", "sources": {k: x.get("source") for k, x in inputs.items()}, "generated_at": datetime.now(timezone.utc).isoformat(timespec="seconds")}


def health(counts: dict[str, int], each: dict[str, str], modes: list[str], needed: tuple[str, ...] = ()) -> dict:
    """Whether the engine can answer: every needed type has nodes and at least one way to travel is there."""
    missing = [k for k in needed if not counts.get(k)]
    return {"status": "ok" if modes and not missing else "degraded", "missing": missing, "modes": modes, "data_state": overall(each) if each else ABSENT, "nodes": sum(counts.values())}


#: For each question: result field -> class and the computation it rests on; thresholds -> input field and comparison.
QUESTION_FIELDS = {
    "poorest_access": ({"n": "dynamic", "nearest_minutes": "dynamic"}, {}),
    "good_schools_poor_healthcare": ({"good": "dynamic", "poor": "dynamic", "gap": "derived"}, {"school_min": ("good", "gte"), "healthcare_max": ("poor", "lte")}),
    "adjacent_contrasts": ({"a_total": "dynamic", "b_total": "dynamic", "difference": "derived", "ratio": "derived"}, {}),
    "category_inequality": ({"mean": "derived", "cv": "derived", "worst": "derived", "best": "derived"}, {}),
    "mode_gain": ({"base_total": "dynamic", "other_total": "dynamic", "gain": "derived"}, {}),
    "children_underserved": ({"people": "official", "reached": "dynamic", "stops": "dynamic"}, {"min_children": ("people", "gt"), "pharmacy_below": ("reached", "lt"), "stops_below": ("stops", "lt")}),
}


def question_fields(question: str, mode: str, minutes: float, **told) -> list[dict]:
    """A row for each field and threshold of a question: its class, where it comes from, and whether the caller set it."""
    fields, thresholds = QUESTION_FIELDS[question]
    at = f"{mode}_accessibility_{minutes:g}"
    rows = [{"field": f"results[].{k}", "classification": c, "computation": at if c == "dynamic" else None, "method": None, "overridden": False} for k, c in fields.items()]
    for k, (source, op) in thresholds.items():
        own = told.get(k) is not None
        rows.append({"field": f"thresholds.{k}", "classification": "derived", "computation": f"{source} {op}", "method": "caller value" if own else "median", "overridden": own})
    return rows
