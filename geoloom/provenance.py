"""Lineage of a query's fields, from the query document alone, and the engine's self-description.

Four classes: observed (read from a source), official (published statistics), derived (built from others),
dynamic (computed for the request and never stored).
"""

from __future__ import annotations

from .catalog import Catalog
from .graph import PropertyGraph
from .plans.spec import parse

CLASSES = ("observed", "official", "derived", "dynamic")


def relation_provenance(catalog: Catalog, name: str) -> dict:
    r = catalog.relation(name)
    return {"relation": r.name, "classification": r.classification, "stored": r.kind == "structural", "from": r.sources, "to": r.targets}


def entity_provenance(graph: PropertyGraph, kind: str, node_id: str) -> dict:
    return {"id": node_id, "type": kind, "classification": graph.catalog.node(kind).source, "fields": sorted(graph.get_node(kind, node_id))}


def fields_of(raw: dict, catalog: Catalog) -> dict[str, dict]:
    """For each result column: its class and the types, relations or analyses it comes from."""
    spec = parse(raw, catalog)
    steps = {s.name: s for s in spec.steps}
    analyses = {a.name: a for a in spec.analyses}
    made = {a.name: a for a in (*spec.aggregates, *spec.row_aggregates)}

    def trail(name: str | None) -> list[str]:
        out = []
        while name:
            out.append(steps[name].relation)
            name = steps[name].origin
        return out[::-1]

    def of(path: str) -> dict:
        if path in made:
            source = of(made[path].path) if made[path].path else {"types": [spec.start]}
            return {"classification": "dynamic" if source.get("classification") == "dynamic" else "derived", "aggregate": made[path].function, **{k: v for k, v in source.items() if k != "classification"}}
        head, _, tail = path.partition(".")
        if head in analyses:
            return {"classification": "dynamic", "analysis": analyses[head].kind, "parameters": analyses[head].params}
        if head in steps:
            kind = steps[head].targets[0]
            return {"classification": "derived" if tail == "count" else catalog.node(kind).source, "types": [spec.start, kind], "relations": trail(head)}
        return {"classification": catalog.node(spec.start).source, "types": [spec.start]}

    shown = spec.returned or (*spec.group_by, *made) if spec.group_by else spec.returned or tuple(catalog.node(spec.start).kinds())
    return {p: of(p) for p in shown}


def query_provenance(raw: dict, catalog: Catalog) -> dict:
    spec = parse(raw, catalog)
    types = list(dict.fromkeys([spec.start, *(t for s in spec.steps for t in s.targets)]))
    return {
        "types": {t: catalog.node(t).source for t in types},
        "relations": [relation_provenance(catalog, r) for r in dict.fromkeys(s.relation for s in spec.steps)],
        "computations": [{"analysis": a.kind, "parameters": a.params} for a in spec.analyses],
        "fields": fields_of(raw, catalog),
    }


def status(graph: PropertyGraph) -> dict:
    """The catalogue with live counts."""
    nodes = {r["type"]: r["n"] for r in graph.node_counts().collect()}
    edges = {r["relation"]: r["n"] for r in graph.edge_counts().collect()}
    return {"nodes": nodes, "edges": edges, "total_nodes": sum(nodes.values()), "total_edges": sum(edges.values())}
