"""The engine as one object, its bounded tools, and an HTTP surface over them.

Rows are collected only where a request bounds them. ``Engine.handle`` maps a method, a path and parameters to a
status and a payload; ``serve`` puts it behind the standard library's server.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import CATEGORY_LABELS, ESSENTIAL
from .city import QUESTIONS, City
from .errors import EngineError, NotFoundError, QuerySpecError
from .operators import routing
from .provenance import entity_provenance, query_provenance, relation_provenance, status
from .trace import health, question_fields, traced

MOST_ROWS, MOST_AREAS, MOST_NODES = 1000, 25, 500
GEOMETRY = ("geometry", "_ord")


def rows(df: DataFrame, limit: int = MOST_ROWS) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(min(limit, MOST_ROWS)).collect()]


class Engine:
    def __init__(self, city: City):
        self.city, self.graph = city, city.graph()

    # Retrieval

    def schema(self) -> dict:
        return self.graph.catalog.describe() | status(self.graph) | {"available_modes": self.city.modes}

    def entities(self, kind: str, limit: int = 50, offset: int = 0, filters: list[dict] = (), include_geometry: bool = False) -> dict:
        if limit < 1 or offset < 0:
            raise QuerySpecError("limit is 1 or more, offset 0 or more")
        page = self.graph.page(kind, limit, offset, filters)
        found = rows(page.drop(*(["_ord"] if include_geometry else GEOMETRY)), limit)
        return {"type": kind, "results": found, "count": len(found), "total": self.graph.matching(kind, filters).count(), "offset": offset}

    def entity(self, kind: str, node_id: str, include_geometry: bool = False) -> dict:
        node = self.graph.get_node(kind, node_id)
        return {k: v for k, v in node.items() if k != "_ord" and (include_geometry or k != "geometry")} | {"type": kind}

    def neighbors(self, kind: str, node_id: str, relation: str | None = None, limit: int = 100) -> dict:
        self.graph.get_node(kind, node_id)
        found = self.graph.neighbors(self.city.spark.createDataFrame([(node_id,)], "id string"), relation)
        counts = {r["relation"]: r["n"] for r in found.groupBy("relation").agg(F.count("*").alias("n")).collect()}
        return {"id": node_id, "by_relation": counts, "results": rows(found.orderBy("relation", "dst"), limit), "total": sum(counts.values())}

    def subgraph(self, kind: str, node_id: str, depth: int = 1, relations: list[str] | None = None, limit: int = 200, directed: bool = True) -> dict:
        self.graph.get_node(kind, node_id)
        limit, depth = min(limit, MOST_NODES), max(0, min(depth, 4))
        nodes = self.graph.subgraph(node_id, depth, relations, directed).orderBy("step", "id").limit(limit + 1)
        kept = [r.asDict() for r in nodes.collect()]
        ids = self.city.spark.createDataFrame([(r["id"],) for r in kept[:limit]], "id string")
        edges = rows(self.graph.induced(ids, relations).orderBy("src", "dst", "relation"))
        return {"nodes": kept[:limit], "edges": edges, "node_count": min(len(kept), limit), "depth": depth, "truncated": len(kept) > limit}

    def query(self, raw: dict) -> dict:
        got = traced(self.graph, raw)
        return {"results": got["rows"], "count": got["count"], "truncated": got["truncated"], "execution": got["execution"], "provenance": query_provenance(raw, self.graph.catalog)}

    def ask(self, question: str, **told) -> dict:
        found = rows(self.city.ask(question, **told))
        own = {k: v for k, v in told.items() if k not in ("mode", "minutes")}
        return {"question": question, "results": found, "parameters": told, "fields": question_fields(question, told.get("mode", "walk"), float(told.get("minutes", 15)), **own)}

    def provenance(self, identifier: str) -> dict:
        if identifier in self.graph.catalog.relations:
            return relation_provenance(self.graph.catalog, identifier)
        prefix = identifier.split(":", 1)[0]
        kind = {"area": "Neighborhood", "population": "PopulationObservation", "category": "ServiceCategory", "service": "ServiceLocation", "access": "StreetAccessPoint", "stop": "TransitStop", "route": "TransitRoute"}.get(prefix)
        if kind is None:
            raise NotFoundError(f"nothing is called {identifier!r}", relations=sorted(self.graph.catalog.relations))
        return entity_provenance(self.graph, kind, identifier)

    # Reach from a point

    def _point(self, lat: float, lon: float) -> DataFrame:
        lat, lon = float(lat), float(lon)
        if not (-90 <= lat <= 90 and -180 <= lon <= 180):
            raise QuerySpecError("lat is between -90 and 90, lon between -180 and 180", lat=lat, lon=lon)
        return self.city.spark.createDataFrame([("origin", lon, lat)], "id string, lon double, lat double")

    def accessibility(self, lat: float, lon: float, mode: str = "walk", minutes: float = 15, departure_time=None, max_transfers: int = 1) -> dict:
        self._bounds(mode, minutes)
        origin = self._point(lat, lon)
        at = self.city.seeds(origin, "walk" if mode == "transit" else mode).first()
        if at is None:
            raise NotFoundError("no street within 1,000 m of this place", lat=lat, lon=lon)
        found = {r["category"]: {"count": r["n"], "nearest_minutes": r["nearest_minutes"], "nearest_name": r["nearest_name"]} for r in self.city.profile(origin, mode, float(minutes), departure_time, max_transfers).collect()}
        present = [c for c in ESSENTIAL if found[c]["count"]]
        missing = [c for c in ESSENTIAL if c not in present]
        return {"mode": mode, "minutes": minutes, "snapped_origin": {"node_id": at["node"], "snap_distance_m": round(at["snap_m"], 1)}, "reachable_services": found, "completeness": {"reachable_count": len(present), "total": len(ESSENTIAL), "missing_categories": missing, "ratio": round(len(present) / len(ESSENTIAL), 3)}}

    def route(self, lat: float, lon: float, service: str, mode: str = "walk", departure_time=None) -> dict:
        """The cheapest way from a place to a service: on streets its nodes and length, with the way off the network to the service; by
        transit its steps."""
        if mode == "transit" and "transit" in self.city.modes:
            wanted = self.city.spark.createDataFrame([(service,)], "id string")
            found = self.city.transit_routes(self._point(lat, lon), wanted, 60, departure_time).first()
            if found is None:
                raise NotFoundError(f"{service!r} cannot be reached", mode=mode)
            return {"service": service, "minutes": found["minutes"], "vehicles": found["vehicles"], "steps": [x.asDict() for x in found["steps"]]}
        if mode not in self.city.networks:
            raise QuerySpecError(f"routes are found on {', '.join(self.city.networks)}")
        to = self.city.access().where((F.col("id") == service) & (F.col("network") == mode) & F.col("node").isNotNull()).first()
        if to is None:
            raise NotFoundError(f"{service!r} is not attached to the {mode} network")
        seeds = self.city.seeds(self._point(lat, lon), mode).select("origin", "node", F.lit(0.0).alias("cost"))
        costs = routing.shortest_paths(seeds, self.city.edges(mode))
        path = routing.route(costs, to["node"])
        if not path:
            raise NotFoundError(f"{service!r} cannot be reached", mode=mode)
        metres = costs.where(F.col("node") == to["node"]).first()["cost"] + to["distance_m"]
        return {"service": service, "nodes": path, "distance_m": round(metres, 1), "minutes": round(metres / (routing.SPEED_KMH[mode] * 1000 / 60), 1)}

    # Bounded tools

    def _bounds(self, mode: str, minutes: float, category: str | None = None) -> None:
        if mode not in self.city.modes:
            raise QuerySpecError(f"unknown mode {mode!r}", known=self.city.modes)
        if not 0 < float(minutes) <= 60:
            raise QuerySpecError("minutes are more than 0 and at most 60")
        if category is not None and category not in CATEGORY_LABELS:
            raise QuerySpecError(f"unknown category {category!r}", known=list(CATEGORY_LABELS))

    def compare_areas(self, areas: list[str], category: str, modes: list[str] | None = None, minutes: float = 15, departure_time=None) -> dict:
        """One category and budget for up to 25 areas and all modes asked for, a search a mode."""
        modes = modes or self.city.modes
        if not 1 <= len(areas) <= MOST_AREAS:
            raise QuerySpecError(f"1 to {MOST_AREAS} areas can be compared")
        for m in modes:
            self._bounds(m, minutes, category)
        known = {r["id"] for r in self.graph.nodes("Neighborhood").where(F.col("id").isin(*areas)).select("id").collect()}
        if set(areas) - known:
            raise NotFoundError(f"no Neighborhood {sorted(set(areas) - known)[0]!r}")
        points = self.city.area_points().where(F.col("id").isin(*areas))
        found = {(r["origin"], m): r for m in modes for r in self.city.profile(points, m, float(minutes), departure_time).where(F.col("category") == category).collect()}
        out = [{"neighborhood_id": a, "mode": m, "category": category, "minutes": minutes, "count": found[a, m]["n"], "nearest_minutes": found[a, m]["nearest_minutes"], "nearest_name": found[a, m]["nearest_name"]} for a in areas for m in modes]
        return {"results": out, "count": len(out)}

    def find_reachable(self, area: str, category: str, mode: str = "walk", minutes: float = 15, departure_time=None) -> dict:
        return self.compare_areas([area], category, [mode], minutes, departure_time)["results"][0]

    def tools(self) -> dict:
        """The bounded tools by name; each takes keyword arguments and answers with a payload, errors included."""
        own = {"describe_graph": self.schema, "query_graph": self.query, "find_reachable": self.find_reachable, "compare_areas": self.compare_areas, "get_provenance": self.provenance}

        def guarded(f):
            def call(*args, **kw):
                try:
                    return f(*args, **kw)
                except EngineError as error:
                    return error.payload()

            return call

        return {name: guarded(f) for name, f in own.items()}

    # HTTP

    def handle(self, method: str, path: str, params: dict | None = None, body: dict | None = None) -> tuple[int, object]:
        try:
            return 200, self._answer(method, [unquote(x) for x in path.strip("/").split("/")], dict(params or {}), body)
        except EngineError as error:
            return error.status, error.payload()
        except (TypeError, ValueError, KeyError) as error:
            return 400, {"error": type(error).__name__, "message": str(error)}

    def _answer(self, method: str, path: list[str], p: dict, body):
        number = lambda k, d, kind=int: kind(p[k]) if k in p else d
        when = p.get("departure_time")
        if method == "POST":
            if path == ["spatial-graph", "query"]:
                return self.query(body)
            raise NotFoundError(f"nothing is posted to {'/'.join(path)}")
        match path:
            case ["health"]:
                return health(status(self.graph)["nodes"], {}, self.city.modes, ("Neighborhood", "ServiceLocation"))
            case ["data", "status"] | ["spatial-graph", "status"]:
                return status(self.graph)
            case ["services"]:
                return {"categories": rows(self.graph.page("ServiceCategory", 100).drop("_ord"))}
            case ["services", category]:
                return self.entities("ServiceLocation", number("limit", 100), number("offset", 0), [{"field": "category", "value": category}])
            case ["services", _, service]:
                return self.entity("ServiceLocation", service)
            case ["accessibility"] | ["accessibility", "walk"] | ["accessibility", "bike"] | ["accessibility", "transit"]:
                mode = path[1] if len(path) == 2 else p.get("mode", "walk")
                return self.accessibility(p["lat"], p["lon"], mode, number("minutes", 15, float), when, number("max_transfers", 1))
            case ["accessibility", "walk" | "bike" | "transit", "route"]:
                return self.route(p["lat"], p["lon"], p["service"], path[1], when)
            case ["accessibility", "compare"]:
                return {m: self.accessibility(p["lat"], p["lon"], m, number("minutes", 15, float), when) for m in self.city.modes}
            case ["transit", "stops"]:
                named = [{"field": "name", "op": "contains", "value": p["q"]}] if p.get("q") else []
                attached = [{"field": "walk_access", "value": True}] if p.get("attached") in ("1", "true") else []
                return self.entities("TransitStop", number("limit", 100), 0, named + attached)
            case ["transit", "routes"]:
                by = self.graph.nodes("TransitRoute")
                return {"routes": rows(by.orderBy("vehicle", "label").drop("_ord")), "by_vehicle": {r["vehicle"]: r["count"] for r in by.groupBy("vehicle").count().collect()}}
            case ["entities", kind]:
                return self.entities(kind, number("limit", 50), number("offset", 0))
            case ["entities", kind, node]:
                return self.entity(kind, node)
            case ["spatial-graph", "schema"]:
                return self.schema()
            case ["spatial-graph", "entity-types"]:
                return self.graph.catalog.describe()["node_types"]
            case ["spatial-graph", "relation-types"]:
                return self.graph.catalog.describe()["relation_types"]
            case ["spatial-graph", "questions"]:
                return list(QUESTIONS)
            case ["spatial-graph", "questions", name]:
                told = {k: p[k] for k in ("mode", "category") if k in p} | {k: float(p[k]) for k in ("minutes", "school_min", "healthcare_max", "min_children") if k in p}
                return self.ask(name, limit=number("limit", 10), departure=when, **told)
            case ["spatial-graph", "entities", kind]:
                return self.entities(kind, number("limit", 50), number("offset", 0))
            case ["spatial-graph", "entities", kind, node]:
                return self.entity(kind, node, p.get("include_geometry") in ("1", "true"))
            case ["spatial-graph", "entities", kind, node, "neighbors"]:
                return self.neighbors(kind, node, p.get("relation"), number("limit", 100))
            case ["spatial-graph", "entities", kind, node, "subgraph"]:
                told = [x.strip() for x in p.get("relations", "").split(",") if x.strip()]
                return self.subgraph(kind, node, number("depth", 1), told or None, number("limit", 200))
            case ["spatial-graph", "provenance", identifier]:
                return self.provenance(identifier)
            case ["analysis", "accessibility-gaps"]:
                self._bounds("walk", number("minutes", 15, float), p.get("category", "pharmacy"))
                return {k: rows(df) for k, df in self.city.gaps(p.get("category", "pharmacy"), number("minutes", 15, float), number("limit", 25)).items()}
            case ["analysis", "areas-by-accidents"]:
                return rows(self.city.areas_by_accidents())
            case ["analysis", "schools-by-nearby-accidents"]:
                return rows(self.city.schools_by_nearby_accidents())
        raise NotFoundError(f"no such path: /{'/'.join(path)}")


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server on ``host:port``; call ``serve_forever`` on it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body=None):
            url = urlsplit(self.path)
            code, payload = engine.handle(self.command, url.path, dict(parse_qsl(url.query)), body)
            data = json.dumps(payload, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = answer

        def do_POST(self):
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
            except ValueError:
                body = None
            self.answer(body)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
