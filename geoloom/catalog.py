"""The schema catalogue: node types, relation types and analyses, declared once."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import NotFoundError
from .functions.exprs import FILTERS


@dataclass(frozen=True)
class FieldType:
    name: str
    type: str
    description: str = ""
    unit: str | None = None
    filterable: bool = True


@dataclass(frozen=True)
class NodeType:
    name: str
    description: str
    fields: tuple[FieldType, ...]
    source: str = "observed"

    def kinds(self) -> dict[str, str]:
        return {"id": "string", "type": "string"} | {f.name: f.type for f in self.fields}

    def filterable(self) -> dict[str, str]:
        return {"id": "string", "type": "string"} | {f.name: f.type for f in self.fields if f.filterable}


@dataclass(frozen=True)
class RelationType:
    name: str
    sources: tuple[str, ...]
    targets: tuple[str, ...]
    inverses: tuple[str, ...] = ()
    symmetric: bool = False
    kind: str = "structural"
    classification: str = "derived"
    description: str = ""


@dataclass(frozen=True)
class Catalog:
    nodes: dict[str, NodeType]
    relations: dict[str, RelationType]
    analyses: dict[str, dict] = field(default_factory=dict)

    def node(self, name: str) -> NodeType:
        if name not in self.nodes:
            raise NotFoundError(f"unknown node type {name!r}", known=sorted(self.nodes))
        return self.nodes[name]

    def relation(self, name: str) -> RelationType:
        if name not in self.relations:
            raise NotFoundError(f"unknown relation {name!r}", known=sorted(self.relations))
        return self.relations[name]

    def describe(self) -> dict:
        return {
            "node_types": {n.name: {"description": n.description, "source": n.source, "fields": [vars(f) for f in n.fields]} for n in self.nodes.values()},
            "relation_types": {r.name: {"from": r.sources, "to": r.targets, "inverses": r.inverses, "symmetric": r.symmetric, "kind": r.kind} for r in self.relations.values()},
            "filter_operators": FILTERS,
            "analyses": self.analyses,
        }


def _fields(text: str) -> tuple[FieldType, ...]:
    return tuple(FieldType(*x.split(":")) for x in text.split())


TRADE = Catalog(
    nodes={
        n.name: n
        for n in (
            NodeType("Region", "a region of nations", _fields("key:int name:string")),
            NodeType("Nation", "an area with yearly order statistics", _fields("key:int name:string region:int latest_year:int orders_total:bigint urgent:bigint urgent_share:double")),
            NodeType("NationYear", "orders of a nation's customers in a year", _fields("nation:string year:int total:bigint urgent:bigint high:bigint medium:bigint low:bigint value:double"), "official"),
            NodeType("Segment", "a market segment of customers", _fields("name:string members:bigint"), "derived"),
            NodeType("Supplier", "a service location of a nation", _fields("key:bigint name:string nation:int balance:double category:string")),
            NodeType("Customer", "a customer of a nation", _fields("key:bigint name:string nation:int balance:double segment:string")),
            NodeType("Part", "what suppliers supply", _fields("key:bigint name:string brand:string kind:string size:int price:double")),
            NodeType("Order", "an order", _fields("key:bigint status:string price:double priority:string year:int")),
        )
    },
    relations={
        r.name: r
        for r in (
            RelationType("LOCATED_IN", ("Supplier", "Customer"), ("Nation",), ("HAS_SUPPLIER", "HAS_CUSTOMER")),
            RelationType("HAS_SUPPLIER", ("Nation",), ("Supplier",), ("LOCATED_IN",)),
            RelationType("HAS_CUSTOMER", ("Nation",), ("Customer",), ("LOCATED_IN",)),
            RelationType("PART_OF", ("Nation",), ("Region",), ("HAS_NATION",)),
            RelationType("HAS_NATION", ("Region",), ("Nation",), ("PART_OF",)),
            RelationType("ADJACENT_TO", ("Nation",), ("Nation",), ("ADJACENT_TO",), True),
            RelationType("HAS_OBSERVATION", ("Nation",), ("NationYear",), ("OBSERVES",)),
            RelationType("OBSERVES", ("NationYear",), ("Nation",), ("HAS_OBSERVATION",)),
            RelationType("OF_SEGMENT", ("Customer",), ("Segment",), ("HAS_MEMBER",)),
            RelationType("HAS_MEMBER", ("Segment",), ("Customer",), ("OF_SEGMENT",)),
            RelationType("PLACED", ("Customer",), ("Order",), ("PLACED_BY",)),
            RelationType("PLACED_BY", ("Order",), ("Customer",), ("PLACED",)),
            RelationType("SUPPLIES", ("Supplier",), ("Part",), ("SUPPLIED_BY",)),
            RelationType("SUPPLIED_BY", ("Part",), ("Supplier",), ("SUPPLIES",)),
            RelationType("REACHABLE_WITHIN", ("Nation",), ("Supplier",), kind="analytical", classification="dynamic"),
        )
    },
    analyses={"accessibility": {"modes": ["walk", "bike"], "parameters": ["mode", "minutes", "category"], "fields": {"count": "bigint", "nearest_m": "double", "minutes": "double"}}},
)


def _city_fields(text: str, hidden: str = "") -> tuple[FieldType, ...]:
    return _fields(text) + tuple(FieldType(*x.split(":"), filterable=False) for x in hidden.split())


# The service categories in their order, with labels; the essential ones; the travel modes.
CATEGORY_LABELS = {"school": "Schools", "grocery": "Groceries", "pharmacy": "Pharmacies", "healthcare": "Healthcare", "park": "Parks", "sport": "Sport", "library": "Libraries", "culture": "Culture"}
ESSENTIAL = ("grocery", "pharmacy", "healthcare", "school", "park", "sport")
MODES = ("walk", "bike", "transit")

_groups = "total:bigint children:bigint young:bigint working_age:bigint elderly:bigint elderly_80_plus:bigint"

CITY = Catalog(
    nodes={
        n.name: n
        for n in (
            NodeType("Neighborhood", "a statistical area with the figures of the latest year", _city_fields("name:string wov_id:string area_km2:double population_total:bigint children:bigint young:bigint working_age:bigint elderly:bigint elderly_80_plus:bigint child_share:double elderly_share:double population_density_km2:double reference_year:int representative_lat:double representative_lon:double", "origin_method:string geometry:string"), "official"),
            NodeType("PopulationObservation", "an area's residents by age group in a year", _city_fields(f"neighborhood_id:string year:int {_groups}"), "official"),
            NodeType("ServiceCategory", "a category of everyday destinations", _city_fields("category:string label:string essential:boolean count:bigint"), "derived"),
            NodeType("ServiceLocation", "an everyday destination", _city_fields("name:string display_name:string category:string lat:double lon:double neighborhood_id:string source:string routable_walk:boolean routable_bike:boolean", "geometry:string")),
            NodeType("StreetAccessPoint", "a street node that something attaches to", _city_fields("node_id:string network:string lat:double lon:double attached_count:bigint"), "derived"),
            NodeType("TransitStop", "a station in an area or within walking range of the network", _city_fields("stop_id:string name:string lat:double lon:double neighborhood_id:string route_count:bigint vehicles:array<string> walk_access:boolean", "geometry:string")),
            NodeType("TransitRoute", "a line", _city_fields("route_id:string short_name:string label:string vehicle:string agency:string stop_count:bigint")),
        )
    },
    relations={
        r.name: r
        for r in (
            RelationType("LOCATED_IN", ("ServiceLocation", "TransitStop"), ("Neighborhood",), ("HAS_SERVICE", "HAS_TRANSIT_STOP")),
            RelationType("HAS_SERVICE", ("Neighborhood",), ("ServiceLocation",), ("LOCATED_IN",)),
            RelationType("HAS_TRANSIT_STOP", ("Neighborhood",), ("TransitStop",), ("LOCATED_IN",)),
            RelationType("HAS_POPULATION_OBSERVATION", ("Neighborhood",), ("PopulationObservation",), ("OBSERVES",), classification="official"),
            RelationType("OBSERVES", ("PopulationObservation",), ("Neighborhood",), ("HAS_POPULATION_OBSERVATION",), classification="official"),
            RelationType("ADJACENT_TO", ("Neighborhood",), ("Neighborhood",), ("ADJACENT_TO",), True),
            RelationType("OF_CATEGORY", ("ServiceLocation",), ("ServiceCategory",), ("HAS_MEMBER",)),
            RelationType("HAS_MEMBER", ("ServiceCategory",), ("ServiceLocation",), ("OF_CATEGORY",)),
            RelationType("ACCESS_POINT", ("ServiceLocation", "TransitStop"), ("StreetAccessPoint",), ("ATTACHES",)),
            RelationType("ATTACHES", ("StreetAccessPoint",), ("ServiceLocation", "TransitStop"), ("ACCESS_POINT",)),
            RelationType("SERVED_BY", ("TransitStop",), ("TransitRoute",), ("SERVES",)),
            RelationType("SERVES", ("TransitRoute",), ("TransitStop",), ("SERVED_BY",)),
            RelationType("REACHABLE_WITHIN", ("Neighborhood",), ("ServiceLocation",), kind="analytical", classification="dynamic"),
        )
    },
    analyses={
        "accessibility": {
            "applies_to": ("Neighborhood",),
            "modes": list(MODES),
            "categories": list(CATEGORY_LABELS),
            "parameters": ["mode", "minutes", "departure_time", "max_transfers"],
            "fields": {"count": "bigint", "nearest_minutes": "double", "nearest_name": "string", "completeness.reachable_count": "bigint", "completeness.total": "int", "completeness.missing": "array<string>"}
            | {f"per_category.{c}.{f}": k for c in CATEGORY_LABELS for f, k in (("count", "bigint"), ("nearest_minutes", "double"), ("nearest_name", "string"))},
        }
    },
)
