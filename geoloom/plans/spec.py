"""The query document: parsed, bounded and validated before anything runs."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..catalog import Catalog
from ..errors import QuerySpecError
from ..functions.exprs import FILTERS, NUMERIC

MAX_STEPS, MAX_ANALYSES, DEFAULT_LIMIT, MAX_LIMIT = 4, 4, 50, 1000
FUNCTIONS = ("count", "count_distinct", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Step:
    name: str
    relation: str
    targets: tuple[str, ...]
    origin: str | None
    filters: tuple[Filter, ...]
    min_count: int | None
    max_count: int | None


@dataclass(frozen=True)
class Analysis:
    name: str
    kind: str
    params: dict
    constraint: Filter | None


@dataclass(frozen=True)
class Aggregate:
    function: str
    path: str | None
    name: str


@dataclass(frozen=True)
class QuerySpec:
    start: str
    ids: tuple[str, ...] | None
    filters: tuple[Filter, ...]
    steps: tuple[Step, ...] = ()
    analyses: tuple[Analysis, ...] = ()
    group_by: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    row_aggregates: tuple[Aggregate, ...] = ()
    having: tuple[Filter, ...] = ()
    order_by: tuple[tuple[str, bool], ...] = ()
    rank: tuple[str, bool] | None = None
    limit: int = DEFAULT_LIMIT
    returned: tuple[str, ...] = ()
    include_geometry: bool = False
    paths: dict = field(default_factory=dict)


def parse_filter(raw: dict, kinds: dict[str, str], what: str) -> Filter:
    name, op, value = raw.get("field"), raw.get("op", "eq"), raw.get("value")
    if name not in kinds:
        raise QuerySpecError(f"{what} has no field {name!r}", known=sorted(kinds))
    if op not in FILTERS:
        raise QuerySpecError(f"unknown operator {op!r}", known=list(FILTERS))
    if op in ("in", "not_in") and not isinstance(value, (list, tuple)):
        raise QuerySpecError(f"{op} takes a list", field=name)
    if op == "between" and not (isinstance(value, (list, tuple)) and len(value) == 2):
        raise QuerySpecError("between takes a list of two", field=name)
    return Filter(name, op, tuple(value) if isinstance(value, list) else value)


def parse(raw: dict, catalog: Catalog) -> QuerySpec:
    if not isinstance(raw, dict) or not isinstance(raw.get("start"), dict):
        raise QuerySpecError("a query needs a start object with a type")
    start = catalog.node(raw["start"].get("type"))
    filters = tuple(parse_filter(f, start.filterable(), start.name) for f in raw["start"].get("filters", ()))
    steps: list[Step] = []
    names: dict[str, str] = {start.name: start.name}
    asked = [*(raw.get("analyses") or ()), *(raw.get("where") or ())]
    if len(raw.get("traverse") or ()) > MAX_STEPS or len(asked) > MAX_ANALYSES:
        raise QuerySpecError("too many steps or analyses", max_steps=MAX_STEPS, max_analyses=MAX_ANALYSES)
    for s in raw.get("traverse") or ():
        relation = catalog.relation(s.get("relation"))
        if relation.kind == "analytical":
            raise QuerySpecError(f"{relation.name} is analytical: ask for it under analyses", known=sorted(catalog.analyses))
        origin = s.get("from")
        from_type = names.get(origin or start.name)
        if from_type is None or from_type not in relation.sources:
            raise QuerySpecError(f"{relation.name} does not start at {origin or start.name}", allowed=list(relation.sources))
        told = s.get("target_type") or s.get("target")
        if told and told not in relation.targets:
            raise QuerySpecError(f"{relation.name} does not lead to {told}", allowed=list(relation.targets))
        # without a type, all that the relation leads to; fields are then those of the first type
        targets = (told,) if told else tuple(relation.targets)
        target = targets[0]
        name = s.get("as") or target
        if name in names:
            raise QuerySpecError(f"the name {name!r} is taken", taken=sorted(names))
        names[name] = target
        steps.append(Step(name, relation.name, targets, origin if origin != start.name else None, tuple(parse_filter(f, catalog.node(target).filterable(), target) for f in s.get("filters", ())), s.get("min_count"), s.get("max_count")))
    paths = dict(start.kinds()) | {f"{start.name}.{f}": k for f, k in start.kinds().items()}
    for s in steps:
        paths[f"{s.name}.count"] = "bigint"
        paths |= {f"{s.name}.{f}": f"array<{k}>" for f, k in catalog.node(s.targets[0]).kinds().items()}
    analyses = []
    for a in asked:
        kind = a.get("analysis") or a.get("type") or "accessibility"
        if kind not in catalog.analyses:
            raise QuerySpecError(f"unknown analysis {kind!r}", known=sorted(catalog.analyses))
        told, name = catalog.analyses[kind], a.get("as") or f"{kind}_{len(names)}"
        if name in names:
            raise QuerySpecError(f"the name {name!r} is taken", taken=sorted(names))
        names[name] = kind
        if start.name not in told.get("applies_to", (start.name,)):
            raise QuerySpecError(f"{kind} applies to {', '.join(told['applies_to'])}, not {start.name}")
        params = {"mode": "walk"} | {k: a[k] for k in told["parameters"] if a.get(k) is not None}
        category = a.get("category", a.get("target_category"))
        if category is not None:
            if category not in told.get("categories", (category,)):
                raise QuerySpecError(f"unknown category {category!r}", known=list(told["categories"]))
            params["category"] = category
        minutes = params.get("minutes", 15)
        if params["mode"] not in told["modes"] or not isinstance(minutes, (int, float)) or not 0 < minutes <= 60:
            raise QuerySpecError("an analysis needs a known mode and 0 < minutes <= 60", modes=told["modes"])
        kinds = told["fields"]
        constraint, test = None, a.get("constraint")
        if test is None and "operator" in a:
            # the longest operator that the shorthand ends in, so that count_not_in is count, not_in
            op = max((o for o in FILTERS if a["operator"].endswith(f"_{o}") or a["operator"] == o), key=len, default=None)
            test = {"field": a.get("field") or (a["operator"][: -len(op) - 1] if op else None), "op": op, "value": a.get("value")}
        if test is not None:
            constraint = parse_filter(test, kinds, kind)
        analyses.append(Analysis(name, kind, params, constraint))
        paths |= {f"{name}.{f}": k for f, k in kinds.items()}

    def known(path):
        if path not in paths:
            raise QuerySpecError(f"unknown path {path!r}", known=sorted(paths))
        return path

    geometry = bool(raw.get("include_geometry", False))
    group_by = tuple(known(p) for p in raw.get("group_by") or ())
    nested = [p for p in group_by if paths[p].startswith(("array<array", "struct", "map"))]
    if nested:
        raise QuerySpecError(f"cannot group by {nested[0]!r}: its values are lists of lists", known=sorted(paths))
    asked_made = raw.get("aggregates", raw.get("aggregate")) or ()
    if isinstance(asked_made, dict):
        # the object form: a value a row over the nodes of a step
        if group_by or raw.get("having") or raw.get("order_by"):
            raise QuerySpecError("group_by, having and order_by need a list of aggregates")
        if not all(isinstance(d, dict) for d in asked_made.values()):
            raise QuerySpecError("an aggregate is an object with op and of")
        asked_made = [{"function": d.get("op"), "field": d.get("of"), "as": k} for k, d in asked_made.items()]
        asked_made = [a | {"field": f"{a['field']}.id"} if a["field"] in names and a["field"] != start.name and a["function"] == "count" else a for a in asked_made]
    elif "aggregate" in raw and not group_by:
        raise QuerySpecError("a list of aggregates needs group_by", known=sorted(paths))
    made = []
    for a in asked_made:
        function, path = a.get("function") or a.get("op") or "count", a.get("field")
        if function not in FUNCTIONS or (path in (None, "*") and function != "count"):
            raise QuerySpecError(f"unknown aggregate {function!r}", known=list(FUNCTIONS))
        path = None if path in (None, "*") else known(path)
        if function in ("sum", "avg", "min", "max") and paths[path].removeprefix("array<").rstrip(">") not in NUMERIC:
            numbers = sorted(p for p, k in paths.items() if k.removeprefix("array<").rstrip(">") in NUMERIC)
            raise QuerySpecError(f"{function} needs a number, {path} is {paths[path]}", field=path, valid_fields=numbers)
        if not group_by and not (paths[path].startswith("array") if path else steps):
            raise QuerySpecError(f"without group_by, {function} works on a field of a step", known=sorted(p for p, k in paths.items() if k.startswith("array")))
        name = a.get("as") or (function if path is None else f"{function}_{path.replace('.', '_')}")
        if name in [m.name for m in made] or name in group_by:
            raise QuerySpecError(f"the name {name!r} is taken")
        made.append(Aggregate(function, path, name))
    grouped = bool(group_by)
    results = {**{g: paths[g] for g in group_by}, **{m.name: "double" for m in made}} if grouped else paths | {m.name: "double" for m in made}
    order = []
    for o in raw.get("order_by") or ():
        if o.get("field") not in results:
            raise QuerySpecError(f"cannot order by {o.get('field')!r}", known=sorted(results))
        way = o.get("direction", o.get("order", "asc"))
        if way not in ("asc", "desc"):
            raise QuerySpecError(f"the direction is asc or desc, not {way!r}")
        order.append((o["field"], way == "desc"))
    rank = raw.get("rank")
    if rank and (grouped or rank.get("by") not in results):
        raise QuerySpecError("rank takes a known path of an ungrouped query", known=sorted(results))
    returned = tuple(raw.get("return") or ())
    for p in returned:
        if p not in results:
            raise QuerySpecError(f"unknown path {p!r}", known=sorted(results))
        if not geometry and p.rsplit(".", 1)[-1] == "geometry":
            raise QuerySpecError("geometry is returned only with include_geometry")
    limit = raw.get("limit", DEFAULT_LIMIT)
    limit = int(limit) if isinstance(limit, str) and limit.isdecimal() else limit
    if not isinstance(limit, int) or isinstance(limit, bool) or limit < 1:
        raise QuerySpecError("limit is a whole number from 1 on")
    ids = raw["start"].get("ids")
    return QuerySpec(
        start.name, tuple(ids) if ids else None, filters, tuple(steps), tuple(analyses), group_by, tuple(made) if grouped else (), () if grouped else tuple(made),
        tuple(parse_filter(h, {m.name: "double" for m in made} | {g: paths[g] for g in group_by}, "the result") for h in raw.get("having") or ()),
        tuple(order), (rank["by"], rank.get("order", "desc") == "desc") if rank else None, min(limit, MAX_LIMIT), returned, geometry, paths,
    )
