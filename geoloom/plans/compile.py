"""From a query document to one lazy DataFrame.

Start rows are filtered first; a traversal becomes a join of (start, target) pairs, of which only what the
query names is kept: a count, a list of one field, or a semi or anti join for mere existence.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import NUMERIC, predicate
from ..graph import PropertyGraph
from .spec import QuerySpec, parse

#: Analyses by kind: (graph, origins with id, parameters) -> id and a column a field.
ANALYSES: dict[str, Callable[[PropertyGraph, DataFrame, dict], DataFrame]] = {}


def q(name: str) -> str:
    return f"`{name}`"


def compile_query(graph: PropertyGraph, raw: dict, limited: bool = True) -> DataFrame:
    spec = parse(raw, graph.catalog)
    rows = _start(graph, spec)
    rows, pairs = _traverse(graph, spec, rows)
    rows = _analyse(graph, spec, rows)
    out = _group(spec, rows, pairs) if spec.group_by else _ungrouped(spec, rows)
    return out.limit(spec.limit) if limited else out


def execute(graph: PropertyGraph, raw: dict) -> dict:
    """Rows, and whether more existed than the limit."""
    spec = parse(raw, graph.catalog)
    rows = [r.asDict(recursive=True) for r in compile_query(graph, raw, limited=False).limit(spec.limit + 1).collect()]
    return {"rows": rows[: spec.limit], "truncated": len(rows) > spec.limit, "count": min(len(rows), spec.limit)}


def _start(graph: PropertyGraph, spec: QuerySpec) -> DataFrame:
    kinds = graph.catalog.node(spec.start).kinds()
    rows = graph.by_ids(spec.start, list(spec.ids)) if spec.ids else graph.nodes(spec.start)
    for f in spec.filters:
        rows = rows.where(predicate(F.lit(spec.start) if f.field == "type" else F.col(f.field), kinds[f.field], f.op, f.value, total=False))
    return rows.select("_ord", *(F.lit(spec.start).alias("type") if k == "type" else F.col(k) for k in kinds))


def _referenced(spec: QuerySpec, step: str) -> set[str]:
    used = {*spec.group_by, *spec.returned, *(a.path for a in (*spec.aggregates, *spec.row_aggregates) if a.path)}
    used |= {o for o, _ in spec.order_by} | ({spec.rank[0]} if spec.rank else set())
    if not spec.group_by and not spec.returned:
        used.add(f"{step}.count")
    return {p.split(".", 1)[1] for p in used if p.startswith(f"{step}.")}


def _targets(graph: PropertyGraph, step) -> DataFrame:
    """What a step may lead to, filtered: one type, or several with the fields of the first (null where a type lacks one)."""
    kinds = graph.catalog.node(step.targets[0]).kinds()
    parts = []
    for name in step.targets:
        rows = graph.nodes(name).withColumn("_type", F.lit(name))
        own = graph.catalog.node(name).kinds()
        cols = [(F.col(k) if k in own else F.lit(None)).cast(t).alias(k) for k, t in kinds.items() if k not in ("id", "type")]
        rows = rows.select("id", "_ord", "_type", *cols) if len(step.targets) > 1 else rows
        for f in step.filters:
            rows = rows.where(predicate(F.col("_type") if f.field == "type" else F.col(f.field), kinds[f.field], f.op, f.value, total=False))
        parts.append(rows)
    return reduce(DataFrame.unionByName, parts)


def _traverse(graph: PropertyGraph, spec: QuerySpec, rows: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The rows that are left, with counts and lists, and each step's distinct (start, target) pairs. Under ``group_by`` no list is
    built: groups take their targets from the pairs."""
    pairs: dict[str, DataFrame] = {}
    for step in spec.steps:
        kinds = graph.catalog.node(step.targets[0]).kinds()
        target = _targets(graph, step)
        edges = graph.edges(step.relation)
        origin = pairs[step.origin].select("_start", F.col("_node").alias("src")) if step.origin else rows.select(F.col("id").alias("_start"), F.col("id").alias("src")).distinct()
        wanted = _referenced(spec, step.name)
        fields = [k for k in kinds if k in wanted and k not in ("id", "type")]
        held = target.select(F.col("id").alias("_node"), F.col("_ord").alias("_tord"), F.col("_type"), *(F.col(f).alias(f"_f_{f}") for f in fields))
        edges = edges.select("src", F.col("dst").alias("_node"))
        if step.filters:  # fewer pairs to tell apart
            found = origin.join(edges.join(held.select("_node"), "_node", "left_semi"), "src").select("_start", "_node").distinct().join(held, "_node")
        else:
            found = origin.join(edges, "src").select("_start", "_node").distinct().join(held, "_node")
        pairs[step.name] = found
        low, high = step.min_count, step.max_count
        if "count" not in wanted and (low, high) == (1, None):
            rows = rows.join(found.select(F.col("_start").alias("id")), "id", "left_semi")
        elif "count" not in wanted and not low and high == 0:
            rows = rows.join(found.select(F.col("_start").alias("id")), "id", "left_anti")
        elif "count" in wanted or low or high is not None:
            counts = found.groupBy(F.col("_start").alias("id")).agg(F.count("*").alias(f"{step.name}.count"))
            rows = rows.join(counts, "id", "left").withColumn(f"{step.name}.count", F.coalesce(F.col(q(f"{step.name}.count")), F.lit(0)))
            if low:
                rows = rows.where(F.col(q(f"{step.name}.count")) >= low)
            if high is not None:
                rows = rows.where(F.col(q(f"{step.name}.count")) <= high)
        lists = [k for k in kinds if k in wanted]
        if lists and not spec.group_by:
            value = {"id": F.col("_node"), "type": F.col("_type")}
            packed = F.array_sort(F.collect_list(F.struct("_tord", "_node", *(value.get(k, F.col(f"_f_{k}") if k in fields else None).alias(k) for k in lists))))
            collected = found.groupBy(F.col("_start").alias("id")).agg(packed.alias("_l"))
            collected = collected.select("id", *(F.col("_l")[k].alias(f"{step.name}.{k}") for k in lists))
            rows = rows.join(collected, "id", "left")
            for k in lists:
                name = f"{step.name}.{k}"
                rows = rows.withColumn(name, F.coalesce(F.col(q(name)), F.array().cast(collected.schema[name].dataType)))
    return rows, pairs


def _analyse(graph: PropertyGraph, spec: QuerySpec, rows: DataFrame) -> DataFrame:
    """Each distinct (kind, parameters) is computed once, for all rows that are left at once."""
    done: dict[tuple, DataFrame] = {}
    for a in spec.analyses:
        key = (a.kind, tuple(sorted(a.params.items())))
        if key not in done:
            done[key] = (graph.analyses or ANALYSES)[a.kind](graph, rows.select("id").distinct(), a.params)
        fields = graph.catalog.analyses[a.kind]["fields"]
        rows = rows.join(done[key].select("id", *(F.col(q(f)).alias(f"{a.name}.{f}") for f in fields)), "id", "left")
        if a.constraint:
            path = f"{a.name}.{a.constraint.field}"
            rows = rows.where(predicate(F.col(q(path)), spec.paths[path], a.constraint.op, a.constraint.value, total=False))
    return rows


def _column(spec: QuerySpec, path: str) -> Column:
    return F.col(q(path.removeprefix(f"{spec.start}.")))


def _group(spec: QuerySpec, rows: DataFrame, pairs: dict[str, DataFrame]) -> DataFrame:
    """A step's field among the keys gives a row for each target, one key after the other; under an aggregate it gives all targets for
    each membership. Targets are aggregated to one row a start before they meet the groups; distinct values are counted from pairs."""
    keyed, keys = rows, [f"_k{i}" for i in range(len(spec.group_by))]

    def step_of(path: str | None) -> tuple[str, str] | None:
        head, _, tail = (path or "").partition(".")
        return (head, tail) if head in pairs and path and spec.paths[path].startswith("array") else None

    def values(step: str, field: str) -> tuple[DataFrame, Column]:
        return pairs[step], {"id": F.col("_node"), "type": F.col("_type")}.get(field, F.col(f"_f_{field}"))

    for key, name in zip(spec.group_by, keys, strict=True):
        if found := step_of(key):
            df, value = values(*found)
            keyed = keyed.join(df.select(F.col("_start").alias("id"), value.alias(name)), "id")
        else:
            keyed = keyed.withColumn(name, F.explode(_column(spec, key)) if spec.paths[key].startswith("array") else _column(spec, key))
    members = keyed
    for step in pairs:
        made = []
        for a in spec.aggregates:
            if (found := step_of(a.path)) and found[0] == step and a.function != "count_distinct":
                value = values(*found)[1]
                made.append({"count": F.count(value), "sum": F.sum(value.cast("double")), "avg": F.struct(F.sum(value.cast("double")).alias("s"), F.count(value).alias("n")), "min": F.min(value), "max": F.max(value)}[a.function].alias(f"_a_{a.name}"))
        if made:
            keyed = keyed.join(pairs[step].groupBy(F.col("_start").alias("id")).agg(*made), "id", "left")

    def made(a):
        if a.path is None:
            return F.count("*")
        if step_of(a.path):
            part = F.col(q(f"_a_{a.name}"))
            if a.function == "avg":
                return F.sum(part["s"]) / F.nullif(F.sum(part["n"]), F.lit(0))
            return {"count": lambda: F.sum(F.coalesce(part, F.lit(0))).cast("long"), "sum": lambda: F.sum(part), "min": lambda: F.min(part), "max": lambda: F.max(part)}[a.function]()
        col, listed = _column(spec, a.path), spec.paths[a.path].startswith("array")
        if not listed:
            return {"count": F.count, "count_distinct": F.countDistinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.function](col)
        some = F.filter(col, lambda x: x.isNotNull())  # a list that an analysis gives: some categories
        total = lambda: F.sum(F.when(F.size(some) > 0, F.aggregate(F.transform(some, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)))
        return {
            "count": lambda: F.sum(F.size(some)).cast("long"),
            "count_distinct": lambda: F.size(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(some))))).cast("long"),
            "sum": total,
            "avg": lambda: total() / F.nullif(F.sum(F.size(some)), F.lit(0)),
            "min": lambda: F.min(F.array_min(some)),
            "max": lambda: F.max(F.array_max(some)),
        }[a.function]()

    distinct = [a for a in spec.aggregates if a.function == "count_distinct" and step_of(a.path)]
    plain = [a for a in spec.aggregates or (_count_all(),) if a not in distinct]
    out = keyed.groupBy(*keys).agg(*(made(a).alias(a.name) for a in plain)) if plain else keyed.select(*keys).distinct()
    for a in distinct:
        df, value = values(*step_of(a.path))
        told = members.select("id", *keys).join(df.select(F.col("_start").alias("id"), value.alias("_v")), "id")
        told = told.groupBy(*(F.col(k).alias(f"{k}d") for k in keys)).agg(F.countDistinct("_v").alias("_n"))
        same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"{k}d")) for k in keys))
        out = out.join(told, same, "left").withColumn(a.name, F.coalesce("_n", F.lit(0))).drop("_n", *(f"{k}d" for k in keys))
    out = out.select(*keys, *(F.col(q(a.name)) for a in spec.aggregates or (_count_all(),)))
    out = out.withColumnsRenamed({f"_k{i}": key for i, key in enumerate(spec.group_by)})
    for h in spec.having:
        out = out.where(predicate(F.col(q(h.field)), dict(out.dtypes)[h.field], h.op, h.value, total=False))
    if spec.order_by:
        ways = [F.col(q(f)).desc_nulls_last() if down else F.col(q(f)).asc_nulls_last() for f, down in spec.order_by]
        out = out.orderBy(*ways, *(F.col(q(g)).asc_nulls_last() for g in spec.group_by))
    return out.select(*(F.col(q(c)) for c in (spec.returned or out.columns)))


def _count_all():
    from .spec import Aggregate

    return Aggregate("count", None, "count")


def _ungrouped(spec: QuerySpec, rows: DataFrame) -> DataFrame:
    for a in spec.row_aggregates:
        col = _column(spec, a.path or f"{spec.steps[0].name}.id")
        some = F.filter(col, lambda x: x.isNotNull())
        total = F.aggregate(F.transform(some, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
        size = F.nullif(F.size(some), F.lit(0))
        value = {"count": lambda: F.size(some), "count_distinct": lambda: F.size(F.array_distinct(some)), "sum": lambda: F.when(F.size(some) > 0, total), "avg": lambda: total / size, "min": lambda: F.array_min(some), "max": lambda: F.array_max(some)}[a.function]()
        rows = rows.withColumn(a.name, value)
    ways = []
    if spec.rank:
        path, down = spec.rank
        col = _column(spec, path)
        number = col if dict(rows.dtypes)[path.removeprefix(f"{spec.start}.")] in NUMERIC else F.lit(None).cast("double")
        # rows without a number come first where the largest come first, and last otherwise
        ways.append(number.desc_nulls_first() if down else number.asc_nulls_last())
    ways += [_column(spec, f).desc_nulls_last() if down else _column(spec, f).asc_nulls_last() for f, down in spec.order_by]
    rows = rows.orderBy(*ways, "_ord")
    if spec.returned:
        return rows.select(*(_column(spec, p).alias(p) for p in spec.returned))
    hidden = ("type",) if spec.include_geometry else ("geometry", "type")
    shown = [c for c in rows.columns if not c.startswith("_") and "." not in c and c not in hidden]
    counts = [F.col(q(f"{s.name}.count")).alias(f"{s.name}_count") for s in spec.steps]
    fields = [F.col(q(c)).alias(c) for c in rows.columns if any(c.startswith(f"{a.name}.") for a in spec.analyses)]
    return rows.select(*(F.col(q(c)) for c in shown), *counts, *fields)
