"""python -m geoloom.cli --data DIR describe | types | relations | status | entities TYPE | entity TYPE ID | neighbors ID | query FILE | export DIR | ask NAME"""

from __future__ import annotations

import argparse
import json
import sys

from .errors import EngineError
from .graph import trade_graph
from .plans import catalogue
from .plans.compile import execute
from .provenance import query_provenance, status
from .session import session
from .sources.sinks import to_csv

QUESTIONS = ("poorest_access", "median_threshold_gap", "adjacent_contrast", "category_cv", "mode_gain", "children_underserved")


def run(spark, args) -> object:
    graph = trade_graph(spark, args.data)
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    if args.verb == "describe":
        return graph.catalog.describe()
    if args.verb == "types":
        return sorted(graph.catalog.nodes)
    if args.verb == "relations":
        return sorted(graph.catalog.relations)
    if args.verb == "status":
        return status(graph)
    if args.verb == "entities":
        return rows(graph.page(args.args[0], args.limit, args.offset))
    if args.verb == "entity":
        return graph.get_node(*args.args[:2])
    if args.verb == "neighbors":
        return rows(graph.neighbors(spark.createDataFrame([(args.args[0],)], "id string")).limit(args.limit))
    if args.verb == "query":
        raw = json.load(sys.stdin if args.args[0] == "-" else open(args.args[0]))
        return execute(graph, raw) | {"provenance": query_provenance(raw, graph.catalog)}
    if args.verb == "export":
        to_csv(graph, args.args[0])
        return {"written": args.args[0]}
    if args.verb == "ask" and args.args[0] in QUESTIONS:
        return rows(catalogue.queries()[args.args[0]](spark, args.data))
    raise EngineError(f"unknown verb or question {args.verb!r}", questions=QUESTIONS)


def main() -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--data", required=True)
    parser.add_argument("--limit", type=int, default=50)
    parser.add_argument("--offset", type=int, default=0)
    parser.add_argument("verb")
    parser.add_argument("args", nargs="*")
    args = parser.parse_args()
    try:
        print(json.dumps(run(session(), args), indent=2, default=str))
    except EngineError as error:
        print(json.dumps(error.payload(), default=str))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
