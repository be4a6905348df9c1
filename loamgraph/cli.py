"""Command line: ``python -m loamgraph.cli ROOT cold list|show|schema|count ... | hot stats|nodes|node|by-keys|neighbors|subgraph ... | catalog | summary``."""

from __future__ import annotations

import argparse
import json
import sys

from loamgraph.operators.lookup import nodes_of_label, parse_key_value
from loamgraph.service import Engine
from loamgraph.session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loamgraph")
    p.add_argument("root")
    p.add_argument("--json", action="store_true", help="rows as JSON lines")
    sub = p.add_subparsers(dest="area", required=True)
    cold = sub.add_parser("cold").add_subparsers(dest="what", required=True)
    cold.add_parser("list").add_argument("--prefix", default="")
    for name in ("show", "schema", "count"):
        c = cold.add_parser(name)
        c.add_argument("table")
        c.add_argument("--limit", type=int, default=20, help="0: all")
    hot = sub.add_parser("hot").add_subparsers(dest="what", required=True)
    hot.add_parser("stats")
    n = hot.add_parser("nodes")
    n.add_argument("label")
    n.add_argument("--limit", type=int, default=20)
    hot.add_parser("node").add_argument("id")
    k = hot.add_parser("by-keys")
    k.add_argument("type")
    k.add_argument("keys", nargs="+", help="key=value")
    b = hot.add_parser("neighbors")
    b.add_argument("id")
    b.add_argument("--types")
    b.add_argument("--direction", default="both")
    b.add_argument("--limit", type=int, default=20)
    g = hot.add_parser("subgraph")
    g.add_argument("id")
    g.add_argument("--types")
    g.add_argument("--depth", type=int, default=2, help="0: the node alone")
    g.add_argument("--nodes", type=int, default=100)
    g.add_argument("--edges", type=int, default=200)
    sub.add_parser("catalog")
    sub.add_parser("summary")
    return p


def run(args: argparse.Namespace, engine: Engine) -> list:
    """Rows to print."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731  what a terminal shows
    if args.area == "cold":
        if args.what == "list":
            return [{"table": t, "columns": [c for c, _, _ in cols]} for t, cols in engine.tables(args.prefix)]
        if args.what == "schema":
            return [{"column": c, "type": t, "nullable": n} for c, t, n in engine.schema(args.table)]
        return [{"rows": engine.row_count(args.table)}] if args.what == "count" else rows(engine.show(args.table, args.limit))
    if args.area == "catalog":
        return engine.sync.known_entities()
    if args.area == "summary" or args.what == "stats":
        return [engine.status()]
    if args.what == "nodes":
        return rows(nodes_of_label(engine.views()[0], args.label, args.limit))
    if args.what == "node":
        return [engine.node(args.id)]
    if args.what == "by-keys":
        found = engine.node_by_keys(args.type, dict(map(parse_key_value, args.keys)))
        return [found] if found else []
    if args.what == "neighbors":
        return rows(engine.neighbours(args.id, args.types, args.direction, args.limit))
    found = engine.subgraph(args.id, args.types, args.depth, args.nodes, args.edges)
    return rows(found.nodes) + rows(found.edges)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    for row in run(args, Engine(local_session(app="loamgraph-cli"), args.root)):
        print(json.dumps(row, default=str) if args.json else "  ".join(f"{k}={v}" for k, v in row.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
