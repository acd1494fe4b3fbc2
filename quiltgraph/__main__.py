"""``python -m quiltgraph build-index|estimate|plan|count``"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import candidates, estimator, matcher
from .service import Service
from .sources import graph_text, index_store


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quiltgraph")
    parser.add_argument("command", choices=("build-index", "estimate", "plan", "count"))
    parser.add_argument("-d", "--data", required=True, help="graph file")
    parser.add_argument("-q", "--query", nargs="*", default=[], help="pattern files")
    parser.add_argument("--query-list", help="a file of pattern file names")
    parser.add_argument("-x", "--structure", choices=("X", "3", "4"), default="4")
    parser.add_argument("-K", "--ub-initial", type=int, default=100_000)
    parser.add_argument("--index-dir")
    parser.add_argument("--beam-width", type=int)
    parser.add_argument("--seed", type=int, default=0)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quiltgraph").getOrCreate()
    graph = graph_text.read(spark, args.data)
    if args.command == "build-index":
        if not args.index_dir:
            parser.error("build-index needs --index-dir")
        index_store.save(graph, args.index_dir, four_cycles=args.structure == "4")
        print(json.dumps(index_store.manifest(spark, args.index_dir)))
        return 0
    graph = index_store.load(spark, args.index_dir).graph if args.index_dir else graph.stored("cli")  # with the motifs that were stored
    options = estimator.Options(ub_initial=args.ub_initial, structure=candidates.Structure(args.structure), seed=args.seed)
    total = 0.0
    for path in [*args.query, *(graph_text.query_list(args.query_list) if args.query_list else [])]:
        pattern = graph_text.read_pattern(path)
        if args.command == "count":
            found = {"count": matcher.count(graph, pattern).first()[0]}
        elif args.command == "plan":
            service = Service(spark, options)
            service.register("data", graph)
            query = {"vertices": [{"id": i, "label": x} for i, x in enumerate(pattern.labels)], "edges": [{"source": a, "target": b, "label": e} for a, b, e in pattern.edges]}
            found = service.result(service.create_session("data", query, args.beam_width).id)
        else:
            found = estimator.estimate(graph, pattern, options)
            total += found["query_s"]
        print(json.dumps({"query": path} | found))
    if args.command == "estimate":
        print(json.dumps({"total_s": total}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
