"""Cardinality estimates: candidate space, tree sampling, and stratified sampling where trees rarely succeed."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass

from ..plans.pattern import Pattern
from . import candidates, graph_sampling, tree_sampling
from .candidates import Neighborhood, Structure
from .graph import Graph


@dataclass(frozen=True)
class Options:
    ub_initial: int = graph_sampling.UB_INITIAL
    strata_ratio: float = graph_sampling.STRATA_RATIO
    structure: Structure = Structure.FOUR_CYCLES
    neighborhood: Neighborhood = Neighborhood.LABELS
    max_rounds: int | None = None
    tree_weight: str = "density"
    seed: int = 0


def estimate(graph: Graph, pattern: Pattern, options: Options = Options()) -> dict:
    """The estimate with what led to it and the seconds of each part. An empty candidate space means 0."""
    clock, times = time.perf_counter(), {}

    def lap(name: str) -> None:
        nonlocal clock
        now = time.perf_counter()
        times[name], clock = now - clock, now

    space = candidates.build(graph, pattern, options.structure, options.neighborhood, max_rounds=options.max_rounds)
    n_vertices, n_edges = space.sizes()
    lap("cs_build_s")
    found = {"cs_vertices": n_vertices, "cs_edges": n_edges, "trees": 0.0, "trials": 0, "successes": 0, "method": "empty", "estimate": 0.0}
    tree = tree_sampling.spanning_tree(space, options.tree_weight) if n_vertices else None
    lap("tree_count_s")
    if tree is not None and pattern.size == 1:
        found |= {"estimate": float(n_vertices), "method": "exact", "trees": float(n_vertices)}
    elif tree is not None:
        trees = tree_sampling.estimate(graph, space, tree, options.seed)
        found |= {"estimate": trees.estimate, "trees": trees.total, "trials": trees.trials, "successes": trees.successes, "method": "trees" if trees.total else "empty"}
        lap("tree_sample_s")
        if trees.gave_up:
            ub = graph_sampling.budget(pattern.size, trees.successes, options.ub_initial)
            found |= {"estimate": graph_sampling.estimate(space, ub, seed=options.seed, ratio=options.strata_ratio).first()[0], "method": "strata"}
            lap("graph_sample_s")
    return found | times | {"query_s": sum(times.values())}


class Estimator:
    """A loaded graph that answers prefixes given as ``{num_vertices, vertices, edges}``."""

    def __init__(self, graph: Graph | None = None, options: Options = Options()):
        self.graph, self.options = graph, options

    def load(self, graph: Graph) -> None:
        self.graph = graph

    def set_option(self, **changes) -> None:
        """``num_threads`` is accepted and has no use: the cluster decides."""
        changes.pop("num_threads", None)
        if "structure_filter" in changes:
            changes["structure"] = Structure(changes.pop("structure_filter"))
        self.options = Options(**{**self.options.__dict__, **changes})

    def is_loaded(self) -> bool:
        return self.graph is not None

    def num_vertices(self) -> int:
        return self.graph.vertices.count() if self.graph else 0

    def num_edges(self) -> int:
        """Directed edges."""
        return self.graph.edges.count() if self.graph else 0

    def estimate_prefix(self, prefix: Mapping | Pattern) -> dict:
        if self.graph is None:
            raise RuntimeError("no graph is loaded")
        return estimate(self.graph, prefix if isinstance(prefix, Pattern) else of_payload(prefix), self.options)


def of_payload(payload: Mapping) -> Pattern:
    """Pattern of a prefix payload; vertices are given by position, edge labels default to 0."""
    labels = tuple(int(v["label"]) for v in sorted(payload["vertices"], key=lambda v: v["id"]))
    edges = {(min(e["source"], e["target"]), max(e["source"], e["target"])): int(e.get("label") or 0) for e in payload["edges"]}
    return Pattern(labels, tuple((a, b, x) for (a, b), x in sorted(edges.items())))


def payload_of(pattern: Pattern) -> dict:
    return {"num_vertices": pattern.size, "num_edges": len(pattern.edges), "vertices": [{"id": i, "label": x} for i, x in enumerate(pattern.labels)], "edges": [{"source": a, "target": b, "label": e} for a, b, e in pattern.edges]}
