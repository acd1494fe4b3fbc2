"""Exact embeddings as an explicit chain of joins along a match order.

An embedding is injective, keeps vertex labels and has every pattern edge with its label; other edges
do not matter, and images under the pattern's symmetries count separately.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import orders
from ..plans.pattern import Pattern
from .candidates import CandidateSpace
from .graph import Graph


def match(graph: Graph, pattern: Pattern, order: tuple[int, ...] | None = None, space: CandidateSpace | None = None) -> DataFrame:
    """``(v0, v1, ...)``: every embedding, joined in ``order`` (default: the first connected one).

    Each step joins the candidate edges of one pattern edge to an earlier vertex, then closes the other
    edges to earlier vertices by semi-joins. Vertices are tested for equality only where labels allow it.
    Without a candidate space the data's edges of the right labels stand in for candidates.
    """
    order = orders.exact(pattern)[0] if order is None and pattern.size <= orders.EXACT_UP_TO else orders.generate(pattern)[0] if order is None else order
    graph, codes = graph.part(pattern), None
    if space is not None:
        first = space.vertices.where(F.col("qv") == order[0]).select(F.col("v").alias(f"v{order[0]}"))
    else:
        first = graph.vertices.where(F.col("raw_label") == pattern.labels[order[0]]).select(F.col("vid").alias(f"v{order[0]}"))
        codes = {r.raw_label: r.label for r in graph.vertices.select("raw_label", "label").where(F.col("raw_label").isin(*set(pattern.labels))).distinct().collect()}

    def step(a: int, b: int) -> DataFrame:
        if space is not None:
            found = space.edges.where((F.col("qs") == a) & (F.col("qd") == b))
        else:
            same = lambda c, v: F.col(c) == F.lit(codes.get(pattern.labels[v], -1))
            found = graph.edges.where(same("src_label", a) & same("dst_label", b) & (F.col("elabel") == pattern.edge_label[a, b]))
        return found.select(F.col("src").alias(f"v{a}"), F.col("dst").alias(f"v{b}"))

    found = first
    for i, b in enumerate(order[1:], 1):
        back = [a for a in order[:i] if a in pattern.neighbors[b]]
        found = found.join(step(back[0], b), f"v{back[0]}")
        for a in order[:i]:
            if pattern.labels[a] == pattern.labels[b] and a not in pattern.neighbors[b]:
                found = found.where(F.col(f"v{a}") != F.col(f"v{b}"))
        for a in back[1:]:
            found = found.join(step(a, b), [f"v{a}", f"v{b}"], "left_semi")
    return found.select(*(f"v{v}" for v in range(pattern.size)))


def count(graph: Graph, pattern: Pattern, order: tuple[int, ...] | None = None, space: CandidateSpace | None = None) -> DataFrame:
    """One row: the number of embeddings."""
    return match(graph, pattern, order, space).agg(F.count("*").alias("n"))
