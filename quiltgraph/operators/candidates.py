"""Candidate spaces: which data vertices and edges can still stand for those of a pattern.

    cs_vertex(qv int, v bigint)
    cs_edge(qs int, qd int, src bigint, dst bigint)      -- both directions of every pattern edge

Every filter is a semi-join or a grouped count over all pattern vertices and edges at once; the
pattern's own tables have as many rows as the pattern has parts and are broadcast. Filters only remove
what no embedding uses, so any number of rounds is sound; the default runs to the fixpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pattern import Pattern
from ..storage import delete, written
from . import matching, motifs
from .graph import Graph


class Structure(Enum):
    """Motifs that edges are checked against."""

    NONE = "X"
    TRIANGLES = "3"
    FOUR_CYCLES = "4"  # and triangles


class Neighborhood(Enum):
    """How the surroundings of a vertex are checked."""

    LABELS = "labels"
    VERTEX_MATCHING = "vertex matching"
    EDGE_MATCHING = "edge matching"


@dataclass
class CandidateSpace:
    pattern: Pattern
    vertices: DataFrame
    edges: DataFrame

    def sizes(self) -> tuple[int, int]:
        """Candidate vertices, and candidate edges with each undirected pattern edge counted once."""
        return self.vertices.count(), self.edges.where("qs < qd").count()


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table with a few rows for each part of a pattern, to be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def root_of(graph: Graph, pattern: Pattern) -> int:
    """The pattern vertex whose label is rarest in the data; ties go to the last."""
    counts = {r.label: r.n for r in graph.labelled.where(F.col("raw_label").isin(*set(pattern.labels))).groupBy(F.col("raw_label").alias("label")).agg(F.count("*").alias("n")).collect()}
    return min(range(pattern.size), key=lambda v: (counts.get(pattern.labels[v], 0), -v))


def vertex_candidates(graph: Graph, pattern: Pattern, cores: DataFrame | None = None) -> DataFrame:
    """``(qv, v)`` by label, degree and, given ``(vid, core)``, core number. Labels the data lacks give none."""
    rows = [(v, pattern.labels[v], len(pattern.neighbors[v]), pattern.cores[v]) for v in range(pattern.size)]
    data = graph.part(pattern).vertices
    wanted = small(data.sparkSession, rows, "qv int, raw_label int, q_deg int, q_core int")
    data = data if cores is None else data.join(cores, "vid")
    found = data.where(F.col("raw_label").isin(*set(pattern.labels))).join(wanted, "raw_label").where("deg >= q_deg")
    return (found if cores is None else found.where("core >= q_core")).select("qv", F.col("vid").alias("v"))


def edge_candidates(graph: Graph, pattern: Pattern, vertices: DataFrame) -> DataFrame:
    """``(qs, qd, src, dst)``: data edges with the label of a pattern edge whose ends are candidates."""
    graph = graph.part(pattern)
    rows = [(a, b, e, pattern.labels[a], pattern.labels[b]) for (a, b), e in sorted(pattern.edge_label.items())]
    wanted = small(graph.edges.sparkSession, rows, "qs int, qd int, elabel int, s_raw int, d_raw int")
    codes = F.broadcast(graph.vertices.where(F.col("raw_label").isin(*set(pattern.labels))).select("raw_label", "label").distinct())  # a row for each label of the pattern
    wanted = wanted.join(codes.select(F.col("raw_label").alias("s_raw"), F.col("label").alias("src_label")), "s_raw").join(codes.select(F.col("raw_label").alias("d_raw"), F.col("label").alias("dst_label")), "d_raw")
    found = graph.edges.join(F.broadcast(wanted.select("qs", "qd", "elabel", "src_label", "dst_label")), ["elabel", "src_label", "dst_label"]).select("qs", "qd", "src", "dst")
    return alive(found, vertices)


def alive(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Of candidate edges, which go both ways, those whose two ends are candidates; looked at one way and turned."""
    heads = vertices.select(F.col("qv").alias("qs"), F.col("v").alias("src"))
    tails = vertices.select(F.col("qv").alias("qd"), F.col("v").alias("dst"))
    found = edges.where("qs < qd").join(heads, ["qs", "src"], "left_semi").join(tails, ["qd", "dst"], "left_semi")
    there, back = F.struct("qs", "qd", "src", "dst"), F.struct(F.col("qd").alias("qs"), F.col("qs").alias("qd"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return found.select(F.explode(F.array(there, back)).alias("e")).select("e.*")


def support_filter(pattern: Pattern, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates with a candidate edge for every pattern edge at their vertex."""
    needed = small(vertices.sparkSession, [(v, sum(1 << u for u in pattern.neighbors[v])) for v in range(pattern.size)], "qv int, needed bigint")
    if pattern.size == 1:
        return vertices
    found = edges.groupBy(F.col("qs").alias("qv"), F.col("src").alias("v")).agg(F.bit_or(F.expr("shiftleft(1L, qd)")).alias("has"))
    return found.join(needed, "qv").where("has = needed").select("qv", "v")


def neighbor_filter(pattern: Pattern, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates that have, of every label, at least as many candidate neighbours as their vertex has neighbours."""
    if pattern.size == 1:
        return vertices
    spark = vertices.sparkSession
    places = {v: sorted(label for u, label in pattern.neighbor_labels if u == v) for v in range(pattern.size)}  # a bit for each label next to a vertex
    rows = [(a, b, 1 << places[a].index(pattern.labels[b]), pattern.neighbor_labels[a, pattern.labels[b]]) for a, b in pattern.edge_label]
    wanted = lambda many: small(spark, [r for r in rows if (r[3] > 1) == many], "qs int, qd int, bit bigint, needed int")
    # one neighbour of a label needs no count, so a row leaves each task for a candidate, not for an edge
    seen = edges.join(wanted(False), ["qs", "qd"]).select("qs", "src", "bit")
    if any(r[3] > 1 for r in rows):
        counted = edges.join(wanted(True), ["qs", "qd"]).groupBy("qs", "src", "bit", "needed").agg(F.count_distinct("dst").alias("n"))
        seen = seen.unionByName(counted.where("n >= needed").select("qs", "src", "bit"))
    all_of = small(spark, [(v, (1 << len(places[v])) - 1) for v in range(pattern.size)], "qs int, needed bigint")
    full = seen.groupBy("qs", "src").agg(F.bit_or("bit").alias("has")).join(all_of, "qs").where("has = needed")
    return full.select(F.col("qs").alias("qv"), F.col("src").alias("v"))


def near_triangles(pattern: Pattern, edges: DataFrame, triangles: DataFrame) -> DataFrame:
    """Candidate edges of pattern edges in a triangle that are in one of the data; written."""
    closable = small(edges.sparkSession, sorted({t[:2] for t in pattern.triangles}), "qs int, qd int")
    return written(edges.join(closable, ["qs", "qd"], "left_semi").join(triangles, ["src", "dst"], "left_semi").select("qs", "qd", "src", "dst"), "near")


def triangle_filter(pattern: Pattern, edges: DataFrame, triangles: DataFrame, support: bool = True, near: DataFrame | None = None) -> DataFrame:
    """Candidate edges with, for every pattern triangle through their edge, a triangle of candidate edges.

    ``triangles(src, dst, w)`` are those of the data, found by degree order, so no hub's edges are joined
    with each other here, and only edges in one (``near``, see :func:`near_triangles`) are joined with them.
    With ``support`` an edge also needs as many of them as its pattern edge has, which third vertices of
    unlike labels are already.
    """
    if not pattern.triangles:
        return edges
    spark = edges.sparkSession
    near = near_triangles(pattern, edges, triangles) if near is None else near
    counts = {(a, b): sum(t[:2] == (a, b) for t in pattern.triangles) for a, b in pattern.edge_label}
    turns = small(spark, list(pattern.triangles), "qs int, qd int, qw int")
    many = small(spark, [(a, b, n) for (a, b), n in counts.items() if n], "qs int, qd int, needed int")
    to_w = near.select(F.col("qs"), F.col("qd").alias("qw"), "src", F.col("dst").alias("w"))
    from_w = near.select(F.col("qs").alias("qd"), F.col("qd").alias("qw"), F.col("src").alias("dst"), F.col("dst").alias("w"))
    closed = near.join(turns, ["qs", "qd"]).join(triangles, ["src", "dst"]).join(to_w, ["qs", "qw", "src", "w"], "left_semi").join(from_w, ["qd", "qw", "dst", "w"], "left_semi")
    kept = closed.groupBy("qs", "qd", "src", "dst").agg(F.count_distinct("qw").alias("n")).join(many, ["qs", "qd"]).where("n = needed")
    if support and alike_thirds(pattern):
        kept = kept.drop("n").join(motifs.support_of(triangles), ["src", "dst"]).where("n >= needed")
    kept = kept.select("qs", "qd", "src", "dst")
    if not (free := [pair for pair, n in counts.items() if not n]):
        return kept
    return kept.unionByName(edges.join(small(spark, free, "qs int, qd int"), ["qs", "qd"], "left_semi").select("qs", "qd", "src", "dst"))


def alike_thirds(pattern: Pattern) -> bool:
    """Whether an edge of the pattern has two triangles whose third vertices are of one label."""
    thirds = [(a, b, pattern.labels[w]) for a, b, w in pattern.triangles]
    return len(set(thirds)) < len(thirds)


def four_cycle_filter(pattern: Pattern, edges: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """Candidate edges with, for every pattern four-cycle through their edge, a cycle of candidate edges.

    A diagonal of the pattern's cycle must be a candidate edge too. Given the data's four-cycles
    ``cycles(src, dst, x, y, ...)``, of an index, they are looked up by edge; without, the cycles are joined
    from candidate edges, which takes a hub's candidate edges times those of its neighbours.
    """
    if not pattern.four_cycles:
        return edges
    spark, of_pattern = edges.sparkSession, list(pattern.four_cycles)
    rings = small(spark, [(i, *c) for i, c in enumerate(of_pattern)], "ring int, qs int, qd int, qx int, qy int, sx boolean, dy boolean")
    many = small(spark, [(a, b, sum(c[:2] == (a, b) for c in of_pattern)) for a, b in pattern.edge_label], "qs int, qd int, needed int")
    step = lambda qa, qb, a, b: edges.select(F.col("qs").alias(qa), F.col("qd").alias(qb), F.col("src").alias(a), F.col("dst").alias(b))
    found = edges.join(rings, ["qs", "qd"])
    if cycles is not None:
        found = found.join(cycles.select("src", "dst", "x", "y"), ["src", "dst"]).join(step("qd", "qx", "dst", "x"), ["qd", "qx", "dst", "x"], "left_semi")
    else:
        found = found.join(step("qd", "qx", "dst", "x"), ["qd", "qx", "dst"]).where("x <> src")
    if any(c[4] for c in of_pattern):
        plain = found.where("not sx")
        found = found.where("sx").join(step("qs", "qx", "src", "x"), ["qs", "qx", "src", "x"], "left_semi").unionByName(plain)
    if cycles is not None:
        found = found.join(step("qs", "qy", "src", "y"), ["qs", "qy", "src", "y"], "left_semi")
    else:
        found = found.join(step("qs", "qy", "src", "y"), ["qs", "qy", "src"]).where("y <> dst")
    found = found.join(step("qx", "qy", "x", "y"), ["qx", "qy", "x", "y"], "left_semi")
    if any(c[5] for c in of_pattern):
        plain = found.where("not dy")
        found = found.where("dy").join(step("qd", "qy", "dst", "y"), ["qd", "qy", "dst", "y"], "left_semi").unionByName(plain)
    counted = found.groupBy("qs", "qd", "src", "dst").agg(F.count_distinct("ring").alias("n"))
    return edges.join(many, ["qs", "qd"]).join(counted, ["qs", "qd", "src", "dst"], "left").where("coalesce(n, 0) = needed").select("qs", "qd", "src", "dst")


def both_ways(edges: DataFrame) -> DataFrame:
    """Candidate edges whose reverse is one as well."""
    back = edges.select(F.col("qd").alias("qs"), F.col("qs").alias("qd"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["qs", "qd", "src", "dst"], "left_semi")


def matching_filter(pattern: Pattern, vertices: DataFrame, edges: DataFrame, drop_edges: bool = False) -> DataFrame:
    """By bipartite matching between the pattern neighbours of a vertex and a candidate's neighbours.

    Returns candidates for which a matching covers the pattern neighbours; with ``drop_edges`` the
    candidate edges at them that are in some such matching. A candidate's shape is how many partners of each
    kind it has, up to as many as a pattern vertex has neighbours; each shape is judged once.
    """
    if pattern.size == 1:
        return edges if drop_edges else vertices
    neighbors, most = pattern.neighbors, max(len(n) for n in pattern.neighbors)
    # of the partners that stand for the same pattern vertices (a bit each), as many as there are pattern neighbours decide as all do
    each = edges.repartition("src").groupBy("qs", "src", "dst").agg(F.bit_or(F.expr("shiftleft(1L, qd)")).alias("for"))
    kinds = each.groupBy("qs", "src", "for").agg(F.least(F.count("*"), F.lit(most)).cast("int").alias("n"))
    shapes = written(kinds.groupBy("qs", "src").agg(F.concat_ws(",", F.sort_array(F.collect_list(F.format_string("%d:%d", "for", "n")))).alias("shape")), "shapes")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for qs, shape in zip(rows["qs"], rows["shape"]):
                left: dict[int, list[tuple[int, int]]] = {}
                for kind, n in (map(int, x.split(":")) for x in shape.split(",")):
                    for q in range(pattern.size):
                        if kind >> q & 1:
                            left.setdefault(q, []).extend((kind, i) for i in range(n))
                if all(q in left for q in neighbors[qs]):
                    used: dict[int, set[int]] = {}
                    for q, (kind, _) in matching.usable(left):
                        used.setdefault(kind, set()).add(q)
                    found += [(qs, shape, kind, sorted(qds)) for kind, qds in used.items()]
            yield pd.DataFrame(found, columns=["qs", "shape", "for", "usable"])

    verdicts = shapes.select("qs", "shape").distinct().mapInPandas(judge, "qs int, shape string, for bigint, usable array<int>")
    verdicts = written(verdicts, "verdicts")  # as many rows as there are shapes, however many candidates
    if not drop_edges:
        return shapes.join(verdicts.select("qs", "shape").distinct(), ["qs", "shape"], "left_semi").select(F.col("qs").alias("qv"), F.col("src").alias("v"))
    used = shapes.join(verdicts, ["qs", "shape"]).select("qs", "src", "for", "usable")
    return each.join(used, ["qs", "src", "for"]).select("qs", F.explode("usable").alias("qd"), "src", "dst")


def refine(pattern: Pattern, vertices: DataFrame, edges: DataFrame, structure: Structure = Structure.FOUR_CYCLES, neighborhood: Neighborhood = Neighborhood.LABELS, triangles: DataFrame | None = None, support: bool = True, cycles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One round of all filters, its results written. ``triangles`` of the data are needed where the pattern has any."""
    if neighborhood is Neighborhood.LABELS:
        vertices = written(neighbor_filter(pattern, vertices, edges), "filtered")
    elif neighborhood is Neighborhood.VERTEX_MATCHING:
        vertices = matching_filter(pattern, vertices, edges)
    else:
        edges = both_ways(matching_filter(pattern, vertices, edges, drop_edges=True))
    edges, near = alive(edges, vertices), None  # whose other way stays or goes with them in all that follows
    if structure is not Structure.NONE and pattern.triangles:
        near = near_triangles(pattern, edges, triangles)
        edges = triangle_filter(pattern, edges, triangles, support, near)
    if structure is Structure.FOUR_CYCLES:
        edges = four_cycle_filter(pattern, edges, cycles)
    left = written(edges, "filtered")
    if near is not None:
        delete(left.sparkSession, near)
    return settled(pattern, vertices, left)


def settled(pattern: Pattern, vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates with edge support and the edges between them, written; ``edges``, a written table, is deleted."""
    vertices = written(support_filter(pattern, vertices, edges), "candidates")
    left = written(alive(edges, vertices), "candidates")
    delete(edges.sparkSession, edges)
    return vertices, left


def initial(graph: Graph, pattern: Pattern, cores: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates by label, degree and core, their edges, and one pass of edge support; written."""
    vertices = vertex_candidates(graph, pattern, cores)
    return settled(pattern, vertices, written(edge_candidates(graph, pattern, vertices), "filtered"))


def data_triangles(graph: Graph, pattern: Pattern, edges: DataFrame) -> DataFrame | None:
    """``(src, dst, w)``: triangles of the data that the filters of these candidate edges look up; None if the pattern has none.

    Those of candidate edges do, unless an edge needs as many triangles as it has third vertices of one label:
    third vertices of unlike labels are different ones, so the candidate triangles found are as many.
    """
    if graph.triangles is not None or not pattern.triangles:
        return graph.triangles
    if alike_thirds(pattern):
        return written(motifs.triangle_index(graph), "triangles")
    up = written(motifs.risen(edges.select("src", "dst")), "candidates-up")
    found = written(motifs.turned(motifs.triangles_of(up)), "triangles")
    delete(up.sparkSession, up)
    return found


def build(graph: Graph, pattern: Pattern, structure: Structure = Structure.FOUR_CYCLES, neighborhood: Neighborhood = Neighborhood.LABELS, cores: DataFrame | None = None, max_rounds: int | None = None) -> CandidateSpace:
    """The candidate space after ``max_rounds`` rounds, or at the fixpoint; each round is written to the shared folder.

    Triangles and four-cycles are those of the graph's index, if it was loaded from one. An empty candidate
    space has no rows; it is not an error.
    """
    vertices, edges = initial(graph, pattern, cores)
    triangles = data_triangles(graph, pattern, edges) if structure is not Structure.NONE and max_rounds != 0 else None
    space, rounds = CandidateSpace(pattern, vertices, edges), 0
    sizes = space.sizes()
    while pattern.size > 1 and (max_rounds is None or rounds < max_rounds):
        vertices, edges = refine(pattern, space.vertices, space.edges, structure, neighborhood, triangles, cycles=graph.four_cycles)
        for old in (space.vertices, space.edges):
            delete(vertices.sparkSession, old)
        space, rounds = CandidateSpace(pattern, vertices, edges), rounds + 1
        if (now := space.sizes()) == sizes:
            break
        sizes = now
    return space
