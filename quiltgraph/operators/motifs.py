"""Triangles and four-cycles: every one once, by degree order, then as index entries of directed edges.

Edges are followed from lower to higher (degree, id): a vertex has at most about the root of the edges
above it, so hubs are not expanded against each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph, Linked, rank_of


def upward(graph: Graph) -> DataFrame:
    """``(a, b, a_deg, b_deg)``: each undirected edge once, from lower to higher rank."""
    return graph.edges.where(rank_of("src") < rank_of("dst")).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("src_deg").alias("a_deg"), F.col("dst_deg").alias("b_deg"))


def risen(links: DataFrame) -> DataFrame:
    """As :func:`upward`, of ``(src, dst)`` both ways, repeats included, ranked by their own degrees."""
    once = links.where("src < dst").distinct()
    degrees = once.select(F.col("src").alias("vid")).union(once.select("dst")).groupBy("vid").agg(F.count("*").alias("deg"))
    for side in ("src", "dst"):
        once = once.join(degrees.select(F.col("vid").alias(side), F.col("deg").alias(f"{side}_deg")), side)
    rises = rank_of("src") < rank_of("dst")
    pick = lambda x, y, name: F.when(rises, F.col(x)).otherwise(F.col(y)).alias(name)
    return once.select(pick("src", "dst", "a"), pick("dst", "src", "b"), pick("src_deg", "dst_deg", "a_deg"), pick("dst_deg", "src_deg", "b_deg"))


def triangles(graph: Graph) -> DataFrame:
    """``(a, b, c)``: each triangle once, in rising rank."""
    return graph.triangle_list if isinstance(graph, Linked) else triangles_of(upward(graph))


def triangles_of(up: DataFrame) -> DataFrame:
    first = up.select("a", "b", "b_deg")
    second = up.select("a", F.col("b").alias("c"), F.col("b_deg").alias("c_deg"))
    wedges = first.join(second, "a").where(F.struct("b_deg", "b") < F.struct("c_deg", "c"))
    return wedges.join(up.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"]).select("a", "b", "c")


def triangle_index(graph: Graph) -> DataFrame:
    """``(src, dst, w)``: for every directed edge the third vertex of each triangle through it; of a loaded index as stored."""
    return graph.triangles if graph.triangles is not None else turned(triangles(graph))


def turned(found: DataFrame) -> DataFrame:
    """``(src, dst, w)``: every turn of each triangle ``(a, b, c)``."""
    turns = [("a", "b", "c"), ("b", "a", "c"), ("a", "c", "b"), ("c", "a", "b"), ("b", "c", "a"), ("c", "b", "a")]
    return found.select(F.explode(F.array(*(F.struct(F.col(s).alias("src"), F.col(d).alias("dst"), F.col(w).alias("w")) for s, d, w in turns))).alias("t")).select("t.*")


def edge_support(graph: Graph) -> DataFrame:
    """``(src, dst, n)``: how many triangles pass through each directed edge that has one."""
    return graph.support if isinstance(graph, Linked) else support_of(triangle_index(graph))


def support_of(triangles: DataFrame) -> DataFrame:
    return triangles.groupBy("src", "dst").agg(F.count("*").alias("n"))


def through(index: DataFrame, src: int, dst: int) -> DataFrame:
    """The entries of an index of triangles or four-cycles that belong to one directed edge."""
    return index.where((F.col("src") == src) & (F.col("dst") == dst)).drop("src", "dst")


def wedges(graph: Graph) -> DataFrame:
    """``(x, y, mid)``: paths x-mid-y whose end x is of the highest rank of the three."""
    out = graph.edges.select(F.col("src").alias("mid"), "dst", "src_deg", "dst_deg")
    ends = out.where(F.struct("dst_deg", "dst") > F.struct("src_deg", "mid")).select("mid", F.col("dst").alias("x"), F.col("dst_deg").alias("x_deg"))
    return ends.join(out.select("mid", F.col("dst").alias("y"), F.col("dst_deg").alias("y_deg")), "mid").where(F.struct("x_deg", "x") > F.struct("y_deg", "y")).select("x", "y", "mid")


def four_cycle_count(graph: Graph) -> DataFrame:
    """One row: the number of four-cycles, from the common neighbours of opposite ends; no cycle is made."""
    codegree = wedges(graph).groupBy("x", "y").agg(F.count("*").alias("n"))
    return codegree.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("bigint").alias("four_cycles"))


def four_cycles(graph: Graph) -> DataFrame:
    """``(x, m1, y, m2)``: each cycle x-m1-y-m2 once; x has the highest rank, m1 < m2."""
    w = wedges(graph)
    return w.withColumnRenamed("mid", "m1").join(w.withColumnRenamed("mid", "m2"), ["x", "y"]).where("m1 < m2").select("x", "m1", "y", "m2")


def four_cycle_index(graph: Graph) -> DataFrame:
    """``(src, dst, x, y, diag_src, diag_dst)``: for every directed edge each cycle src-dst-x-y through it.

    ``diag_src`` tells whether src-x is an edge too, ``diag_dst`` whether dst-y is. Of a loaded index as stored.
    """
    if graph.four_cycles is not None:
        return graph.four_cycles
    edge = graph.edges.select("src", "dst").withColumn("is", F.lit(True))
    found = four_cycles(graph)
    found = found.join(edge.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("is").alias("xy")), ["x", "y"], "left").join(edge.select(F.col("src").alias("m1"), F.col("dst").alias("m2"), F.col("is").alias("mm")), ["m1", "m2"], "left")
    ring, entries = ["x", "m1", "y", "m2"], []
    for step in (1, -1):
        for i in range(4):
            a, b, c, d = (ring[(i + step * k) % 4] for k in range(4))
            of = lambda p, q: F.coalesce(F.col("xy") if {p, q} == {"x", "y"} else F.col("mm"), F.lit(False))
            entries.append(F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.col(c).alias("x"), F.col(d).alias("y"), of(a, c).alias("diag_src"), of(b, d).alias("diag_dst")))
    return found.select(F.explode(F.array(*entries)).alias("t")).select("t.*")


def summary(graph: Graph) -> DataFrame:
    """One row: triangle_count, four_cycle_count, avg_degree, max_degree."""
    v = graph.vertices.agg(F.round(F.avg("deg"), 6).alias("avg_degree"), F.max("deg").alias("max_degree"))
    return triangles(graph).agg(F.count("*").alias("triangle_count")).crossJoin(four_cycle_count(graph).withColumnRenamed("four_cycles", "four_cycle_count")).crossJoin(v)  # a row each
