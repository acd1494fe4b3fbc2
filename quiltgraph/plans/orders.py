"""Connected expansion orders of a pattern and their prefixes, on the driver and as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pattern import Pattern

#: Patterns of up to this many vertices are enumerated completely; others by a beam of this width.
EXACT_UP_TO, BEAM = 7, 50


def ranked(pattern: Pattern) -> list[int]:
    """Vertices by (label, id): the order in which choices are tried."""
    return sorted(range(pattern.size), key=lambda v: (pattern.labels[v], v))


def exact(pattern: Pattern) -> list[tuple[int, ...]]:
    """All orders in which each vertex touches an earlier one, in the order of :func:`ranked` choices."""
    choices, found, stack = ranked(pattern), [], [()]
    while stack:
        order = stack.pop()
        if len(order) == pattern.size:
            found.append(order)
            continue
        used = set(order)
        stack += [(*order, v) for v in reversed(choices) if v not in used and (not order or used & set(pattern.neighbors[v]))]
    return found


def beam(pattern: Pattern, width: int = BEAM, score: Callable[[tuple[int, ...]], float] | None = None) -> list[tuple[int, ...]]:
    """At most ``width`` orders, grown level by level; each level keeps the first, or with ``score`` the lowest."""
    choices, level = ranked(pattern), [()]
    for _ in range(pattern.size):
        level = [(*o, v) for o in level for v in choices if v not in o and (not o or set(o) & set(pattern.neighbors[v]))]
        level = (level if score is None else sorted(level, key=score))[:width]
    return level


def generate(pattern: Pattern, beam_width: int | None = None, exact_up_to: int = EXACT_UP_TO) -> list[tuple[int, ...]]:
    """Every order of a small pattern; a beam for larger ones, or where a width is given."""
    return exact(pattern) if beam_width is None and pattern.size <= exact_up_to else beam(pattern, beam_width or BEAM)


def prefix(pattern: Pattern, order: tuple[int, ...], k: int) -> Pattern:
    """The sub-pattern on the first ``k`` vertices of an order."""
    return pattern.induced(order[:k])


def prefix_key(order: tuple[int, ...]) -> str:
    """Prefixes with equal vertex sets are equal sub-patterns, whatever their order."""
    return ",".join(map(str, sorted(order)))


def tables(spark: SparkSession, pattern: Pattern) -> tuple[DataFrame, DataFrame]:
    """``(qv, label, rank)`` and ``(qs, qd, elabel)`` (both directions) of a pattern."""
    rank = {v: i for i, v in enumerate(ranked(pattern))}
    vertices = spark.createDataFrame([(v, pattern.labels[v], rank[v]) for v in range(pattern.size)], "qv int, label int, rank int")
    return vertices, spark.createDataFrame([(a, b, e) for (a, b), e in sorted(pattern.edge_label.items())], "qs int, qd int, elabel int")


def orders_frame(spark: SparkSession, pattern: Pattern, beam_width: int | None = None) -> DataFrame:
    """``(order_id, ord)``: :func:`exact`, or with a width :func:`beam`, as joins over the pattern's tables.

    Order ids follow the ranks of the choices. The tables have as many rows as the pattern has parts, so
    every side is broadcast.
    """
    vertices, edges = (F.broadcast(x) for x in tables(spark, pattern))
    level = vertices.select(F.array("qv").alias("ord"), F.array("rank").alias("ranks"))

    def cut(df: DataFrame) -> DataFrame:
        # a level has at most beam_width * |V| rows
        first = Window.orderBy("ranks")
        return df if beam_width is None else df.withColumn("n", F.row_number().over(first)).where(F.col("n") <= beam_width).drop("n")

    level = cut(level)
    for _ in range(pattern.size - 1):
        grown = level.join(edges, F.array_contains("ord", F.col("qs")) & ~F.array_contains("ord", F.col("qd"))).select("ord", "ranks", F.col("qd").alias("qv")).distinct()
        level = cut(grown.join(vertices, "qv").select(F.concat("ord", F.array("qv")).alias("ord"), F.concat("ranks", F.array("rank")).alias("ranks")))
    return level.select((F.row_number().over(Window.orderBy("ranks")) - 1).cast("int").alias("order_id"), "ord")


def prefixes_frame(spark: SparkSession, pattern: Pattern, orders: DataFrame) -> DataFrame:
    """``(order_id, k, prefix_key, num_vertices, num_edges)`` of every prefix of every order."""
    _, edges = tables(spark, pattern)
    once = F.broadcast(edges.where("qs < qd"))
    each = orders.select("order_id", "ord", F.posexplode("ord").alias("i", "qv")).select("order_id", (F.col("i") + 1).alias("k"), F.slice("ord", 1, F.col("i") + 1).alias("head"))
    inside = F.array_contains("head", F.col("qs")) & F.array_contains("head", F.col("qd"))
    counted = each.join(once, inside, "left").groupBy("order_id", "k", "head").agg(F.count("qs").cast("int").alias("num_edges"))
    return counted.select("order_id", "k", F.array_join(F.sort_array("head"), ",").alias("prefix_key"), F.col("k").alias("num_vertices"), "num_edges")


def prefix_edges_frame(spark: SparkSession, pattern: Pattern, orders: DataFrame) -> DataFrame:
    """``(order_id, k, a, b, elabel)``: edges of every prefix, vertices renumbered by ascending id."""
    _, edges = tables(spark, pattern)
    once = F.broadcast(edges.where("qs < qd"))
    each = orders.select("order_id", F.posexplode("ord").alias("i", "qv"), "ord").select("order_id", (F.col("i") + 1).alias("k"), F.sort_array(F.slice("ord", 1, F.col("i") + 1)).alias("head"))
    found = each.join(once, F.array_contains("head", F.col("qs")) & F.array_contains("head", F.col("qd")))
    place = lambda c: (F.array_position("head", F.col(c)) - 1).cast("int")
    return found.select("order_id", "k", place("qs").alias("a"), place("qd").alias("b"), "elabel")
